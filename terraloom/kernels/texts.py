"""Text files that need more than Spark's readers: ledgers with typed cells, JSON that keeps its number tokens, odd encodings."""

from __future__ import annotations

import codecs
import re


def repaired(data: bytes) -> tuple[str, bool]:
    """Valid UTF-8 as it is; else strict GB18030; else U+FFFD for each bad byte.  And whether it was repaired."""
    try:
        return data.decode("utf-8"), False
    except UnicodeDecodeError:
        pass
    try:
        return data.decode("gb18030"), True
    except UnicodeDecodeError:
        # The built-in handler gives one mark for a whole bad sequence.
        codecs.register_error("each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))
        return data.decode("utf-8", "each-byte"), True


def ledger(data: bytes) -> tuple[list[str], list[tuple[str, list[tuple[str, bool]]]], int]:
    """Header, rows (key, cells with their quoted flag) and the number of repeated keys of a ledger file.

    Quotes, doubled quotes and line ends within quotes are as in RFC 4180.  Short rows are
    padded, extra cells dropped, rows without a key skipped; the first of a repeated key holds.
    """
    text, _ = repaired(data.removeprefix(b"\xef\xbb\xbf"))
    records: list[list[tuple[str, bool]]] = []
    row: list[tuple[str, bool]] = []
    cell, quoted, inside, k = [], False, False, 0
    while k < len(text):
        c = text[k]
        if inside:
            if c == '"' and text[k + 1 : k + 2] == '"':
                cell.append('"')
                k += 1
            elif c == '"':
                inside = False
            else:
                cell.append(c)
        elif c == '"' and not "".join(cell).strip():
            cell, quoted, inside = [], True, True
        elif c in ",\n":
            row.append(("".join(cell).removesuffix("\r"), quoted))
            cell, quoted = [], False
            if c == "\n":
                records.append(row)
                row = []
        else:
            cell.append(c)
        k += 1
    if cell or row or quoted:
        records.append([*row, ("".join(cell).removesuffix("\r"), quoted)])
    records = [r for r in records if any(x.strip() or q for x, q in r)]
    if not records or not records[0][0][0].strip():
        raise ValueError("a ledger needs a header with a key column")
    header = [x.strip() for x, _ in records[0]]
    seen: dict[str, list[tuple[str, bool]]] = {}
    repeated = 0
    for r in records[1:]:
        key = r[0][0].strip()
        if not key:
            continue
        if key in seen:
            repeated += 1
            continue
        seen[key] = [*r[1 : len(header)], *[("", False)] * (len(header) - len(r))]
    return header, list(seen.items()), repeated


_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")


class Token(str):
    """A number as it was written."""


def parse_json(text: str, depth: int = 200):
    """Strict JSON whose numbers are :class:`Token` and whose objects are lists of pairs, in order."""
    import json

    text = text.removeprefix("\ufeff")
    scan = json.decoder.scanstring
    space = re.compile(r"[ \t\n\r]*")

    def fail(k: int):
        raise ValueError(f"malformed JSON at {k}")

    def string(k: int) -> tuple[str, int]:
        s, k = scan(text, k + 1, True)
        if any(0xD800 <= ord(c) < 0xE000 for c in s):
            fail(k)
        return s, k

    def value(k: int, left: int):
        k = space.match(text, k).end()
        if left < 0 or k >= len(text):
            fail(k)
        c = text[k]
        if c == '"':
            return string(k)
        if c in "[{":
            out, close = [], "]" if c == "[" else "}"
            k = space.match(text, k + 1).end()
            if text[k : k + 1] == close:
                return (out if c == "[" else dict_of(out)), k + 1
            while True:
                if c == "{":
                    k = space.match(text, k).end()
                    if text[k : k + 1] != '"':
                        fail(k)
                    name, k = string(k)
                    k = space.match(text, k).end()
                    if text[k : k + 1] != ":":
                        fail(k)
                    item, k = value(k + 1, left - 1)
                    out.append((name, item))
                else:
                    item, k = value(k, left - 1)
                    out.append(item)
                k = space.match(text, k).end()
                if text[k : k + 1] == close:
                    return (out if c == "[" else dict_of(out)), k + 1
                if text[k : k + 1] != ",":
                    fail(k)
                k += 1
        for word, v in (("true", True), ("false", False), ("null", None)):
            if text.startswith(word, k):
                return v, k + len(word)
        m = _NUMBER.match(text, k)
        if not m:
            fail(k)
        return Token(m[0]), m.end()

    out, k = value(0, depth)
    if space.match(text, k).end() != len(text):
        fail(k)
    return out


class Members(list):
    """Members of an object, in order."""

    def get(self, name: str, default=None):
        return next((v for k, v in self if k == name), default)


def dict_of(pairs: list) -> Members:
    return Members(pairs)


def write_json(v) -> str:
    """Compact text; numbers as their tokens, or shortest if they are floats."""
    import json

    if isinstance(v, Token):
        return str.__str__(v)
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() and abs(v) < 1e15 else repr(v)
    if isinstance(v, Members):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{write_json(x)}" for k, x in v) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(write_json, v)) + "]"
    return json.dumps(v, ensure_ascii=False)


_DEPTH = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


def transformed_geojson(doc, move):
    """A GeoJSON document with every position moved by ``move(x, y, z) -> (x, y, z)``; z stays only where it is a number."""

    def position(p):
        if len(p) < 2 or not all(isinstance(c, Token) for c in p[:2]):
            raise ValueError("a position needs two numbers")
        high = len(p) > 2 and isinstance(p[2], Token)
        x, y, z = move(float(p[0]), float(p[1]), float(p[2]) if high else 0.0)
        return [x, y, *([z] if high else [])]

    def nested(c, depth):
        return position(c) if depth == 0 else [nested(x, depth - 1) for x in c]

    def geometry(g):
        if g is None:
            return None
        kind = g.get("type")
        if kind == "GeometryCollection":
            return Members((k, [geometry(x) for x in v] if k == "geometries" else v) for k, v in g)
        if kind not in _DEPTH:
            raise ValueError(f"unknown geometry {kind}")
        return Members((k, nested(v, _DEPTH[kind]) if k == "coordinates" else v) for k, v in g)

    kind = doc.get("type")
    if kind == "FeatureCollection":
        return Members((k, [transformed_geojson(f, move) for f in v] if k == "features" else v) for k, v in doc)
    if kind == "Feature":
        return Members((k, geometry(v) if k == "geometry" else v) for k, v in doc)
    return geometry(doc)
