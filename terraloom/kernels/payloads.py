"""Binary and JSON payloads of tiles: GLB, b3dm, batch tables, quantized meshes, PNG, tileset and layer JSON."""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections.abc import Sequence

import numpy as np

#: Component types of the binary formats.
BYTE, SHORT, UINT, FLOAT = 5121, 5123, 5125, 5126
#: Fixed value: a white pixel stands in for a missing texture.
WHITE = bytes([255, 255, 255, 255])


def padded(data: bytes, size: int, fill: bytes = b"\0", at: int = 0) -> bytes:
    return data + fill * (-(at + len(data)) % size)


def batch_component(rows: int) -> int:
    """Component type of batch ids: the smallest that holds them; beyond 16 bits, float."""
    return BYTE if rows <= 255 else SHORT if rows <= 65535 else FLOAT


def glb(groups: Sequence[dict], double_sided: bool = False) -> bytes:
    """glTF 2.0 binary of groups with positions, indices, and optional normals, uvs, batch_ids, color.

    Groups of fewer than three vertices or without indices are left out; without any
    group the result is empty.
    """
    body, views, accessors, primitives, materials = bytearray(), [], [], [], []

    def add(array: np.ndarray, kind: str, component: int, target: int, bounds: bool = False) -> int:
        views.append({"buffer": 0, "byteOffset": len(body), "byteLength": array.nbytes, "target": target})
        acc = {"bufferView": len(views) - 1, "componentType": component, "count": len(array), "type": kind}
        if bounds:
            acc |= {"min": array.min(0).tolist(), "max": array.max(0).tolist()}
        body.extend(padded(array.tobytes(), 4))
        accessors.append(acc)
        return len(accessors) - 1

    for g in groups:
        pos, idx = np.asarray(g["positions"], "<f4").reshape(-1, 3), np.asarray(g["indices"], "<u4").ravel()
        if len(pos) < 3 or not len(idx):
            continue
        attributes = {"POSITION": add(pos, "VEC3", FLOAT, 34962, True)}
        if g.get("normals") is not None:
            attributes["NORMAL"] = add(np.asarray(g["normals"], "<f4").reshape(-1, 3), "VEC3", FLOAT, 34962)
        if g.get("uvs") is not None:
            attributes["TEXCOORD_0"] = add(np.asarray(g["uvs"], "<f4").reshape(-1, 2), "VEC2", FLOAT, 34962)
        if g.get("batch_ids") is not None:
            component = batch_component(g.get("batch_rows", int(max(g["batch_ids"])) + 1))
            ids = np.asarray(g["batch_ids"], {BYTE: "<u1", SHORT: "<u2", FLOAT: "<f4"}[component])
            attributes["_BATCHID"] = add(ids, "SCALAR", component, 34962)
        materials.append({"pbrMetallicRoughness": {"baseColorFactor": list(g.get("color", (1, 1, 1, 1))), "metallicFactor": 0, "roughnessFactor": 1}, "doubleSided": double_sided})
        primitives.append({"attributes": attributes, "indices": add(idx, "SCALAR", UINT, 34963), "material": len(materials) - 1})
    if not primitives:
        return b""
    doc = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "meshes": [{"primitives": primitives}], "materials": materials, "accessors": accessors, "bufferViews": views, "buffers": [{"byteLength": len(body)}]}
    text, data = padded(json.dumps(doc, separators=(",", ":")).encode(), 4, b" "), padded(bytes(body), 4)
    return struct.pack("<III", 0x46546C67, 2, 28 + len(text) + len(data)) + struct.pack("<II", len(text), 0x4E4F534A) + text + struct.pack("<II", len(data), 0x004E4942) + data


def b3dm(model: bytes, rows: int = 0, table_json: bytes = b"", table_binary: bytes = b"") -> bytes:
    """Batched model; every section ends at a multiple of eight bytes of the file."""
    if not table_json:
        table_binary = b""
    at = 28
    feature = padded(json.dumps({"BATCH_LENGTH": rows if table_json else 0}, separators=(",", ":")).encode(), 8, b" ", at)
    at += len(feature)
    text = padded(table_json, 8, b" ", at)
    at += len(text)
    binary = padded(table_binary, 8, b"\0", at)
    at += len(binary)
    model = padded(model, 8, b"\0", at)
    return b"b3dm" + struct.pack("<IIIIII", 1, at + len(model), len(feature), 0, len(text), len(binary)) + feature + text + binary + model


_RANKS = ("bool", "int32", "int64", "double", "vec3", "string")


def batch_table(rows: Sequence[Sequence[tuple[str, str, object]]]) -> tuple[bytes, bytes, int]:
    """JSON, binary and the number of non-finite values of rows of (key, type, value).

    A column that all rows have, of finite numbers of one width, is binary; others are
    JSON arrays with nulls; one without any value is left out.  Of a repeated key the
    first value counts; empty strings count as missing.
    """
    order: dict[str, None] = {}
    values: list[dict[str, tuple[str, object]]] = []
    for row in rows:
        own: dict[str, tuple[str, object]] = {}
        for key, kind, value in row:
            if key not in own and value is not None and value != "":
                own[key] = (kind, value)
                order.setdefault(key)
        values.append(own)
    odd, doc, binary = 0, {}, bytearray()
    for key in order:
        have = [v[key] for v in values if key in v]
        flat = [x for k, v in have for x in (v if k == "vec3" else [v])]
        bad = sum(isinstance(x, float) and not math.isfinite(x) for x in flat)
        odd += bad
        rank = max(_RANKS.index(k) for k, _ in have)
        wide = any(k in ("int32", "int64") and not -(2**31) <= v < 2**31 for k, v in have)
        full = len(have) == len(values) and not bad and not any(k == "bool" for k, _ in have)
        kind = {1: "INT", 2: None if wide else "INT", 3: "DOUBLE", 4: "FLOAT"}.get(rank)
        if full and kind and (rank != 4 or all(k == "vec3" for k, _ in have)):
            code, width = {"INT": ("<i4", 4), "DOUBLE": ("<f8", 8), "FLOAT": ("<f4", 4)}[kind]
            binary.extend(b"\0" * (-len(binary) % width))
            doc[key] = {"byteOffset": len(binary), "componentType": kind, "type": "VEC3" if rank == 4 else "SCALAR"}
            binary.extend(np.array([v for _, v in have], code).tobytes())
        else:
            finite = lambda x: None if isinstance(x, float) and not math.isfinite(x) else x
            doc[key] = [finite(v[key][1]) if key in v and v[key][0] != "vec3" else ([finite(x) for x in v[key][1]] if key in v else None) for v in values]
    return json.dumps(doc, separators=(",", ":"), ensure_ascii=False).encode(), bytes(binary), odd


def zigzag(x: np.ndarray) -> np.ndarray:
    d = np.diff(np.asarray(x, np.int64), prepend=0)
    return ((d << 1) ^ (d >> 63)).astype("<u2")


def high_water(indices: np.ndarray) -> np.ndarray:
    out, high = np.empty(len(indices), "<u2"), 0
    for k, i in enumerate(np.asarray(indices).tolist()):
        out[k] = high - i
        high += i == high
    return out


def quantized_mesh(u, v, h, triangles, centre, low: float, high: float, sphere, radius: float, horizon, normals: bytes | None = None) -> bytes:
    """Quantized-mesh tile: header, zigzag vertices, high-water-mark indices, edges, normals."""
    n = len(u)
    if n >= 65536:
        raise ValueError("too many vertices for 16-bit indexes")
    out = struct.pack("<3d2f3dd3d", *centre, low, high, *sphere, radius, *horizon) + struct.pack("<I", n)
    out += zigzag(u).tobytes() + zigzag(v).tobytes() + zigzag(h).tobytes()
    tri = np.asarray(triangles).ravel()
    out += struct.pack("<I", len(tri) // 3) + high_water(tri).tobytes()
    u, v = np.asarray(u), np.asarray(v)
    for mask, key in ((u == 0, v), (v == 0, u), (u == 32767, -v), (v == 32767, -u)):
        edge = np.flatnonzero(mask)
        edge = edge[np.argsort(key[edge], kind="stable")]
        out += struct.pack("<I", len(edge)) + edge.astype("<u2").tobytes()
    if normals is not None:
        out += struct.pack("<BI", 1, len(normals)) + normals
    return out


def png(rgba: np.ndarray) -> bytes:
    """PNG of an (h, w, 4) byte array."""
    h, w, _ = rgba.shape
    raw = b"".join(b"\0" + rgba[r].tobytes() for r in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 9)) + chunk(b"IEND", b"")


def rendered_tile(image: np.ndarray, corners: np.ndarray, size: int = 256, nodata: Sequence[int] | None = None) -> np.ndarray | None:
    """RGBA tile of an RGB image from the source (col, row) of its four corners (nw, ne, sw, se); None if nothing shows.

    Pixel centres are interpolated between the corners; colours bilinearly, cut to whole
    numbers.  Outside the image, and on pixels equal to ``nodata``, alpha is 0.
    """
    t = (np.arange(size) + 0.5) / size
    s, r = t[None, :, None], t[:, None, None]
    at = (corners[0] * (1 - s) + corners[1] * s) * (1 - r) + (corners[2] * (1 - s) + corners[3] * s) * r
    x, y = at[..., 0] - 0.5, at[..., 1] - 0.5
    h, w, _ = image.shape
    inside = (at[..., 0] >= 0) & (at[..., 0] < w) & (at[..., 1] >= 0) & (at[..., 1] < h)
    if not inside.any():
        return None
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.minimum(x.astype(int), max(w - 2, 0)), np.minimum(y.astype(int), max(h - 2, 0))
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    rgb = (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy
    rgb = np.clip(rgb, 0, 255).astype(np.uint8)
    if nodata is not None:
        inside &= (rgb != np.asarray(nodata, np.uint8)).any(-1)
    if not inside.any():
        return None
    return np.concatenate([rgb, np.where(inside, 255, 0).astype(np.uint8)[..., None]], 2)


def tileset(cells: Sequence[dict], max_lod: int, root_error: float, refine: str = "ADD", transform: Sequence[float] | None = None) -> str:
    """tileset.json of cells (level, ix, iy, iz, box as 12 numbers, error, content or None, external or None)."""
    if refine not in ("ADD", "REPLACE"):
        raise ValueError("refine must be ADD or REPLACE")
    by = {(c["level"], c["ix"], c["iy"], c["iz"]): c for c in cells}
    kids: dict[tuple, list[tuple]] = {}
    for k in by:
        kids.setdefault((k[0] + 1, k[1] >> 1, k[2] >> 1, k[3] >> 1), []).append(k)

    def node(key: tuple) -> dict | None:
        c = by[key]
        below = [x for x in map(node, sorted(kids.get(key, ()))) if x] if not c.get("external") else []
        uri = c.get("external") or c.get("content")
        if not uri and not below:
            return None
        out = {"boundingVolume": {"box": list(c["box"])}, "geometricError": c["error"], "refine": refine}
        if uri:
            out["content"] = {"uri": uri}
        return out | ({"children": below} if below else {})

    top = [x for x in (node(k) for k in sorted(by) if k[0] == max_lod) if x]
    boxes = np.array([c["box"] for c in cells], float) if len(cells) else np.zeros((1, 12))
    half = boxes[:, [3, 7, 11]]
    lo, hi = (boxes[:, :3] - half).min(0), (boxes[:, :3] + half).max(0)
    mid, ext = (lo + hi) / 2, np.maximum((hi - lo) / 2, 1e-3)
    root = {"boundingVolume": {"box": [*mid.tolist(), ext[0], 0, 0, 0, ext[1], 0, 0, 0, ext[2]]}, "geometricError": root_error, "refine": refine, "children": top}
    if transform is not None:
        root["transform"] = list(transform)
    return json.dumps({"asset": {"version": "1.0"}, "geometricError": root_error, "root": root}, default=float)


def layer_json(ranges: Sequence[tuple[int, int, int, int, int]], levels: int, bounds: Sequence[float], normals: bool = True) -> str:
    """layer.json of a terrain pyramid from (level, x0, y0, x1, y1) with rows counted from the north."""
    out: list[list[dict]] = [[] for _ in range(levels)]
    for level, x0, y0, x1, y1 in sorted(ranges):
        flip = 2**level - 1
        out[level].append({"startX": x0, "startY": flip - y1, "endX": x1, "endY": flip - y0})
    return json.dumps({"tilejson": "2.1.0", "format": "quantized-mesh-1.0", "version": "1.0.0", "scheme": "tms", "projection": "EPSG:4326", "bounds": list(bounds), "minzoom": 0, "maxzoom": levels - 1, "tiles": ["{z}/{x}/{y}.terrain"], "available": out, "extensions": ["octvertexnormals"] if normals else [], "littleEndianExtensionSize": True})
