"""Benchmark decontamination by winnowing.

Of every ``WINDOW - GRAM + 1`` neighbouring word grams the one with the smallest hash
is kept as a fingerprint, so any span of ``WINDOW`` words that a document shares with
an item shares a fingerprint at the same place.  Fingerprints of the documents meet
those of the benchmark, and each hit is extended word by word in both directions; a
run of ``WINDOW`` equal words or more counts.  The extension compares the words
themselves, so no hash collision reaches the result.

The benchmark is read in parts of at most ``PART_BYTES`` of text; each part is indexed
and broadcast, and the documents pass the parts one after the other.  Documents are
never shuffled, and neither driver nor executors hold more than the parts' bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .runtime import ship_by_value

WINDOW, GRAM = 10, 5
PART_BYTES = 8 << 20

_SPAN = pa.list_(pa.int32())
_STATE = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string()), ("starts", _SPAN), ("ends", _SPAN), ("items", pa.list_(pa.string()))])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("hit_starts", _SPAN), ("hit_ends", _SPAN)])
_STATE_DDL = "doc_id long, text string, starts array<int>, ends array<int>, items array<string>"
_OUT_DDL = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_starts array<int>, hit_ends array<int>"


def _hashes(raw, s, e):
    return T.word_hashes(raw, s, e, T.BYTE_CODE[T.LOWER])


def _fingerprints(h: np.ndarray, doff: np.ndarray) -> np.ndarray:
    """Positions of the grams that are the minimum of one of their windows."""
    g = T.gram_hashes(h, GRAM)
    g[~T.inside(doff, GRAM, len(g))] = np.uint64(2**64 - 1)
    w = WINDOW - GRAM + 1
    if len(g) < w:
        return np.zeros(0, np.int64), g
    least = T.window_min(g, w)
    picked = np.zeros(len(g), bool)
    for j in range(w):
        picked[j : j + len(least)] |= g[j : j + len(least)] == least
    return np.flatnonzero(picked), g


class Index:
    """Fingerprints of one part of the benchmark; equal items share one entry."""

    def __init__(self, items: list[tuple[str, str]]):
        by_words: dict[tuple[bytes, ...], list[str]] = {}
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            s, e, _ = T.words(raw, np.array([0, len(raw)]), T.IS_ALNUM)
            low = T.LOWER[raw].tobytes()
            if len(s):
                by_words.setdefault(tuple(low[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)), []).append(str(item))
        self.words, self.ids = list(by_words), list(by_words.values())
        at: dict[int, list[tuple[int, int]]] = {}
        short: dict[int, dict[int, list[int]]] = {}
        for c, words in enumerate(self.words):
            raw = np.frombuffer(b" ".join(words), np.uint8)
            s, e, doff = T.words(raw, np.array([0, len(raw)]), T.IS_ALNUM)
            h = _hashes(raw, s, e)
            if len(words) < WINDOW:
                short.setdefault(len(words), {}).setdefault(int(T.gram_hashes(h, len(words))[0]), []).append(c)
            else:
                picked, g = _fingerprints(h, doff)
                for q in picked.tolist():
                    at.setdefault(int(g[q]), []).append((c, q))
        self.at, self.short = at, short
        self.keys = np.array(sorted(at), np.uint64)
        self.short_keys = {n: np.array(sorted(x), np.uint64) for n, x in short.items()}


def _within(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def _hits(index: Index, raw: np.ndarray, s, e, doff) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
    """By document of the chunk: hit word ranges and the items that hit."""
    h = _hashes(raw, s, e)
    picked, g = _fingerprints(h, doff)
    found = [(p, WINDOW) for p in picked[_within(g[picked], index.keys)].tolist()]
    grams = {}
    for n, keys in index.short_keys.items():
        grams[n] = T.gram_hashes(h, n)
        found += [(p, n) for p in np.flatnonzero(_within(grams[n], keys) & T.inside(doff, n, len(grams[n]))).tolist()]
    out: dict[int, tuple[list, set]] = {}
    if not found:
        return out
    low, starts, ends = T.LOWER[raw].tobytes(), s.tolist(), e.tolist()
    docs = (np.searchsorted(doff, [p for p, _ in found], "right") - 1).tolist()
    done: dict[tuple[int, int, int], int] = {}
    word = lambda p: low[starts[p] : ends[p]]
    for d, (p, n) in zip(docs, found, strict=True):
        lo, hi = int(doff[d]), int(doff[d + 1])
        if n < WINDOW:
            for c in index.short[n][int(grams[n][p])]:
                if all(word(p + k) == w for k, w in enumerate(index.words[c])):
                    spans, items = out.setdefault(d, ([], set()))
                    spans.append((p - lo, p - lo + n))
                    items.add(c)
            continue
        for c, q in index.at[int(g[p])]:
            if done.get((d, c, p - q), -1) > p:
                continue
            words, a, b = index.words[c], 0, 0
            while p + b < hi and q + b < len(words) and word(p + b) == words[q + b]:
                b += 1
            while b and p - a > lo and q - a > 0 and word(p - a - 1) == words[q - a - 1]:
                a += 1
            done[d, c, p - q] = p + max(b, 1)
            if a + b >= WINDOW:
                spans, items = out.setdefault(d, ([], set()))
                spans.append((p - a - lo, p + b - lo))
                items.add(c)
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _scan(index: Index, last: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            old = [batch.column(k).to_pylist() for k in (2, 3, 4)] if batch.num_columns > 2 else [[[]] * len(ids)] * 3
            for i, j, raw, off in T.rows(texts):
                s, e, doff = T.words(raw, off, T.IS_ALNUM)
                hits = _hits(index, raw, s, e, doff)
                spans, items = [], []
                for d in range(j - i):
                    got, classes = hits.get(d, ((), ()))
                    spans.append(_merged([*zip(old[0][i + d], old[1][i + d], strict=True), *got]) if got or old[0][i + d] else [])
                    items.append(sorted({*old[2][i + d], *(x for c in classes for x in index.ids[c])}) if classes or old[2][i + d] else [])
                starts = pa.array([[a for a, _ in x] for x in spans], _SPAN)
                ends = pa.array([[b for _, b in x] for x in spans], _SPAN)
                if last:
                    hit = [sum(b - a for a, b in x) for x in spans]
                    sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
                    yield pa.RecordBatch.from_arrays([ids[i:j], pa.array(np.diff(doff)), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha), pa.array([x > 0 for x in hit]), starts, ends], schema=_OUT)
                else:
                    yield pa.RecordBatch.from_arrays([ids[i:j], texts[i:j].cast(pa.large_string()), starts, ends, pa.array(items, pa.list_(pa.string()))], schema=_STATE)

    return kernel


def _parts(bench: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    part, size = [], 0
    for item, text in bench.select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        part.append((item, text))
        size += len(text or "")
        if size >= PART_BYTES:
            yield part
            part, size = [], 0
    yield part


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row for each row of ``docs``: n_words, n_hit, n_items, items_sha256, contaminated and the hit word ranges.

    Null and wordless texts have no words and no hits; a null or wordless item has no
    window.  An item of fewer than ``WINDOW`` words is one window.  Items with equal
    words count each by its own id; an id that several rows repeat counts once.
    Without items nothing is contaminated.  Other columns are not read.
    """
    ship_by_value()
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    part = None
    for following in _parts(bench, item_col, text_col):
        if part is not None:
            out = out.mapInArrow(_broadcast_scan(docs, part, False), _STATE_DDL)
        part = following
    return out.mapInArrow(T.lean(_broadcast_scan(docs, part, True)), _OUT_DDL)


def _broadcast_scan(docs: DataFrame, part: list[tuple[str, str]], last: bool):
    held = docs.sparkSession.sparkContext.broadcast({"items": part})

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = held.value  # one dict for each worker process, so the index is built once there
        if "index" not in value:
            value["index"] = Index(value["items"])
        return _scan(value["index"], last)(batches)

    return kernel
