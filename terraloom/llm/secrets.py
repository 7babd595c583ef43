"""Secret scans: fixed patterns, and a character convolutional network over the other candidates.

Three patterns give the base findings.  Every other run of ``CANDIDATE`` or more
token characters (dots at its ends left out) is a candidate; a small convolutional network
in numpy reads all its characters and ``BEFORE`` more on both sides, in windows that slide
over them, and adds those that look like secrets in any window.  It is
trained on the findings of the patterns (labels of the method) against candidates
that neither a pattern takes nor look like its findings (random characters, or a key
word before or in them; these are left out, being neither), all those of all documents.  These
examples are written once, with equal ones counted, and dealt by a hash to shards; in
each pass every shard learns from all of its own, and the means of weights and moments go on.
Logits are calibrated on a quarter held back, by hash too, and the threshold is the
highest that keeps ``RECALL`` of that part's findings.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .quality import platt
from .runtime import released, ship_by_value, written

CANDIDATE, BEFORE, WIDTH, STRIDE = 12, 24, 80, 40
SLICE = 4096
RECALL, RANDOM_BITS = 0.98, 3.0
EMBED, KERNEL, FILTERS, RATE, STEP = 8, 5, 24, 0.005, 128
#: Shards: one for so many characters of text, up to so many.  Passes: as many as make so many examples of a shard, within limits.
SHARD_CHARS, SHARDS, SEEN, PASSES = 1 << 23, 256, 100_000, (8, 30)
#: Low bits of a logit that the first count of logits leaves out.
LOW_BITS = 12

#: The base patterns and the least length of what they match.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "cnn")
#: Words beside which a candidate is no negative.
BESIDE = re.compile(rb"pass(word|wd|phrase)?|pwd|secret|token|key|auth|credential|bearer", re.IGNORECASE)
_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_IS_HEX = np.isin(np.arange(256), [*range(48, 58), *range(97, 103)])
_IS_TOKEN = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=.-"])
_EXAMPLES = pa.schema([("h", pa.int64()), ("body", pa.binary()), ("lead", pa.int32()), ("size", pa.int32()), ("y", pa.int32()), ("n", pa.int64())])
_TALLY = pa.schema([("shard", pa.int64()), ("held", pa.int32()), ("y", pa.int32()), ("n", pa.int64()), ("rows", pa.int64())])
_STATE = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("t", pa.int64()), ("state", pa.binary())])
_LOGITS = pa.schema([("y", pa.int32()), ("place", pa.int64()), ("n", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def base_spans(raw: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """By document of a chunk: (start, kind, end) in bytes of the document, sorted.

    A span is the whole match of its pattern.
    """
    out: dict[int, list[tuple[int, int, int]]] = {}
    s, e, _ = T.words(raw, off, _IS_HEX)
    long = e - s >= LEAST_HEX
    s, e = s[long], e[long]
    docs = np.searchsorted(off, s, "right") - 1
    for d, a, b in zip(docs.tolist(), s.tolist(), e.tolist(), strict=True):
        out.setdefault(d, []).append((a - int(off[d]), 2, b - int(off[d])))
    data = raw.tobytes()
    low = data.lower()
    for kind, hints, body in ((0, _HINTS, low), (1, (b"AKIA",), data)):
        at: set[int] = set()
        for hint in hints:
            k = body.find(hint)
            while k >= 0:
                d = int(np.searchsorted(off, k, "right")) - 1
                at.add(d)
                k = body.find(hint, int(off[d + 1]))  # one hit is enough for a document
        for d in at:
            text = data[off[d] : off[d + 1]]
            for m in (ACCESS if kind else ASSIGN).finditer(text):
                if m.end() - m.start() >= LEAST_ACCESS if kind else len(m[2]) >= LEAST_ASSIGN:
                    out.setdefault(d, []).append((m.start(), kind, m.end()))
    for spans in out.values():
        spans.sort()
    return out


def candidates(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end (in the chunk) of each candidate."""
    s, e, _ = T.words(raw, off, _IS_TOKEN)
    place = np.arange(len(raw))
    other = raw != ord(".")
    # The first character from each place on, and the last up to it, that is no dot.
    first = np.minimum.accumulate(np.where(other, place, len(raw))[::-1])[::-1]
    last = np.maximum.accumulate(np.where(other, place, -1))
    if len(s):
        s, e = first[s], last[e - 1] + 1
    long = e - s >= CANDIDATE
    s, e = s[long], e[long]
    return np.searchsorted(off, s, "right") - 1, s, e


def windows(raw: np.ndarray, off: np.ndarray, doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over each candidate and ``BEFORE`` characters on both sides.

    The characters (0 beyond the document), where the candidate itself is, and the number
    of windows of each candidate, which lie together.
    """
    n = np.maximum(-(-(e - s + 2 * BEFORE - WIDTH) // STRIDE), 0) + 1
    own = np.repeat(np.arange(len(s)), n)
    turn = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    at = (s[own] - BEFORE + turn * STRIDE)[:, None] + np.arange(WIDTH)
    live = (at >= off[doc[own]][:, None]) & (at < np.minimum(off[doc[own] + 1], e[own] + BEFORE)[:, None])
    return np.where(live, raw[np.where(live, at, 0)] if len(raw) else 0, 0).astype(np.uint8), ((at >= s[own][:, None]) & (at < e[own][:, None])).astype(np.float32), n


def best_windows(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The window of the highest logit of each candidate."""
    own = np.repeat(np.arange(len(n)), n)
    return np.lexsort((z, own))[np.cumsum(n) - 1]


def resembling(raw: np.ndarray, off: np.ndarray, doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Which candidates may be secrets: random characters of two kinds at least, or a key word before or in them."""
    out = np.zeros(len(s), bool)
    for i, (d, a, b) in enumerate(zip(doc.tolist(), s.tolist(), e.tolist(), strict=True)):
        own = raw[a:b]
        _, n = np.unique(own, return_counts=True)
        kinds = ((own >= 48) & (own <= 57)).any(), ((own >= 97) & (own <= 122)).any(), ((own[1:] >= 65) & (own[1:] <= 90)).any()
        random = sum(kinds) > 1 and -(n / len(own) * np.log2(n / len(own))).sum() >= RANDOM_BITS
        out[i] = random or BESIDE.search(raw[max(int(off[d]), a - BEFORE) : b].tobytes()) is not None
    return out


def _symbols(x: np.ndarray, inside: np.ndarray) -> np.ndarray:
    return x + np.where(inside > 0, 256, 0)


class Cnn:
    """Embedding, one convolution, maximum over positions, one output; the maximum over a candidate's windows."""

    def __init__(self):
        rng = np.random.Generator(np.random.PCG64(13))
        d = KERNEL * (EMBED + 1)
        self.w = [rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), rng.normal(0, 1 / np.sqrt(d), (d, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, FILTERS).astype(np.float32), np.zeros(1, np.float32)]
        # Moments of Adam, and its steps.
        self.m, self.v, self.t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        self.a, self.b, self.threshold = 1.0, 0.0, 1.1

    def state(self) -> np.ndarray:
        """Weights and moments in one."""
        return np.concatenate([x.ravel() for x in (*self.w, *self.m, *self.v)])

    def at(self, state: np.ndarray, t: int) -> Cnn:
        """This network with other weights and moments."""
        out, k = Cnn(), 0
        for parts in (out.w, out.m, out.v):
            for i, x in enumerate(parts):
                parts[i], k = state[k : k + x.size].astype(np.float32).reshape(x.shape), k + x.size
        out.t = t
        return out

    def _tables(self) -> np.ndarray:
        """What each character (and 256 more: one within the candidate) adds to each filter at each place of the kernel."""
        w = self.w[1].reshape(KERNEL, EMBED + 1, FILTERS)
        own = self.w[0] @ w[:, :EMBED]
        return np.concatenate([own, own + w[:, EMBED:]], 1)

    def _forward(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m, tables = symbols.shape[1] - KERNEL + 1, self._tables()
        conv = tables[0].take(symbols[:, :m], 0)
        for k in range(1, KERNEL):
            conv += tables[k].take(symbols[:, k : k + m], 0)
        best = np.maximum(conv.max(1) + self.w[2], 0)
        return best @ self.w[3] + self.w[4][0], best, conv

    def logits(self, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(_symbols(x[i : i + STEP], inside[i : i + STEP]))[0] for i in range(0, len(x), STEP)]) if len(x) else np.zeros(0, np.float32)

    def tops(self, x: np.ndarray, inside: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The highest logit of each candidate."""
        z = self.logits(x, inside)
        return z[best_windows(z, n)] if len(n) else z

    def score(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * z + self.b, -30, 30)))

    def scores(self, x: np.ndarray, inside: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.score(self.tops(x, inside, n))

    def learn(self, x: np.ndarray, inside: np.ndarray, n: np.ndarray, y: np.ndarray, count: np.ndarray, weight: np.ndarray, order: np.ndarray) -> None:
        """Steps over some examples, of which there are ``count`` each, from the window of each that is highest before."""
        pick, several = np.cumsum(n) - n, n > 1
        if several.any():
            wide = np.flatnonzero(np.repeat(several, n))
            pick[several] = wide[best_windows(self.logits(x[wide], inside[wide]), n[several])]
        symbols = _symbols(x[pick], inside[pick])
        for at in range(0, len(order), STEP):
            pick = order[at : at + STEP]
            z, best, conv = self._forward(symbols[pick])
            share = (count[pick] / count[pick].sum()) * weight[pick]
            slope = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * share).astype(np.float32)
            back = slope[:, None] * self.w[3] * (best > 0)
            top = conv.argmax(1)[:, :, None] + np.arange(KERNEL)
            # What each filter's maximum saw: slopes of the tables, and of the weights behind them.
            seen = (np.arange(KERNEL) * 512 + symbols[pick][np.arange(len(pick))[:, None, None], top]) * FILTERS + np.arange(FILTERS)[:, None]
            g = np.bincount(seen.ravel(), np.repeat(back.ravel(), KERNEL), KERNEL * 512 * FILTERS).reshape(KERNEL, 2, 256, FILTERS)
            both = g.sum(1)
            g1 = np.concatenate([self.w[0].T @ both, g[:, 1].sum(1)[:, None]], 1).reshape(-1, FILTERS)
            g0 = np.einsum("kcf,kef->ce", both, self.w[1].reshape(KERNEL, EMBED + 1, FILTERS)[:, :EMBED], optimize=True)
            self.t += 1
            for k, g in enumerate((g0, g1, back.sum(0), best.T @ slope, np.array([slope.sum()]))):
                self.m[k], self.v[k] = (0.9 * self.m[k] + 0.1 * g).astype(np.float32), (0.999 * self.v[k] + 0.001 * g * g).astype(np.float32)
                self.w[k] -= (RATE * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


def examples(texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """What is learned from: the different findings (y 1) and negatives (0) of each chunk, and how often each is there.

    ``body`` is the candidate with its surroundings; it begins after ``lead`` bytes and has ``size``.
    """
    for _, _, raw, off in T.rows(texts):
        found = base_spans(raw, off)
        doc, s, e = candidates(raw, off)
        spans = [(d, int(off[d]) + a, int(off[d]) + b) for d, x in found.items() for a, _, b in x]
        fd, fs, fe = (np.array(c, np.int64) for c in (zip(*spans, strict=True) if spans else ([], [], [])))
        # The candidates in findings are positives too: as such the network meets them outside.
        hit = _overlaps(s, e, fs, fe)
        use = hit | ~resembling(raw, off, doc, s, e)
        doc, s, e, y = np.concatenate([doc[use], fd]), np.concatenate([s[use], fs]), np.concatenate([e[use], fe]), np.concatenate([hit[use].astype(int), np.ones(len(fs), int)])
        first, last = np.maximum(off[doc], s - BEFORE), np.minimum(off[doc + 1], e + BEFORE)
        data, counted = raw.tobytes(), {}
        for a, b, lead, size, one in zip(first.tolist(), last.tolist(), (s - first).tolist(), (e - s).tolist(), y.tolist(), strict=True):
            key = data[a:b], lead, size, one
            counted[key] = counted.get(key, 0) + 1
        h = [int.from_bytes(hashlib.blake2b(b"%d %d %d " % key[1:] + key[0], digest_size=8).digest(), "little", signed=True) for key in counted]
        columns = list(zip(*counted, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip([h, *columns, counted.values()], _EXAMPLES.types, strict=True)], schema=_EXAMPLES)


def _pieces(batches: Iterator[pa.RecordBatch], held: bool | None) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """A shard's number, and some of its examples that are held back, are not, or all (None), in their order; where pieces end doesn't follow from the batches."""
    shard, rows, size = None, [], 0

    def piece() -> tuple[int, dict[str, np.ndarray]]:
        _, body, lead, length, y, n = zip(*rows, strict=True)
        off = np.cumsum([0, *map(len, body)])
        s = off[:-1] + np.array(lead)
        x, inside, m = windows(np.frombuffer(b"".join(body), np.uint8), off, np.arange(len(rows)), s, s + np.array(length))
        return shard, {"y": np.array(y, float), "n": np.array(n), "x": x, "inside": inside, "windows": m}

    for batch in batches:
        if held is not None:
            batch = batch.filter(pa.array((batch.column(1).to_numpy() % 4 == 0) == held))
        at, lead, length, y, n = (batch.column(k).to_numpy().tolist() for k in (0, 3, 4, 5, 6))
        for row in zip(at, batch.column(2).to_pylist(), lead, length, y, n, strict=True):
            if rows and (row[0] != shard or len(rows) == SLICE or size >= T.CHUNK):
                yield piece()
                rows, size = [], 0
            shard, size = row[0], size + len(row[1])
            rows.append(row)
    if rows:
        yield piece()


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By shard, part and label: how many examples, repeats counted and not."""
    for batch in batches:
        shard, h, y, n = (batch.column(k) for k in (0, 1, 5, 6))
        held = pa.array((h.to_numpy() % 4 == 0).astype(np.int32))
        yield pa.RecordBatch.from_arrays([shard.cast(pa.int64()), held, y, n, pa.array(np.ones(len(n), np.int64))], schema=_TALLY)


def _only(piece: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    wide = np.repeat(which, piece["windows"])
    return {k: v[wide if k in ("x", "inside") else which] for k, v in piece.items()}


def _learn(model: Cnn, turn: int, split: bool, weigh: tuple[float, float]):
    """For each shard, what becomes of ``model`` in a pass over the shard."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, seen, k = None, None, 0, 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at]), pa.array([seen]), pa.array([own.t]), pa.array([own.state().tobytes()], pa.binary())], schema=_STATE)
        for shard, use in _pieces(batches, False if split else None):
            if shard != at:
                if seen:
                    yield done()
                at, own, seen, k = shard, model.at(model.state(), model.t), 0, 0
            # Positives without their surroundings as well, so that a key word is not all that is learned.
            bare, k = _only(use, use["y"] > 0), k + 1
            bare["x"] = np.where(bare["inside"] > 0, bare["x"], 0).astype(np.uint8)
            both = {c: np.concatenate([use[c], bare[c]]) for c in use}
            order = np.random.Generator(np.random.PCG64([17, turn, int(shard), k])).permutation(len(both["y"]))
            own.learn(both["x"], both["inside"], both["windows"], both["y"], both["n"], np.where(both["y"] > 0, weigh[1], weigh[0]), order)
            seen += int(use["n"].sum())
        if seen:
            yield done()

    return kernel


def _places(z: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the logits."""
    bits = (z.astype(np.float32) + np.float32(0)).view(np.int32).astype(np.int64)
    return np.where(bits < 0, -(bits & 0x7FFFFFFF) - 1, bits)


def _at_places(places: np.ndarray) -> np.ndarray:
    """The logits at places."""
    return np.where(places < 0, (-places - 1) | 0x80000000, places).astype(np.uint32).view(np.float32)


def _judge(model: Cnn, split: bool):
    """The places of the held examples' logits."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _pieces(batches, True if split else None):
            place = _places(model.tops(held["x"], held["inside"], held["windows"]))
            yield pa.RecordBatch.from_arrays([pa.array(held["y"].astype(np.int32)), pa.array(place), pa.array(held["n"])], schema=_LOGITS)

    return kernel


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places without their low bits."""
    for batch in batches:
        yield batch.set_column(1, _LOGITS.field("place"), pc.shift_right(batch.column(1), LOW_BITS))


def _within(one: int):
    """The findings at places within a range."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.and_(pc.equal(pc.shift_right(batch.column(1), LOW_BITS), one), pc.greater(batch.column(0), 0)))

    return kernel


def fitted(run: Callable) -> Cnn | None:
    """The network for examples; None where there is no finding or no other candidate.

    ``run(kernel, schema, keys)`` gives the rows of a kernel over all examples, where there are keys with the
    other columns summed up; without the argument ``keys``, what runs kernels over those rows.
    """
    tally = run(_tally, _TALLY, ("shard", "held", "y"))
    shard, held, y, n, rows = (tally.column(k).to_numpy() for k in _TALLY.names)
    split = all(n[(held == h) & (y == k)].sum() for h in (0, 1) for k in (0, 1))
    learned = (held == 0) | (not split)
    bad, good = (float(n[learned & (y == k)].sum()) for k in (0, 1))
    if not bad or not good:
        return None
    total = bad + 2 * good
    weigh = 0.5 * total / bad, 0.5 * total / (2 * good)
    model = Cnn()
    for turn in range(int(np.clip(-(-SEEN * len(np.unique(shard)) // int(rows[learned].sum())), *PASSES))):
        parts = run(_learn(model, turn, split, weigh), _STATE, ()).sort_by([("shard", "ascending"), ("n", "ascending"), ("state", "ascending")])
        states = np.stack([np.frombuffer(x, np.float32) for x in parts.column("state").to_pylist()])
        model = model.at(np.average(states.astype(float), 0, parts.column("n").to_numpy()), int(pc.max(parts.column("t")).as_py()))
    # Calibrated by the middles of ranges of logits; the threshold is an exact quantile.
    logits = run(_judge(model, split), _LOGITS)
    ranges = logits(_ranges, _LOGITS, ("y", "place"))
    y, place, n = (ranges.column(k).to_numpy() for k in _LOGITS.names)
    known, at = np.unique(place, return_inverse=True)
    counts = np.zeros((len(known), 2))
    np.add.at(counts, (at, y), n)
    z = _at_places((known << LOW_BITS) + (1 << LOW_BITS - 1)).astype(float)
    model.a, model.b = platt(z, counts)
    before = np.cumsum(counts[:, 1]) - counts[:, 1]
    rank = int((1 - RECALL) * counts[:, 1].sum())
    within = int(np.flatnonzero((before <= rank) & (counts[:, 1] > 0))[-1])
    exact = logits(_within(int(known[within])), _LOGITS, ("y", "place")).sort_by("place")
    k = int(np.searchsorted(np.cumsum(exact.column("n").to_numpy()), rank - before[within], "right"))
    model.threshold = float(model.score(_at_places(exact.column("place").to_numpy()[k : k + 1]))[0])
    return model


def _grouped(table: pa.Table, schema: pa.Schema, keys: tuple[str, ...]) -> pa.Table:
    """Rows of equal keys as one, the other columns summed up."""
    if not keys:
        return table
    others = [c for c in schema.names if c not in keys]
    sums = table.group_by(list(keys), use_threads=False).aggregate([(c, "sum") for c in others])
    return sums.rename_columns([c.removesuffix("_sum") for c in sums.column_names]).select(schema.names)


def train(texts: pa.Array) -> Cnn | None:
    """The network for a few texts, with one shard."""
    table = _grouped(pa.Table.from_batches(examples(texts), _EXAMPLES), _EXAMPLES, ("h", "body", "lead", "size", "y")).sort_by([(c, "ascending") for c in ("h", "body", "lead", "size", "y")])
    batches = table.add_column(0, "shard", pa.array(np.zeros(len(table), np.int64))).to_batches()
    return fitted(_over_batches(batches))


def _over_batches(batches: list[pa.RecordBatch]) -> Callable:
    """How :func:`fitted` runs a kernel over batches."""

    def run(kernel, schema: pa.Schema, keys: tuple[str, ...] | None = None):
        out = list(kernel(iter(batches)))
        return _over_batches(out) if keys is None else _grouped(pa.Table.from_batches(out, schema), schema, keys)

    return run


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from examples(batch.column(0))


def _dealt(rows: DataFrame) -> DataFrame:
    """(shard, h, body, lead, size, y, n): the different examples of all texts, each shard in one file and sorted."""
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    shards = min(SHARDS, max(1, round(chars / SHARD_CHARS)))
    made = rows.select("text").mapInArrow(_examples, "h long, body binary, lead int, size int, y int, n long")
    key = ["shard", "h", "body", "lead", "size", "y"]
    dealt = made.withColumn("shard", F.pmod(F.shiftright("h", 8), F.lit(shards).cast("long"))).repartition(shards, "shard")
    return dealt.groupBy(*key).agg(F.sum("n").alias("n")).sortWithinPartitions(*key)


def _over(table: DataFrame, tables: list[DataFrame]) -> Callable:
    """How :func:`fitted` runs a kernel over a written table; ``tables`` gets those that are written on the way, and it."""
    tables.append(table)

    def run(kernel, schema: pa.Schema, keys: tuple[str, ...] | None = None):
        kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
        out = table.mapInArrow(kernel, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))
        if keys is None:
            return _over(written(out, "secret-logits"), tables)
        if keys:
            out = out.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in schema.names if c not in keys)).select(*schema.names)
        return out.toArrow()

    return run


def _overlaps(s: np.ndarray, e: np.ndarray, fs: np.ndarray, fe: np.ndarray) -> np.ndarray:
    """Which of the ranges share a byte with a finding."""
    if not len(fs):
        return np.zeros(len(s), bool)
    order = np.argsort(fs)
    fs, fe = fs[order], np.maximum.accumulate(fe[order])
    k = np.searchsorted(fs, e, "left") - 1
    return (k >= 0) & (fe[np.maximum(k, 0)] > s)


def _scan(model: Cnn | None):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in T.rows(batch.column(1)):
                found = base_spans(raw, off)
                added: dict[int, list[tuple[int, int, int]]] = {}
                if model is not None:
                    doc, s, e = candidates(raw, off)
                    spans = [(int(off[d]) + a, int(off[d]) + b) for d, x in found.items() for a, _, b in x]
                    fs, fe = (np.array(c, np.int64) for c in (zip(*spans, strict=True) if spans else ([], [])))
                    free = ~_overlaps(s, e, fs, fe)
                    doc, s, e = doc[free], s[free], e[free]
                    parts = (slice(k, k + SLICE) for k in range(0, len(s), SLICE))
                    hit = np.concatenate([np.zeros(0, bool), *(model.scores(*windows(raw, off, doc[k], s[k], e[k])) >= model.threshold for k in parts)])
                    for d, a, b in zip(doc[hit].tolist(), s[hit].tolist(), e[hit].tolist(), strict=True):
                        added.setdefault(d, []).append((a - int(off[d]), 3, b - int(off[d])))
                counts, shas, texts = [], [], []
                char = np.zeros(len(raw) + 1, np.int64)
                if found or added:
                    np.cumsum((raw & 0xC0) != 0x80, out=char[1:])
                for d in range(j - i):
                    base, o = found.get(d, []), int(off[d])
                    named = lambda x, o=o: ",".join(f"{KINDS[k]}:{char[o + a] - char[o]}:{char[o + b] - char[o]}" for a, k, b in x)
                    own = named(base)
                    counts.append([sum(k == n for _, k, _ in base) for n in range(3)])
                    shas.append(hashlib.sha256(own.encode()).hexdigest())
                    texts.append(named(sorted(base + added[d])) if d in added else own)
                c = np.array(counts, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *(pa.array(c[:, k]) for k in range(3)), pa.array(shas, pa.string()), pa.array(texts, pa.string())], schema=_OUT)

    return kernel


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Offsets are code points, end exclusive; a span is the whole match.  A null text
    counts as empty and has no span.  Where no text has a finding, nothing is
    added to the base.  Other columns are not read.
    """
    ship_by_value()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tables: list[DataFrame] = []
    model = fitted(_over(written(_dealt(rows), "secret-examples"), tables))
    released(*tables)
    return rows.mapInArrow(_scan(model), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
