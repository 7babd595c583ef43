"""Toxic spans by a linear-chain conditional random field.

Labels are given for documents only, so token labels are derived first: in the
training documents a word is marked where it occurs in toxic documents far more often
than elsewhere, by a lower confidence bound.  Those labelled tokens train a two-tag
chain (clean, toxic) whose features are the word, its neighbours and its stem; the
weights and the transitions minimise the negative log likelihood.  Scoring runs the
forward-backward recursion over every text, and the marginals of a document give its
score and, where a token's marginal reaches ``SPAN``, the offending offsets.

Training takes at most ``SAMPLE`` toxic and twice as many other labelled documents, each
of at most ``SAMPLE_CHARS`` characters; scoring covers every word of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .labels import held_out, sampled_ids, sampled_texts
from .quality import platt
from .runtime import ship_by_value

SAMPLE, SAMPLE_CHARS = 2000, 20_000
THRESHOLD, SPAN, SUSPECT = 0.5, 0.5, 0.05
LENGTH = 64
EPOCHS, STEPS, RATE = 12, 60, 0.3

_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def tokens(raw: np.ndarray, off: np.ndarray):
    s, e, doff = T.words(raw, off, T.IS_ALNUM)
    return s, e, doff, T.word_hashes(raw, s, e, T.BYTE_CODE[T.LOWER])


def stems(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of the first five bytes of longer words; 0 for others."""
    h = T.word_hashes(raw, s, np.minimum(e, s + 5), T.BYTE_CODE[T.LOWER]) ^ np.uint64(0x5BD1E995)
    return np.where(e - s > 5, h, np.uint64(0))


class Table:
    """Weights of hashed symbols: sorted keys behind a bitmap that rejects most words at once."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[self.keys >> np.uint64(64 - self.BITS)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each symbol, or -1."""
        out = np.full(len(h), -1, np.int64)
        if len(self.keys):
            maybe = np.flatnonzero(self.seen[h >> np.uint64(64 - self.BITS)])
            at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == h[maybe], at, -1)
        return out


def neighbours(rows: np.ndarray, doff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the previous and the next word of the same document."""
    before, after = np.full(len(rows), -1, np.int64), np.full(len(rows), -1, np.int64)
    before[1:], after[:-1] = rows[:-1], rows[1:]
    inner = doff[:-1][doff[1:] > doff[:-1]]
    before[inner] = -1
    after[doff[1:][doff[1:] > doff[:-1]] - 1] = -1
    return before, after


def segments(doff: np.ndarray) -> np.ndarray:
    """First token of each chain: a document is cut into chains of ``LENGTH`` tokens."""
    n = np.diff(doff)
    parts = -(-n // LENGTH)
    first = np.repeat(doff[:-1], parts)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return first + nth * LENGTH


def marginals(emit: np.ndarray, size: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over padded chains (n, L) of log odds for the toxic tag.

    Returns the toxic marginals, the expected counts of the transitions (n, 2, 2) and
    log Z.  The chain starts in either tag at no cost.
    """
    n, length = emit.shape
    w = np.exp(trans)
    fac = np.exp(np.clip(emit, -40, 40))
    alpha, scale = np.zeros((n, length, 2)), np.ones((n, length))
    a = np.ones((n, 2))
    for t in range(length):
        if t:
            a = a @ w
        a = a * np.stack([np.ones(n), fac[:, t]], 1)
        z = a.sum(1)
        live = t < size
        scale[:, t] = np.where(live, z, 1)
        a = a / z[:, None]
        alpha[:, t] = a
    beta = np.ones((n, length, 2))
    b = np.ones((n, 2))
    pair = np.zeros((n, 2, 2))
    for t in range(length - 2, -1, -1):
        live = (t + 1 < size)[:, None]
        step = np.stack([np.ones(n), fac[:, t + 1]], 1) * b / scale[:, t + 1][:, None]
        joint = alpha[:, t][:, :, None] * w[None] * step[:, None, :]
        pair += np.where(live[:, :, None], joint, 0)
        b = np.where(live, step @ w.T, 1.0)
        beta[:, t] = b
    p = alpha * beta
    p = p[:, :, 1] / np.maximum(p.sum(2), 1e-300)
    return p, pair, np.log(scale).sum(1)


class Crf:
    """Weights by feature family (word, previous, next, stem), a bias and the transitions."""

    def __init__(self, words: np.ndarray, stem_keys: np.ndarray):
        self.words, self.stems = Table(words), Table(stem_keys)
        n, m = len(self.words.keys), len(self.stems.keys)
        self.own, self.before, self.after, self.stem = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1), np.zeros(m + 1)
        self.bias, self.trans = -4.0, np.zeros((2, 2))
        self.a, self.b = 1.0, 0.0

    def rows(self, raw, s, e, doff, h):
        w = self.words.find(h)
        before, after = neighbours(w, doff)
        return w, before, after, self.stems.find(stems(raw, s, e))

    def emit(self, f) -> np.ndarray:
        """Log odds of the toxic tag; row -1 is the last weight, which stays 0."""
        return self.bias + self.own[f[0]] + self.before[f[1]] + self.after[f[2]] + self.stem[f[3]]

    def padded(self, emit: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = first[:, None] + np.arange(LENGTH)
        live = np.arange(LENGTH) < size[:, None]
        return np.where(live, emit[np.where(live, at, 0)] if len(emit) else 0.0, 0.0), live

    def fit(self, f, y: np.ndarray, first: np.ndarray, size: np.ndarray) -> Crf:
        """AdaGrad on the negative log likelihood of the labelled chains."""
        rng = np.random.Generator(np.random.PCG64(5))
        families = [self.own, self.before, self.after, self.stem]
        past = [np.full(len(w), 1e-6) for w in families]
        past_bias, past_trans = 1e-6, np.full((2, 2), 1e-6)
        # A small sample has few batches, so it is gone through more often.
        for _ in range(max(EPOCHS, STEPS * 1024 // max(len(first), 1024))):
            order = rng.permutation(len(first))
            for at in range(0, len(order), 1024):
                pick = order[at : at + 1024]
                live = np.arange(LENGTH) < size[pick][:, None]
                token = (first[pick][:, None] + np.arange(LENGTH))[live]
                emit = np.zeros(live.shape)
                emit[live] = self.emit([x[token] for x in f])
                p, pair, _ = marginals(emit, size[pick], self.trans)
                slope = p[live] - y[token]
                seen = np.zeros((2, 2))
                inner = live[:, 1:]
                left = y[np.where(live, first[pick][:, None] + np.arange(LENGTH), 0)]
                np.add.at(seen, (left[:, :-1][inner], left[:, 1:][inner]), 1)
                for w, past_w, rows in zip(families, past, f, strict=True):
                    g = np.bincount(rows[token] % len(w), weights=slope, minlength=len(w)) / len(pick) + 1e-5 * w
                    g[-1] = 0
                    past_w += g * g
                    w -= RATE * g / np.sqrt(past_w) * (g != 0)
                g = slope.sum() / len(pick)
                past_bias += g * g
                self.bias -= RATE * g / np.sqrt(past_bias)
                g = (pair.sum(0) - seen) / len(pick)
                past_trans += g * g
                self.trans -= 0.1 * RATE * g / np.sqrt(past_trans)
        return self

    def pruned(self) -> Crf:
        """Without the symbols whose weights are all negligible, so that scoring rejects most words at once."""
        for table, fam in ((self.words, ("own", "before", "after")), (self.stems, ("stem",))):
            keep = np.zeros(len(table.keys), bool)
            for x in fam:
                keep |= np.abs(getattr(self, x)[:-1]) > 0.05
            for x in fam:
                setattr(self, x, np.append(getattr(self, x)[:-1][keep], 0.0))
            table.__init__(table.keys[keep])
        return self

    def token_marginals(self, raw, s, e, doff, h) -> np.ndarray:
        f = self.rows(raw, s, e, doff, h)
        emit = self.emit(f)
        first = segments(doff)
        if not len(first):
            return np.zeros(0)
        doc = np.searchsorted(doff, first, "right") - 1
        size = np.minimum(LENGTH, doff[doc + 1] - first)
        # Chains without any known symbol differ by their length alone.
        known = np.abs(emit - self.bias) > 0
        run = np.zeros(len(emit) + 1, np.int64)
        np.cumsum(known, out=run[1:])
        plain = run[first + size] == run[first]
        flat, _, _ = marginals(np.where(np.arange(LENGTH) < np.arange(1, LENGTH + 1)[:, None], self.bias, 0.0), np.arange(1, LENGTH + 1), self.trans)
        out = np.zeros(len(emit))
        for at in range(0, len(first), 4096):
            part = slice(at, at + 4096)
            p = flat[size[part] - 1]
            busy = np.flatnonzero(~plain[part])
            if len(busy):
                own, _ = self.padded(emit, first[part][busy], size[part][busy])
                p[busy] = marginals(own, size[part][busy], self.trans)[0]
            live = np.arange(LENGTH) < size[part][:, None]
            out[(first[part][:, None] + np.arange(LENGTH))[live]] = p[live]
        return out

    @staticmethod
    def document_evidence(p: np.ndarray, doff: np.ndarray) -> np.ndarray:
        """Log of the summed odds of the suspicious tokens, or of the most toxic one if none is.

        Only tokens of at least ``SUSPECT`` are summed, so that the sum does not grow with
        the length of a clean text.  A text without tokens gets the floor.
        """
        odds = np.full(len(doff) - 1, -20.0)
        full = doff[1:] > doff[:-1]
        if full.any():
            q = np.clip(p, 2e-9, 1 - 2e-9)
            q = q / (1 - q)
            top = np.maximum.reduceat(q, doff[:-1][full])
            some = np.add.reduceat(np.where(p >= SUSPECT, q, 0.0), doff[:-1][full])
            odds[full] = np.log(np.maximum(top, some))
        return odds

    def scores(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * z + self.b, -30, 30)))


def token_labels(h: np.ndarray, doff: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words whose documents are toxic by a lower confidence bound; the mark of each token in toxic documents."""
    doc = np.repeat(np.arange(len(doff) - 1), np.diff(doff))
    order = np.lexsort((doc, h))
    hs, ds = h[order], doc[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    hs, ds = hs[new], ds[new]
    keys, at = np.unique(hs, return_inverse=True)
    n = np.bincount(at, minlength=len(keys)).astype(float)
    k = np.bincount(at, weights=toxic[ds], minlength=len(keys))
    rate, z = k / np.maximum(n, 1), 2.6
    low = (rate + z * z / (2 * n) - z * np.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    marked = keys[(low > max(0.5, 1.5 * toxic.mean())) & (k >= 4)]
    return marked, (np.isin(h, marked) & (toxic[doc] > 0)).astype(np.int64)


def train(texts: pa.Array, toxic: np.ndarray) -> Crf | None:
    """None where the sample has no toxic or no clean document."""
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    parts, base = [], 0
    for _, _, raw, off in T.rows(texts):
        s, e, doff, h = tokens(raw, off)
        parts.append((h, stems(raw, s, e), doff[1:] + base))
        base += len(h)
    h, stem = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    doff = np.concatenate([[0], *(p[2] for p in parts)]).astype(np.int64)
    _, y = token_labels(h, doff, toxic)
    # Symbols that are seen often enough to be learned, and the marked tokens; their rare neighbours would only be learned by heart.
    near = np.flatnonzero(y)
    keys, count = np.unique(h, return_counts=True)
    model = Crf(np.concatenate([keys[count >= 30], h[near]]), stem[near][stem[near] > 0])
    w = model.words.find(h)
    f = (w, *neighbours(w, doff), model.stems.find(stem))
    first = segments(doff)
    doc = np.searchsorted(doff, first, "right") - 1
    size = np.minimum(LENGTH, doff[doc + 1] - first)
    run = np.concatenate([[0], np.cumsum(y)])
    has = run[first + size] > run[first]
    clean = np.flatnonzero(~has)
    rng = np.random.Generator(np.random.PCG64(3))
    pick = np.concatenate([np.flatnonzero(has), rng.permutation(clean)[: max(2000, 4 * int(has.sum()))]])
    model.fit(f, y, first[pick], size[pick]).pruned()
    z = []
    for _, _, raw, off in T.rows(texts):
        s, e, doff, h = tokens(raw, off)
        z.append(model.document_evidence(model.token_marginals(raw, s, e, doff, h), doff))
    model.a, model.b = platt(np.concatenate(z), toxic.astype(float))
    return model


def _score_rows(model: Crf | None):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in T.rows(batch.column(1)):
                spans: list[list] = [[] for _ in range(j - i)]
                if model is None:
                    score = np.zeros(j - i)
                else:
                    s, e, doff, h = tokens(raw, off)
                    p = model.token_marginals(raw, s, e, doff, h)
                    score = model.scores(model.document_evidence(p, doff))
                    hot = np.flatnonzero(p >= SPAN)
                    if len(hot):
                        char = np.zeros(len(raw) + 1, np.int64)
                        np.cumsum((raw & 0xC0) != 0x80, out=char[1:])
                        docs = np.searchsorted(doff, hot, "right") - 1
                        from_ = char[s[hot]] - char[off[docs]]
                        to = char[e[hot]] - char[off[docs]]
                        for d, a, b in zip(docs.tolist(), from_.tolist(), to.tolist(), strict=True):
                            spans[d].append({"start": a, "end": b})
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(score), pa.array(spans, _OUT.field(2).type)], schema=_OUT)

    return kernel


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted (1 if score >= ``THRESHOLD``), spans.

    Spans are code-point offsets, end exclusive.  A null or empty text has no tokens
    and the lowest score.  Null labels and labels of held-out ids are not used; of an
    id labelled twice the larger label holds.  Without both labels every score is 0.
    Other columns are not read.
    """
    ship_by_value()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))
    usable = known.where(~held_out())
    usable = usable.join(rows.select("doc_id"), "doc_id", "left_semi")
    picked = sampled_ids(usable.where("y = 1"), SAMPLE).unionByName(sampled_ids(usable.where("y = 0"), 2 * SAMPLE))
    sample = sampled_texts(rows, picked, 3 * SAMPLE, SAMPLE_CHARS).select("text", "y").toArrow()
    model = train(sample.column("text").combine_chunks(), sample.column("y").to_numpy().astype(np.int64))
    scored = rows.mapInArrow(_score_rows(model), "doc_id long, score double, spans array<struct<start:int,end:int>>")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
