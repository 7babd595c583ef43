"""The run index against plain comparison, and the work of building it."""

from __future__ import annotations

import numpy as np
import pytest

from terraloom.llm.run_index import RunIndex


def _joined(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


@pytest.mark.parametrize("window", [2, 5, 8, 50])
def test_least_of_each_window(window):
    rng = np.random.default_rng(window)
    base = bytes(rng.integers(0, 256, 400).astype(np.uint8)) + bytes(200) + b"\xff" * 150
    texts = [base[a : a + int(rng.integers(0, 300))] for a in rng.integers(0, 700, 40)] + [b"", b"a", b"a"]
    value = rng.permutation(len(texts)).astype(np.int64)
    want = {}
    for t, v in zip(texts, value.tolist(), strict=True):
        for i in range(len(t) - window + 1):
            w = t[i : i + window]
            want[w] = min(want.get(w, v), v)
    got = {(int(a), int(b)): int(c) for x in RunIndex(*_joined(texts), value, window).stream() for a, b, c in zip(*x, strict=True)}
    assert got == {(k, i): want[t[i : i + window]] for k, t in enumerate(texts) for i in range(len(t) - window + 1)}


def test_settled_suffixes_are_not_sorted_again(monkeypatch):
    """Only the suffixes of a long repeat need the later rounds."""
    rng = np.random.default_rng(1)
    repeat = bytes(rng.integers(97, 123, 2000).astype(np.uint8))
    texts = [bytes(rng.integers(97, 123, 10_000).astype(np.uint8)) for _ in range(4)] + [b"x" + repeat, b"y" + repeat]
    sizes, plain = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, **k: sizes.append(len(a)) or plain(a, **k))
    index = RunIndex(*_joined(texts), np.arange(6))
    monkeypatch.undo()
    assert sum(sizes) < 4 * index.n
