"""What the network of the secret scan is learned from."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from terraloom.llm import secrets
from terraloom.llm.quality import platt


def learned(monkeypatch, df):
    seen = []
    scan = secrets._scan
    monkeypatch.setattr(secrets, "_scan", lambda model: seen.append(model) or scan(model))
    secrets.scan_secrets(df)
    return seen[-1]


def hexes(rng):
    return "".join(rng.choice("0123456789abcdef") for _ in range(24))


def test_findings_of_every_document_are_learned(spark, monkeypatch):
    """Findings only in the last of 6,400 documents by the hash that a sample would go by."""
    rng = random.Random(3)
    ids = [r.id for r in spark.range(6400).orderBy(F.xxhash64("id"), "id").collect()]
    rows = [(i, f"an extraordinarily plain text of number {i % 50}") for i in ids[:-60]] + [(i, f"see {hexes(rng)} there") for i in ids[-60:]]
    model = learned(monkeypatch, spark.createDataFrame(rows, "doc_id long, text string"))
    assert model is not None and 0 < model.threshold <= 1


def test_training_follows_neither_layout_nor_place(spark, monkeypatch):
    """A finding behind the first 20,000 characters; the same network over partitions and over one array; an exact threshold."""
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(9, 18))) for _ in range(8)) for _ in range(60)]
    texts += [("word " * 6000 if i % 2 else "") + f"token={hexes(rng)}zZ " + "an " * i for i in range(60)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    model, other = learned(monkeypatch, df), secrets.train(pa.array(texts))
    assert all(np.array_equal(a, b) for a, b in zip(model.w, other.w, strict=True)) and model.threshold == other.threshold
    found = {(r["h"], r["body"], r["lead"], r["size"], r["y"]): r["n"] for b in secrets.examples(pa.array(texts)) for r in b.to_pylist()}
    assert sum(n for k, n in found.items() if k[-1]) >= 60
    z = []
    for (h, body, lead, size, y), n in found.items():
        if h % 4 == 0 and y:
            x = secrets.windows(np.frombuffer(body, np.uint8), np.array([0, len(body)]), np.array([0]), np.array([lead]), np.array([lead + size]))
            z += [model.tops(*x)[0]] * n
    z = np.sort(np.array(z, np.float32))
    assert abs(model.threshold - float(model.score(z)[int((1 - secrets.RECALL) * len(z))])) < 1e-5
    places = secrets._places(z)
    assert np.array_equal(secrets._at_places(places), z) and (np.diff(places) >= 0).all()


def test_calibration_by_counts_is_that_of_repeats():
    rng = np.random.Generator(np.random.PCG64(1))
    z, counts = rng.normal(0, 2, 30), rng.integers(0, 5, (30, 2))
    repeats = platt(np.concatenate([np.repeat(z, counts[:, k]) for k in (0, 1)]), np.repeat([0.0, 1.0], counts.sum(0)))
    assert np.allclose(platt(z, counts), repeats)
