"""What exact dedup, the n-gram join and the pipeline's stages hold on to."""

from __future__ import annotations

import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from terraloom.llm import exact_dedup, ngram_join


def test_blocks_of_a_batch_are_cut_in_small_chunks_and_sent_once(monkeypatch):
    monkeypatch.setattr(exact_dedup.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})()))
    texts = [f"{i} " + "word " * 1600 for i in range(900)] + ["a copy"] * 4
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    out = list(exact_dedup._to_blocks(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(r) for b in out for k, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if k == b"a copy"] == [4]
    assert len(out) == 1 and sum(len(r) for r in out[0].column(1).to_pylist()) == len(texts)
    assert peak < 40e6


def test_every_stage_has_the_executors_give_back_heap_first(spark, monkeypatch):
    told: list[str] = []

    class Reached(Exception):
        pass

    def reached(*_, **__):
        told.append("stage")
        raise Reached

    monkeypatch.setattr(corpus_pipeline, "spared", lambda s: told.append("spared"))
    for name in ("score_quality", "exact_dedup", "ngram_components", "decontaminate", "mix"):
        monkeypatch.setattr(corpus_pipeline, name, reached)
    docs = spark.range(1)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Exception) as why:
            stage(type("S", (), {"read": type("R", (), {"parquet": staticmethod(lambda p: None)})})(), docs, "none")
        assert why.type is Reached
    assert told == ["spared", "stage"] * len(corpus_pipeline.STAGES)


def test_executors_run_their_collector(spark):
    from terraloom.llm.runtime import spared

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    count = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = count()
    spared(spark)
    assert count() > before


def test_ngram_tables_that_are_done_are_dropped(spark):
    top = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before, tables = set(top.glob("terraloom-*")), spark.catalog.listTables()
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join([*words[: 38 + i % 3], f"own{i % 5}"])) for i in range(12)] + [(90, "apart from all of the others it is")], "doc_id long, text string")
    out = ngram_join.ngram_components(docs)
    left = {p.name.removeprefix("terraloom-").rsplit("-", 1)[0] for p in set(top.glob("terraloom-*")) - before}
    assert not left & {"blocks", "tree-links", "shared-tokens", "centres", "centre-blocks", "centre-links", "near-blocks", "near-links"}
    assert spark.catalog.listTables() == tables
    assert {r.doc_id: r.component_id for r in out.collect()} == {**dict.fromkeys(range(12), 0), 90: 90}


def test_sets_go_to_their_blocks_from_the_texts(monkeypatch):
    """Each place that names the class of its text gets the set at once, in parts of bounded size; other places get none."""
    monkeypatch.setattr(ngram_join, "HELD", 40)
    texts = ["a b c d e f g", "", "h i j k l m n o", "too few"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    tokens, soff = ngram_join.shingle_sets(raw, off)
    cls = ngram_join.classes_of(tokens, soff).view(np.int64).tolist()
    places = [[(k, k % 3, c, 7) for k in range(20)] + [(99, 0, c + 1, 7)] for c in cls]
    places[1] = []
    kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("key", "salt", "cls", "comp")]))
    column = pa.array([[dict(zip(("key", "salt", "cls", "comp"), p, strict=True)) for p in ps] for ps in places], kind)
    batch = pa.RecordBatch.from_arrays([column, pa.array(texts)], names=["places", "text"])
    out = list(ngram_join._set_rows(iter([batch.slice(1), batch.slice(0, 1)])))
    assert max(sum(map(len, b.column(4).to_pylist())) for b in out) <= 8 * 40
    got = sorted((r["key"], r["salt"], r["cls"], r["comp"], r["tokens"]) for b in out for r in b.to_pylist())
    assert got == sorted((*p, tokens[soff[d] : soff[d + 1]].tobytes()) for d, ps in enumerate(places) for p in ps if p[2] == cls[d])
