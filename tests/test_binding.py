"""Inheritance of properties in deep scene trees."""

from __future__ import annotations

import pytest

from terraloom.operators import binding


def test_inheritance_reaches_the_root(spark):
    nodes = spark.createDataFrame([(f"n{k}", f"n{k - 1}" if k else None) for k in range(41)] + [("lone", None), ("stray", "gone")], "node string, parent string")
    props = spark.createDataFrame([("n0", "site", "root", 0), ("n0", "name", "top", 1), ("n20", "name", "mid", 0), ("lone", "name", "l", 0)], "node string, key string, value string, ord int")
    chain = {(r.node, r.ancestor): r.distance for r in binding.ancestors(nodes).collect()}
    assert chain == {(f"n{k}", f"n{j}"): k - j for k in range(41) for j in range(k + 1)} | {(x, x): 0 for x in ("lone", "stray")}
    got = {(r.node, r.key): r.value for r in binding.inherited(nodes, props).collect()}
    assert got == {(f"n{k}", "site"): "root" for k in range(41)} | {(f"n{k}", "name"): "mid" if k >= 20 else "top" for k in range(41)} | {("lone", "name"): "l"}
    assert binding.ancestors(nodes, 3).where("distance > 3").isEmpty()


def test_cycle_of_parents_is_an_error(spark):
    nodes = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "node string, parent string")
    with pytest.raises(ValueError):
        binding.ancestors(nodes)
