"""Held-out rows and bounded, deterministic samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sampled_ids(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hash of doc_id: a sample that reruns agree on."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def sampled_texts(rows: DataFrame, ids: DataFrame, most_rows: int, most_chars: int) -> DataFrame:
    """The texts of at most ``most_rows`` rows (doc_id, text) with the sampled ids, each different row once.

    Of a text over ``most_chars`` characters an excerpt of that length is taken, at a place that
    follows from its hash; so what is collected is bounded, and no length is left out.
    """
    place = F.pmod(F.xxhash64("doc_id", "text"), F.greatest(F.length("text") - most_chars + 1, F.lit(1)))
    found = rows.where("text IS NOT NULL").join(F.broadcast(ids), "doc_id")
    cut = found.withColumn("mark", F.xxhash64("doc_id", "text")).withColumn("text", F.substring("text", (place + 1).cast("int"), F.lit(most_chars)))
    return cut.dropDuplicates(["doc_id", "mark"]).orderBy("mark", "doc_id").limit(most_rows).orderBy("doc_id", "mark").drop("mark")
