"""Row filters by a table of ids, for pipeline stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import written

BROADCAST_ROWS = 1 << 20


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in ``ids`` (one column); rows without an id stay.

    The ids are counted: up to ``BROADCAST_ROWS`` they are broadcast, so that no text is
    shuffled; beyond, both sides are.
    """
    ids = written(ids.toDF("__id").where("__id IS NOT NULL").distinct(), "dropped-ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return docs.join(ids, F.col(id_col) == F.col("__id"), "left_anti")
