"""Cutting a plan that is about to be used many times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder of spark.checkpoint.dir (or beside the warehouse, in local mode alone) and read again."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    top = top or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_terraloom"
    path = f"{top}/terraloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
