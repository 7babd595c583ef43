"""How the operators of this subpackage use the cluster: shared folder, kernels, chunking."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only in local mode, as in tests, a folder beside the warehouse stands in for a missing setting.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return at or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_terraloom"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again.

    The written table outlives lost executors, unlike a cache.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/terraloom-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, name: str, **options: str) -> DataFrame:
    """As :func:`written`, in one file for each shuffle partition of ``key``, so that a later grouping by it moves no row."""
    spark, n = df.sparkSession, partitions(df.sparkSession)
    table = f"terraloom_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    at = f"{shared_dir(spark)}/{table.replace('_', '-')}"
    df.repartition(n, key).write.format("parquet").options(path=at, **options).bucketBy(n, key).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # from the catalog only: the files stay
    return out


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` once no plan needs them."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def released(*tables: DataFrame) -> None:
    """Delete written tables that no plan needs any more, and let Spark's cleaner find the shuffles of plans that are done."""
    for df in tables:
        drop_written(df)
    swept(tables[0].sparkSession)


def swept(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffles of plans that are done."""
    spark.sparkContext._jvm.System.gc()


def spared(spark: SparkSession) -> None:
    """Let the executors give back the heap that earlier plans have grown, for Python workers share their memory.

    A task for each core, so that every idle executor gets one; it runs no other code than the JVM's collector.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')").alias("x")).write.format("noop").mode("overwrite").save()


def ship_by_value() -> None:
    """Pickle this subpackage's functions by value, so executors need no copy of it on their path."""
    for name, module in list(sys.modules.items()):
        if name.startswith(__package__ + ".") or name == __package__:
            cloudpickle.register_pickle_by_value(module)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the one knob that follows the size of the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
