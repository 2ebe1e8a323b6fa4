"""Folders that the driver and all executors share, and row numbers over whole tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Rows that a task of a shuffle sorts, about.
TASK_ROWS = 250_000


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="loreweave-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own where it is unset, as in tests on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (folder or _own_folder()).rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path, removed when the driver program ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def end() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session has ended: the cluster's own retention applies
            pass

    atexit.register(end)
    return path


def tasks_of(spark: SparkSession, n: int) -> int | None:
    """Tasks among which n rows are dealt so that none has many more than TASK_ROWS; None where the session's shuffle has as many."""
    tasks = -(-n // TASK_ROWS)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def numbered(df: DataFrame, *order: str, add: str | None = None) -> DataFrame:
    """Adds `row_no` (from 0) in an order without ties: each range of rows is numbered in its own task, and the ranges' sizes are added up.

    With `add` also `before`, the sum of that column over the rows before. The numbered ranges are written once: dealt again, rows would
    fall into other ranges, as these come from a sample.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "numbered")
    made = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    made.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(made.schema).parquet(path).withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sizes = rows.groupBy("_part").agg(F.count("*").alias("count"), (F.sum(add) if add else F.lit(0)).alias("_sum"))
    sizes = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_added"))
    out = rows.join(F.broadcast(sizes), "_part")  # as many rows as there are ranges
    number = (F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).alias("row_no")
    if add is None:
        return out.select(*df.columns, number)
    inner = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)  # a range is one task's rows
    return out.select(*df.columns, number, (F.coalesce(F.sum(add).over(inner), F.lit(0)) + F.col("_added")).alias("before"))
