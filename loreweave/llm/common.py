"""Shared pieces: tables in the cluster's shared folder, and distributed running totals."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Rows up to which a table of group totals is sent to every executor; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied Parquet tables, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one where it is unset (single-machine tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = getattr(shared_folder, "own", None)
        if folder is None:
            folder = shared_folder.own = "file://" + tempfile.mkdtemp(prefix="loreweave-")
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Workspace:
    """Tables of one job under the shared folder. They cut lineage and survive lost executors.

    A result may still read them when the operator has returned, so they go when the driver
    program ends; drop() removes those that no later step reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/loreweave-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def _end(self) -> None:
        try:
            _remove(self.spark, self.root)
        except Exception:  # the session has ended: the cluster's own retention applies
            pass

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as Parquet and returns the written table."""
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            _remove(self.spark, f"{self.root}/{name}")

    def release(self) -> None:
        """Lets Spark's cleaner remove shuffle files of steps whose results are written."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def numbered(df: DataFrame, order: list[str], ws: Workspace, name: str) -> DataFrame:
    """Adds `rank` (long): the place of each row in `order` over the whole table, from 0; built-in functions only.

    A range partition numbers its own rows, and adds the rows of the partitions before it.
    """
    from pyspark.sql import Window

    t = ws.write(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), name)
    t = t.withColumn("_part", F.shiftright("_id", 33))
    sizes = ws.write(t.groupBy("_part").count(), f"{name}-sizes")
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_offset"))
    if sizes.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return t.join(offsets, "_part").select(*df.columns, (F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_offset")).alias("rank"))


def with_ranks(df: DataFrame, group: str, order: list[str], value: str, ws: Workspace, name: str) -> DataFrame:
    """Adds `before` (long): the sum of `value` over the group's rows that come earlier in `order`.

    Rows are range-partitioned by (group, order), so a hot group spreads over many tasks; each task
    adds up its own part, and the parts' totals (one row per task and group it holds) are summed by a
    window. Null groups form a group of their own and sort first; equal orders keep any order.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])
    arrow = [f.name for f in df.schema.fields]
    at, by = arrow.index(value), arrow.index(group)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, total = TaskContext.get().partitionId(), object(), 0
        for b in batches:
            v = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = b.column(by)
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            sums = np.concatenate([[0], np.cumsum(v)])
            starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(v) else np.array([], int)
            out = np.empty(len(v), np.int64)
            for a, z in zip(starts, [*starts[1:], len(v)]):
                key = keys[int(a)].as_py()
                base = total if a == 0 and key == last else 0
                out[a:z] = base + sums[a:z] - sums[a]
                last, total = key, base + int(sums[z] - sums[a])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(v), part, np.int32)), pa.array(out)], names=[*arrow, "_part", "_local"])

    ranged = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).mapInArrow(local, schema)
    t = ws.write(ranged, name)
    totals = t.groupBy(F.col("_part").alias("_p"), F.col(group).alias("_g")).agg(F.sum(value).alias("_sum"))
    totals = ws.write(totals, f"{name}-totals")
    from pyspark.sql import Window

    w = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_p", "_g", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_offset"))
    if totals.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    joined = t.join(offsets, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")), "left")
    return joined.select(*arrow, (F.col("_local") + F.col("_offset")).cast("long").alias("before"))
