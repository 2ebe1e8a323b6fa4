"""The run history: an append-only table with a row per event of a run or of a dump refresh."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..shared import numbered


def latest_dump_date(history: DataFrame, service: str, status: str = schemas.DUMP_LINK_UPDATED) -> DataFrame:
    """dump_date of the newest row (null times first); null if that row has none or an empty one, even if older rows have one."""
    rows = history.filter((F.col("service_name") == service) & (F.col("status") == status)).orderBy(F.col("timestamp").desc_nulls_first()).limit(1)
    return rows.select(F.nullif(F.get_json_object("metadata", "$.dump_date"), F.lit("")).alias("dump_date"))


def newest_first(history: DataFrame) -> DataFrame:
    return history.orderBy(F.col("id").desc())


def run_exists(history: DataFrame, run_id: int) -> DataFrame:
    return history.filter(F.col("run_id") == run_id).limit(1)


def batch_averages(ticks: DataFrame, interval: int, order: str, value: str) -> DataFrame:
    """Means of each `interval` consecutive ticks; a last partial group gives none."""
    grouped = numbered(ticks, order).groupBy(F.expr(f"row_no div {interval}").cast("long").alias("batch_group"))
    return grouped.agg(F.avg(value).alias("average"), F.count("*").alias("_n")).filter(F.col("_n") == interval).drop("_n")


def run_fingerprint(files: list[str]) -> int:
    """31 bits of a hash over name, size and time of the sorted files: the same files resume the same run."""
    h = hashlib.sha256()
    for f in sorted(files):
        s = os.stat(f)
        h.update(f"{os.path.basename(f)}{s.st_size}{s.st_mtime_ns}".encode())
    return int.from_bytes(h.digest()[:4], "big") & 0x7FFFFFFF


class RunHistory:
    """The table in a shared folder; ids grow with time."""

    def __init__(self, spark: SparkSession, folder: str, clock=dt.datetime.now):
        self.spark, self.folder, self.clock = spark, folder, clock

    def append(self, run_id: int | None, service: str, status: str, metadata: dict | None = None) -> None:
        now = self.clock()
        row = (int(now.timestamp() * 1e6), run_id, service, status, json.dumps(metadata), now)
        self.spark.createDataFrame([row], schemas.HISTORY).coalesce(1).write.mode("append").parquet(self.folder)

    def read(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schemas.HISTORY)
        return self.spark.read.schema(schemas.HISTORY).parquet(self.folder)
