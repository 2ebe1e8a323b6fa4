"""Multistream indexes: discovery, pairing with dumps, lines and byte ranges."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .multistream import IndexSource

INDEX_NAME = r"^(.+)-index(\d*)\.txt\.bz2$"


def is_index(name: Column) -> Column:
    """The whole name must match, so side files of a download do not."""
    return name.rlike(INDEX_NAME)


def dump_name(index_name: Column) -> Column:
    return F.concat(F.regexp_extract(index_name, INDEX_NAME, 1), F.regexp_extract(index_name, INDEX_NAME, 2), F.lit(".xml.bz2"))


def listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, name, length, modified of the folder's files, contents unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def pair_dumps(indexes: DataFrame, dumps: DataFrame) -> DataFrame:
    """Each index with its dump beside it; an index without a dump goes."""
    own = indexes.filter(is_index(F.col("name"))).withColumn("dump", F.concat(F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), dump_name(F.col("name"))))
    return own.join(dumps.select(F.col("path").alias("dump"), F.col("length").alias("dump_length")), "dump")


def discover(spark: SparkSession, folder: str) -> DataFrame:
    return pair_dumps(listing(spark, folder, "*.txt.bz2"), listing(spark, folder, "*.xml.bz2")).orderBy("path")


def unpaired(spark: SparkSession, folder: str) -> DataFrame:
    """Indexes without a dump, to be reported."""
    dumps = listing(spark, folder, "*.xml.bz2").select(F.col("path").alias("dump"))
    own = listing(spark, folder, "*.txt.bz2").filter(is_index(F.col("name"))).withColumn("dump", F.concat(F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), dump_name(F.col("name"))))
    return own.join(dumps, "dump", "left_anti")


def parse_lines(lines: DataFrame) -> DataFrame:
    """offset, pid, title of lines(value, ...); a line needs two colons and a number first. A title may hold colons."""
    part = F.split(F.trim("value"), ":", 3)
    parsed = lines.withColumn("_p", part).filter(F.size("_p") == 3)
    parsed = parsed.withColumn("offset", F.expr("try_cast(_p[0] AS BIGINT)")).withColumn("pid", F.expr("try_cast(_p[1] AS INT)")).withColumn("title", F.col("_p")[2])
    return parsed.filter("offset is not null").drop("_p")


def byte_ranges(lines: DataFrame, by: str | None = None, order: str = "line_no") -> DataFrame:
    """start, end (null: to the end) of each run of equal offsets, per file.

    The last range is emitted whatever the last line looks like. A window orders the lines of one
    file only, which an index bounds; lines of several files need `by`.
    """
    w = Window.partitionBy(*([by] if by else [F.lit(1)])).orderBy(order)
    keys = [by] if by else []
    first = lines.withColumn("_before", F.lag("offset").over(w)).filter(F.col("_before").isNull() | (F.col("_before") != F.col("offset")))
    return first.select(*keys, order, F.col("offset").alias("start"), F.lead("offset").over(w).alias("end"))


def read_index(spark: SparkSession, *paths: str) -> DataFrame:
    """path, line_no (from 1), value of compressed indexes; empty lines go."""
    spark.dataSource.register(IndexSource)
    return spark.read.format("multistream_index").option("paths", json.dumps(paths)).load()


def after_progress(ranges: DataFrame, progress: int | Column, order: str = "line_no", by: str | None = None) -> DataFrame:
    """Ranges not fully read when `progress` lines were: the range that holds the saved line is read again."""
    w = Window.partitionBy(*([by] if by else [])).orderBy(order)
    return ranges.withColumn("_last", F.lead(order).over(w) - 1).filter(F.col("_last").isNull() | (F.col("_last") >= progress)).drop("_last")


class Progress:
    """Index lines whose pages are written, per file and run, in an append-only table."""

    SCHEMA = "run_id long, path string, lines long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def save(self, run_id: int, done: DataFrame) -> None:
        """Appends done(path, lines)."""
        done.select(F.lit(run_id).cast("long").alias("run_id"), "path", F.col("lines").cast("long").alias("lines")).coalesce(1).write.mode("append").parquet(self.folder)

    def load(self, run_id: int) -> DataFrame:
        """path, lines: the most that the run has read of each file; files it has not begun are absent."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], "path string, lines long")
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder).filter(F.col("run_id") == run_id).groupBy("path").agg(F.max("lines").alias("lines"))
