"""An index of a run's files: the range of pids and a Bloom filter of names for each, so that a lookup opens few of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bits of one bitmap of Spark's bitmap functions; bits and hashes for each name.
BITMAP, BITS, HASHES = 32_768, 12, 6


def _hash(name: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), name)


def write(rows: DataFrame, pid: str, name: str, folder: str) -> int:
    """Writes file, rows, least, most, width, bucket, bits for the stored files of rows; returns the number of rows.

    A filter of `width` bitmaps is a row per bitmap; all files of a run have the width that the one with most names needs.
    """
    spark = rows.sparkSession
    own = rows.select(F.col("_metadata.file_name").alias("file"), F.col(pid).alias("pid"), F.col(name).alias("name"))
    stats = own.groupBy("file").agg(F.count("*").alias("rows"), F.min("pid").cast("long").alias("least"), F.max("pid").cast("long").alias("most"), F.approx_count_distinct("name").alias("names")).persist()
    total = stats.agg(F.sum("rows"), F.max("names")).first()
    if not total[0]:
        stats.unpersist()
        return 0
    width = max(1, math.ceil(total[1] * BITS * 1.1 / BITMAP))
    places = own.filter("name is not null").select("file", "name").distinct().select("file", F.explode(F.array(*(F.pmod(_hash(F.col("name"), k), F.lit(width * BITMAP)) for k in range(HASHES)))).alias("at"))
    bits = places.groupBy("file", F.floor(F.col("at") / BITMAP).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % BITMAP).alias("bits"))
    found = stats.drop("names").join(bits, "file", "left").select("file", "rows", "least", "most", F.lit(width).alias("width"), "bucket", "bits")
    found.write.option("compression", "zstd").parquet(folder)
    stats.unpersist()
    return int(total[0])


def with_name(spark: SparkSession, folder: str, name: str) -> list[str]:
    """Files that may hold the name: all that do, and few others."""
    hashes = spark.range(1).select(*(_hash(F.lit(name), k) for k in range(HASHES))).first()
    index = spark.read.parquet(folder)
    width = F.col("width") * BITMAP
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.pmod(F.lit(h), width).alias("place")) for k, h in enumerate(hashes))))
    asked = index.withColumn("_at", at).filter(F.col("bucket") == F.floor(F.col("_at.place") / BITMAP))
    inside = F.col("_at.place") % BITMAP
    byte = F.conv(F.hex(F.expr("substring(bits, cast(_at.place % 32768 div 8 as int) + 1, 1)")), 16, 10).cast("int")
    is_set = F.expr("shiftright({0}, cast({1} % 8 as int)) & 1 = 1".format("b", "p"))
    hit = asked.withColumn("b", byte).withColumn("p", inside).filter(is_set)
    return sorted(r[0] for r in hit.groupBy("file").agg(F.count_distinct("_at.k").alias("n")).filter(F.col("n") == HASHES).select("file").collect())


def with_pids(spark: SparkSession, folder: str, pids: list[int]) -> list[str]:
    """Files whose range holds one of the pids."""
    inside = F.lit(False)
    for p in pids:
        inside = inside | F.lit(p).between(F.col("least"), F.col("most"))
    return sorted(r[0] for r in spark.read.parquet(folder).filter(inside).select("file").distinct().collect())
