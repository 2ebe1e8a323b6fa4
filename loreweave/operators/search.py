"""Vector search: exact, and by inverted lists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.vectors import cosine_distance, l2_normalise

#: Vectors of a shard at most (about), and vectors that make a shard of its own worth while.
SHARD_MOST, SHARD_LEAST = 65_536, 4_096
#: Queries and vectors of a shard that are scored at once.
BLOCK, POINTS = 256, 4_096


def query_vector(values: list[float] | list[list[float]]) -> Column:
    """A literal; of a matrix the first row."""
    row = values[0] if values and isinstance(values[0], (list, tuple)) else values
    return F.array(*[F.lit(float(x)) for x in row])


def top_k(vectors: DataFrame, query: list[float], k: int = 10, column: str = "embedding", ties: tuple[str, ...] = ()) -> DataFrame:
    """The k rows nearest by cosine with similarity added; null and not-a-number distances come last. One pass and a bounded merge."""
    scored = vectors.withColumn("_d", cosine_distance(F.col(column), query_vector(query)))
    return scored.orderBy(F.col("_d").asc_nulls_last(), *ties).limit(k).withColumn("similarity", 1 - F.col("_d")).drop("_d")


def _unit(column: pa.Array, dimension: int) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dimension)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _nearest(x: np.ndarray, q: np.ndarray, k: int) -> list[np.ndarray]:
    """[row of q, row of x, inner product] of the k highest of each row of q, ties to the earlier row of x; POINTS rows of x are scored at once."""
    held = [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]
    least = np.full(len(q), -np.inf)
    for at in range(0, len(x), POINTS):
        scores = q @ x[at : at + POINTS].T
        if not at and scores.shape[1] > k:
            least = np.partition(scores, -k, axis=1)[:, -k]
        who, points = np.nonzero(scores >= least[:, None])
        if not len(who):
            continue
        who, points, found = (np.concatenate(c) for c in zip(held, (who, at + points, scores[who, points])))
        order = np.lexsort((points, -found, who))
        place = np.arange(len(order)) - np.searchsorted(who[order], who[order])
        order, last = order[place < k], order[place == k - 1]
        held = [who[order], points[order], found[order]]
        least[who[last]] = found[last]
    return held


def top_k_of(vectors: DataFrame, queries: DataFrame, k: int, key: str, column: str = "embedding") -> DataFrame:
    """query_id, key of the k nearest by cosine for each of a stated set of queries(query_id, vector), ties to the smaller key.

    Vectors are dealt into shards of bounded size, a task each. The queries go to every shard, by shuffle, and pass by in blocks; a shard
    gives k a query. A task holds its shard and the scores of one block against POINTS of it. Only vectors of a query's length are compared; null and zero ones,
    and those with components that are no numbers, are left out.
    """
    spark, asked_type, key_type = vectors.sparkSession, queries.schema["query_id"].dataType, vectors.schema[key].dataType
    kind = f"query_id {asked_type.simpleString()}, `{key}` {key_type.simpleString()}"

    def good(c: str) -> Column:
        return F.col(c).isNotNull() & F.exists(c, lambda x: x != 0) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x))

    points = vectors.filter(good(column)).select(F.lit(False).alias("_asks"), F.col(key).alias("_key"), F.lit(None).cast(asked_type).alias("_query"), F.col(column).cast("array<double>").alias("_v"))
    n, cores = points.count(), spark.sparkContext.defaultParallelism
    shards = max(1, min(cores * math.ceil(n / (cores * SHARD_MOST)), n // SHARD_LEAST))
    dealt = points.withColumn("_row", F.monotonically_increasing_id()).withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int")).drop("_row")
    asks = queries.filter(good("vector")).select(F.lit(True).alias("_asks"), F.lit(None).cast(key_type).alias("_key"), F.col("query_id").alias("_query"), F.col("vector").cast("array<double>").alias("_v"))
    sent = dealt.unionByName(asks.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))).withColumn("_dim", F.size("_v"))
    sent = sent.repartitionById(shards, F.col("_shard")).sortWithinPartitions("_dim", "_asks", "_key")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, keys, parts = None, [], []
        for b in batches:
            dims, asks = b.column(3).to_numpy(), b.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(2 * dims + asks)) + 1).tolist(), b.num_rows]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                run, dim = b.slice(a, z - a), int(dims[a])
                if dim != here:
                    here, keys, parts = dim, [], []
                v = _unit(run.column(4), dim)
                if not asks[a]:
                    keys.append(run.column(1)), parts.append(v)
                    continue
                if not parts:
                    continue
                keys, parts = [pa.concat_arrays(keys)], [np.concatenate(parts)] if len(parts) > 1 else parts
                for at in range(0, len(v), BLOCK):
                    who, found, scores = _nearest(parts[0], v[at : at + BLOCK], k)
                    yield pa.RecordBatch.from_arrays([run.column(2).take(pa.array(at + who)), keys[0].take(pa.array(found)), pa.array(-scores)], names=["query_id", key, "d"])

    scored = sent.select("_asks", "_key", "_query", "_dim", "_v").mapInArrow(score, f"{kind}, d double")
    ranked = scored.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("d", key))).filter(F.col("_r") <= k)
    return ranked.select("query_id", key)


def all_equal(a: str, b: str, columns) -> Column:
    """Null-safe equality of columns of two aliased tables."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def sized_lists(n: int, lists: int, probes: int) -> tuple[int, int]:
    """(lists, probes) for n vectors: about the square root of n lists, no more than asked for, and the same share of them probed."""
    own = max(1, min(lists, round(n**0.5)))
    return own, max(1, -(-own * probes // lists))


class InvertedLists:
    """Whole vectors in k-means lists, written with the list as partition column; trained on SAMPLE_OF_LIST vectors a list. VectorIndex is the one that grows."""

    SAMPLE_OF_LIST = 256

    def __init__(self, vectors: DataFrame, folder: str, lists: int, column: str = "embedding", seed: int = 1):
        self.spark, self.folder, self.column = vectors.sparkSession, folder, column
        sample = min(1.0, self.SAMPLE_OF_LIST * lists / max(vectors.count(), 1))
        unit = vectors.withColumn("_v", array_to_vector(l2_normalise(F.col(column))))
        model = KMeans(k=lists, seed=seed, featuresCol="_v", predictionCol="list_id").fit(unit.sample(sample, seed) if sample < 1 else unit)
        self.centres = [c.tolist() for c in model.clusterCenters()]
        model.transform(unit).drop("_v").withColumn("_m", F.rand(seed)).repartitionByRange("list_id", "_m").drop("_m").write.mode("overwrite").partitionBy("list_id").parquet(folder)

    def search(self, query: list[float], k: int = 10, probes: int = 150, ties: tuple[str, ...] = ()) -> DataFrame:
        """top_k over the lists whose centres are nearest; other partitions are not read."""
        c, q = np.array(self.centres), np.array(query, float)
        near = np.argsort(-(c @ q) / np.maximum(np.linalg.norm(c, axis=1), 1e-12))[:probes]
        rows = self.spark.read.parquet(self.folder).filter(F.col("list_id").isin([int(x) for x in near]))
        return top_k(rows, query, k, self.column, ties)
