"""Approximate vector search by inverted lists of product-quantised codes, with exact re-ranking.

Centres of the lists and the codebooks are trained once on a bounded sample. Every vector, also a later one, goes to the
lists of its `spill` nearest centres as a code of a few bytes: the residual to the centre, part by part the
number of the nearest codeword. A query reads the codes of the lists whose centres are nearest (other partitions are not
opened), adds up table entries for an approximate cosine, and the best candidates are scored exactly by their vectors, which
stand once, by home list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.vectors import l2_normalise
from ..shared import exists, remove, scratch
from .search import all_equal

#: Vectors that train the model at most, and for each list.
SAMPLE, SAMPLE_OF_LIST = 200_000, 256
#: Words of a codebook: a byte tells them apart.
WORDS = 256
#: Queries that are searched in one job; more of them take more jobs.
QUERIES = 4096


def _unit(flat: np.ndarray, dimension: int) -> np.ndarray:
    v = flat.astype(np.float32).reshape(-1, dimension)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False), dimension)


def _lloyd(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """k means of the rows; a mean without rows keeps its place."""
    c = x[np.random.default_rng(seed).choice(len(x), k, len(x) < k)].astype(np.float64)
    for _ in range(rounds):
        near = (x @ c.T - (c**2).sum(1) / 2).argmax(1)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c.astype(np.float32)


class Model:
    """centres (lists, dimension) and codebooks (parts, words, dimension of a part)."""

    def __init__(self, centres: np.ndarray, books: np.ndarray, spill: int):
        self.centres, self.books, self.spill = centres, books, spill

    @property
    def dimension(self) -> int:
        return self.centres.shape[1]

    def nearest_lists(self, v: np.ndarray, n: int) -> np.ndarray:
        near = v @ self.centres.T - (self.centres**2).sum(1) / 2
        return np.argsort(-near, axis=1, kind="stable")[:, :n]

    def codes(self, v: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """A byte for each part of the residual of each vector to its list's centre."""
        rest = (v - self.centres[lists]).reshape(len(v), len(self.books), -1)
        return np.stack([(rest[:, p] @ b.T - (b**2).sum(1) / 2).argmax(1) for p, b in enumerate(self.books)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, parts, words): what each codeword adds to the inner product with a query."""
        parts = q.reshape(len(q), len(self.books), -1)
        return np.einsum("qpd,pwd->qpw", parts, self.books, optimize=True)


class VectorIndex:
    """An index in a folder that all executors share. keys are the columns that name a vector."""

    def __init__(self, spark: SparkSession, folder: str, model: Model, keys: list[str], key_types: list[str]):
        self.spark, self.folder, self.model, self.keys, self.key_types = spark, folder, model, keys, key_types
        self.lists = len(model.centres)

    # ---- model

    @classmethod
    def train(cls, vectors: DataFrame, folder: str, keys: list[str], lists: int, column: str = "embedding", spill: int = 2, part: int = 4, seed: int = 1) -> VectorIndex:
        """A new index without vectors. The sample has SAMPLE_OF_LIST vectors a list on average and no more than SAMPLE; parts are of `part` components."""
        spark = vectors.sparkSession
        good = vectors.filter(F.col(column).isNotNull() & F.exists(column, lambda c: c != 0) & ~F.exists(column, lambda c: c.isNull() | F.isnan(c)))
        n = good.count()
        if not n:
            raise ValueError("no vectors to train on")
        share = min(1.0, min(SAMPLE, SAMPLE_OF_LIST * lists) / n)
        path = scratch(spark, "sample")
        good.sample(share, seed).select(l2_normalise(F.col(column)).alias("v")).write.parquet(path)
        sample = spark.read.parquet(path)
        dimension = len(sample.first()[0])
        some = sample.select(array_to_vector("v").alias("features"))
        fitted = KMeans(k=min(lists, some.count()), seed=seed, maxIter=12).fit(some)
        centres = np.array(fitted.clusterCenters(), np.float32)
        parts = -(-dimension // part)
        while dimension % parts:
            parts += 1
        coarse = Model(centres, np.zeros((parts, 1, dimension // parts), np.float32), 1)
        held = spark.sparkContext.broadcast(coarse)

        def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    v = _matrix(b.column(0), dimension)
                    rest = (v - held.value.centres[held.value.nearest_lists(v, 1)[:, 0]]).reshape(len(v), parts, -1)
                    for p in range(parts):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), p, np.int32)), pa.array(list(rest[:, p]), pa.list_(pa.float32()))], names=["p", "v"])

        def book(key: tuple, t: pa.Table) -> pa.Table:
            x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            return pa.table({"p": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([_lloyd(x, WORDS, seed=seed).astype("<f4").tobytes()], pa.binary())})

        # a codebook to a task; the sample bounds its rows
        rows = sample.mapInArrow(residuals, "p int, v array<float>").groupBy("p").applyInArrow(book, "p int, words binary").collect()
        books = np.stack([np.frombuffer(r["words"], "<f4").reshape(WORDS, -1) for r in sorted(rows, key=lambda r: r["p"])])
        types = [vectors.schema[k].dataType.simpleString() for k in keys]
        spark.createDataFrame([(bytearray(centres.astype("<f4").tobytes()), bytearray(books.astype("<f4").tobytes()), dimension, parts, spill, keys, types)], "centres binary, books binary, dimension int, parts int, spill int, keys array<string>, types array<string>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/model")
        remove(spark, path)
        return cls(spark, folder, Model(centres, books, spill), keys, types)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> VectorIndex | None:
        """The index in a folder, if there is one."""
        if not exists(spark, f"{folder}/model/_SUCCESS"):
            return None
        r = spark.read.parquet(f"{folder}/model").first()
        books = np.frombuffer(r["books"], "<f4").reshape(r["parts"], WORDS, -1)
        return cls(spark, folder, Model(np.frombuffer(r["centres"], "<f4").reshape(-1, r["dimension"]), books, r["spill"]), list(r["keys"]), list(r["types"]))

    # ---- vectors

    def _key_schema(self) -> str:
        return ", ".join(f"`{k}` {t}" for k, t in zip(self.keys, self.key_types))

    def add(self, vectors: DataFrame, column: str = "embedding") -> None:
        """Puts vectors into their lists, by the model as it is. Null, zero and wrongly sized vectors, and those with components that are no numbers, are left out."""
        spark, d, names, n_keys = self.spark, self.model.dimension, self.keys, len(self.keys)
        good = vectors.filter((F.size(column) == d) & F.exists(column, lambda c: c != 0) & ~F.exists(column, lambda c: c.isNull() | F.isnan(c)))
        held = spark.sparkContext.broadcast(self.model)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = held.value
            for b in batches:
                if not b.num_rows:
                    continue
                v = _matrix(b.column(n_keys), d)
                lists = m.nearest_lists(v, m.spill)
                codes = np.stack([m.codes(v, lists[:, s]) for s in range(lists.shape[1])], 1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists[:, 0].astype(np.int32)), pa.array(list(lists.astype(np.int32)), pa.list_(pa.int32())), pa.array([[bytes(c) for c in row] for row in codes], pa.list_(pa.binary()))], names=[*names, "vector", "home", "lists", "codes"])

        path = scratch(spark, "encoded")
        picked = good.select(*(F.col(k).cast(t) for k, t in zip(self.keys, self.key_types)), F.col(column).cast("array<float>").alias("vector"))
        picked.mapInArrow(encode, f"{self._key_schema()}, vector array<float>, home int, lists array<int>, codes array<binary>").write.parquet(path)
        encoded = spark.read.parquet(path)
        # by range of list and a hash of the key: a list of very many vectors is cut into several files
        mixed = F.xxhash64(*self.keys)
        of_lists = encoded.select(*self.keys, "home", F.explode(F.arrays_zip("lists", "codes")).alias("z")).select(*self.keys, "home", F.col("z.lists").alias("list_id"), F.col("z.codes").alias("code"))
        of_lists.withColumn("_m", mixed).repartitionByRange("list_id", "_m").drop("_m").write.mode("append").partitionBy("list_id").parquet(f"{self.folder}/codes")
        encoded.select(*self.keys, "vector", "home").withColumn("_m", mixed).repartitionByRange("home", "_m").drop("_m").write.mode("append").partitionBy("home").parquet(f"{self.folder}/vectors")
        remove(spark, path)

    def codes(self, lists: list[int]) -> DataFrame:
        """Codes of some lists; the partitions of others are not opened."""
        rows = self.spark.read.schema(f"{self._key_schema()}, home int, code binary, list_id int").parquet(f"{self.folder}/codes")
        return rows.filter(F.col("list_id").isin(lists))

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, candidates: int | None = None, query_id: str = "query_id", vector: str = "vector", valid: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """query_id, rank, keys, similarity: the k nearest found for each of queries(query_id, vector), ties to the smaller keys.

        `candidates` of each query (8 * k + 64 unless given) are scored exactly; valid may take some of them out before,
        as those that are no longer stored. Queries with null, zero or wrongly sized vectors find nothing.
        """
        spark, model, d = self.spark, self.model, self.model.dimension
        most = candidates or 8 * k + 64
        schema = f"{query_id} {queries.schema[query_id].dataType.simpleString()}"
        out_schema = f"{schema}, rank int, {self._key_schema()}, similarity double"
        if not exists(spark, f"{self.folder}/codes"):
            return spark.createDataFrame([], out_schema)
        good = queries.select(query_id, F.col(vector).cast("array<float>").alias("q")).filter((F.size("q") == d) & F.exists("q", lambda c: c != 0) & ~F.exists("q", lambda c: c.isNull() | F.isnan(c)))
        path = scratch(spark, "queries")
        good.withColumn("_n", F.monotonically_increasing_id()).write.parquet(path)
        asked, parts, names, n_keys = spark.read.parquet(path), [], self.keys, len(self.keys)
        total = asked.count()
        blocks = -(-total // QUERIES)
        for block in range(blocks):
            rows = asked.filter(F.pmod(F.xxhash64("_n"), F.lit(blocks)) == block).select("_n", "q").collect()  # about QUERIES of them
            if not rows:
                continue
            q = _unit(np.array([r["q"] for r in rows], np.float32).ravel(), d)
            near = model.nearest_lists(q, min(probes, self.lists))
            by_list: dict[int, list[int]] = {}
            for i, lists in enumerate(near.tolist()):
                for x in lists:
                    by_list.setdefault(x, []).append(i)
            held = spark.sparkContext.broadcast((np.array([r["_n"] for r in rows]), q @ model.centres.T, model.tables(q), {x: np.array(i) for x, i in by_list.items()}))

            def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                numbers, to_centre, tables, askers = held.value
                for b in batches:
                    own = b.column(n_keys + 1).to_numpy()
                    for x in np.unique(own):
                        at = np.flatnonzero(own == x)
                        codes = np.frombuffer(b"".join(b.column(n_keys + 2).take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
                        for i in askers[int(x)]:
                            score = to_centre[i, x] + tables[i][np.arange(codes.shape[1]), codes].sum(1)
                            best = np.argpartition(-score, most - 1)[:most] if len(score) > most else np.arange(len(score))
                            some = b.take(pa.array(at[best]))
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), numbers[i])), *some.columns[: n_keys + 1], pa.array(score[best].astype(np.float64))], names=["_n", *names, "home", "near"])

            parts.append(self.codes(sorted(by_list)).select(*self.keys, "home", "list_id", "code").mapInArrow(scan, f"_n long, {self._key_schema()}, home int, near double"))
        if not parts:
            return spark.createDataFrame([], out_schema)
        hits = parts[0]
        for p in parts[1:]:
            hits = hits.unionByName(p)
        # a vector is in several lists, and may have been added twice
        once = hits.groupBy("_n", *self.keys, "home").agg(F.max("near").alias("near"))
        best = once.withColumn("_r", F.row_number().over(Window.partitionBy("_n").orderBy(F.col("near").desc(), *self.keys))).filter(F.col("_r") <= most).drop("_r", "near")
        found = scratch(spark, "candidates")
        best.write.parquet(found)
        best = spark.read.schema(best.schema).parquet(found)
        if valid is not None:
            best = valid(best)
        homes = [r[0] for r in best.select("home").distinct().collect()]  # lists at most
        vectors = self.spark.read.schema(f"{self._key_schema()}, vector array<float>, home int").parquet(f"{self.folder}/vectors").filter(F.col("home").isin(homes))
        same = all_equal("b", "v", ["home", *self.keys])
        scored = best.alias("b").join(vectors.alias("v"), same).select(F.col("b._n").alias("_n"), *(F.col(f"b.{x}").alias(x) for x in self.keys), F.col("v.vector").alias("_v")).join(asked, "_n")
        dots = F.aggregate(F.zip_with("_v", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
        norms = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) * F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        exact = scored.select("_n", query_id, *self.keys, F.try_divide(dots, norms).alias("similarity")).groupBy("_n", query_id, *self.keys).agg(F.max("similarity").alias("similarity"))
        rank = F.row_number().over(Window.partitionBy("_n").orderBy(F.col("similarity").desc(), *self.keys))
        return exact.withColumn("rank", rank).filter(F.col("rank") <= k).select(query_id, "rank", *self.keys, "similarity")

