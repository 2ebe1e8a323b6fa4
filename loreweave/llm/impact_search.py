"""Exact top-k search over an impact-ordered index, processed score at a time.

Components are turned into integers. In each shard every dimension has its postings cut into segments of like components;
a segment's impact for a query is the most that one of its postings can add to a score. Segments of the highest impact are
processed for each query. They name the likeliest points, whose exact scores say what a member must reach, and give each point an upper
bound: what its postings seen so far add at most, and for each dimension not yet seen the impact of the next segment. Points
whose bound falls short are proven to be outside. The others are checked exactly, for all queries of a block together, and a
score counts only if it reaches what its query has so far. A posting costs some 10 ns and a component of that check 0.2 ns, so
processing further segments to leave out more points costs more than it saves.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Workspace, read_table

NEAREST = 5
SCALE = 256
#: Impact segments of a dimension, about.
SEGMENTS = 32
#: Points of a shard at most (about), for memory, and points that make a shard of its own worth while.
SHARD_MOST, SHARD_LEAST = 65_536, 4_096
#: Query vectors that visit a shard together.
QUERY_BLOCK = 512
#: One part of so many of all postings is processed for a query before its points are checked.
PARTS = 32
#: Points that are checked at once; a point that is checked alone costs as much as so many of them together.
CHECKED, ALONE = 4_096, 8
_LONG = (1 << 63) - 1


class ImpactIndex:
    """Postings of integer points x (points, dimensions), held as doubles, ordered by dimension and component."""

    def __init__(self, x: np.ndarray, postings: np.ndarray | None = None, segments: int = SEGMENTS):
        self.x, (self.n, self.d) = x, x.shape
        self.postings = np.argsort(x, axis=0, kind="stable").T.ravel() if postings is None else postings.astype(np.int64)
        #: What a posting adds to a point's sum besides its impact; sums smaller than half of it can be told from their number.
        self.mark = float(1 << (51 - self.d.bit_length()))
        self.most = float(np.abs(x).max(initial=0))
        parts = [self._cut(k, segments) for k in range(self.d if self.n else 0)]
        self.dims, self.lows, self.highs, self.starts, self.sizes = (np.concatenate(p) if parts else np.zeros(0, int) for p in (zip(*parts) if parts else [()] * 5))

    def _cut(self, k: int, segments: int) -> tuple[np.ndarray, ...]:
        """(dimension, lowest, highest component, first posting, size) of the segments of a dimension."""
        v = self.x[self.postings[k * self.n : (k + 1) * self.n], k]
        width = max(1.0, (v[-1] - v[0]) / segments)
        first = np.flatnonzero(np.diff(np.floor(v / width), prepend=-np.inf))
        last = np.append(first[1:], self.n)
        return np.full(len(first), k), v[first], v[last - 1], k * self.n + first, last - first

    def in_doubles(self, q: np.ndarray) -> bool:
        """Whether all sums for a query are exact."""
        return self.d > 0 and self.d * self.most * float(np.abs(q).max(initial=0)) < self.mark / 2

    def _process(self, q: np.ndarray, k: int) -> tuple[float, np.ndarray, int]:
        """(what a member must reach at least, points that may, postings processed) from the segments of the highest impact."""
        impact = np.maximum(q[self.dims] * self.lows, q[self.dims] * self.highs)
        order = np.argsort(-impact, kind="stable")
        ends = np.cumsum(self.sizes[order])
        to = min(int(np.searchsorted(ends, -(-self.n * self.d // PARTS))) + 1, len(order))
        top, run, done = order[:to], self.sizes[order[:to]], int(ends[to - 1])
        places = np.repeat(self.starts[top] - (ends[:to] - run), run) + np.arange(done)
        sums = np.bincount(self.postings[places], np.repeat(impact[top] + self.mark, run), self.n)
        seen = np.rint(sums / self.mark)
        reach = sums - seen * self.mark + (self.d - seen) * (impact[order[to]] if to < len(order) else 0.0)
        likely = np.argpartition(-reach, 4 * k)[: 4 * k]
        least = float(np.partition(self.x[likely] @ q, 3 * k)[3 * k])
        return least, np.flatnonzero(reach >= least), done

    def search_all(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(row of queries, point, exact score, postings processed) of the k highest inner products of each query, ties to the smaller point."""
        held, total = [np.zeros(0, int), np.zeros(0, int), np.zeros(0)], 0
        least = np.full(len(queries), -np.inf)
        wide = []

        def merge(who: np.ndarray, points: np.ndarray, scores: np.ndarray) -> None:
            who, points, scores = (np.concatenate(c) for c in zip(held, (who, points, scores)))
            order = np.lexsort((points, -scores, who))
            first = np.searchsorted(who[order], who[order])
            order = order[np.arange(len(order)) - first < k]
            held[:] = who[order], points[order], scores[order]
            full = np.flatnonzero(np.arange(len(order)) - np.searchsorted(held[0], held[0]) == k - 1)
            least[held[0][full]] = np.maximum(least[held[0][full]], held[2][full] + 1)  # scores are whole, and later points lose a tie

        for i, q in enumerate(queries):
            if self.n <= 4 * k:
                wide.append(i)
                continue
            least[i], possible, done = self._process(q, k)
            total += done
            if len(possible) * ALONE > self.n:
                wide.append(i)
            else:
                merge(np.full(len(possible), i), possible, self.x[possible] @ q)
        for at in range(0, self.n if wide else 0, CHECKED):
            scores = queries[wide] @ self.x[at : at + CHECKED].T
            who, points = np.nonzero(scores >= least[wide, None])
            if len(who):
                merge(np.array(wide)[who], at + points, scores[who, points])
        return (*held, total)

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(points, exact scores, postings processed) of the k highest inner products, ties to the smaller point."""
        _, points, scores, done = self.search_all(q[None], k)
        return points, scores, done


def _whole_search(x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All points scored in whole numbers, for components too large for doubles; scores beyond a long are its ends."""
    ints = [int(v) for v in q]
    scores = [sum(a * int(b) for a, b in zip(ints, row)) for row in x]
    best = sorted(range(len(x)), key=lambda i: (-scores[i], i))[:k]
    return np.array(best, int), np.array([max(-_LONG - 1, min(_LONG, scores[i])) for i in best], np.int64)


def _matrix(t: pa.Table, name: str, dim: int) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in t.column(name).chunks]
    return np.concatenate([np.zeros(0), *flat]).astype("<f8").reshape(t.num_rows, dim)


def search_exactly(vectors: DataFrame, queries: Callable[[Column], Column], key: str = "vec_id", column: str = "embedding", k: int = NEAREST, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), key, score: the k highest inner products of floor(scale * component) for each query among all other rows.

    queries makes a condition on the key, which names the query rows. Keys are whole numbers; rows with a null key, and vectors that are
    null or hold null or non-finite components take no part. Zero and empty vectors do (score 0). Only vectors of equal
    length are compared. A repeated key is a row of its own each time: as a query it has its own result, and another row with
    the query's key is a candidate. Ties go to the smaller key, then to any row. Scores are exact; beyond a long they are its ends.
    Other columns are ignored, whatever their names; an empty table gives no rows.

    Rows with equal integer vectors are one point, kept with its k + 1 smallest keys, and one query, so copies cost nothing. Every
    block of queries visits every shard of points; a shard gives k + 1 points a query.
    """
    spark, ws = vectors.sparkSession, Workspace(vectors.sparkSession)
    v = F.col(column)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))

    def turned(c):
        y = c.cast("double") * scale
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(F.greatest(F.least(y, F.lit(1e300)), F.lit(-1e300)))  # a large double is whole

    good = vectors.filter(F.col(key).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    rows = ws.write(good.select(F.col(key).cast("long").alias("id"), F.transform(v, turned).alias("v"), F.monotonically_increasing_id().alias("row")), "rows")
    first = Window.partitionBy("v").orderBy("id", "row")  # no more than k + 1 rows of a vector are dealt by a task
    members = rows.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "row"))).alias("members"))
    points = ws.write(members.withColumn("point", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "points")
    n = points.count()
    cores = spark.sparkContext.defaultParallelism
    shards = max(1, min(cores * math.ceil(n / (cores * SHARD_MOST)), n // SHARD_LEAST))  # as much for each core
    sharded = points.select("point", "v", F.col("members")[0]["id"].alias("id"), F.col("members")[0]["row"].alias("row"), "dim", F.pmod(F.xxhash64("point"), F.lit(shards)).cast("int").alias("shard"))
    shape = "dim int, shard int, block int, ids binary, x binary, postings binary"

    def blob(dim: int, shard: int, block: int, ids: np.ndarray, x: np.ndarray, postings: bytes | None) -> pa.Table:
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "ids": [ids.astype("<i8").tobytes()], "x": [x.astype("<f8").tobytes()], "postings": pa.array([postings], pa.binary())})

    def build(keys: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("row", "ascending")])  # the order of ties
        x = _matrix(t, "v", keys[0].as_py())
        ids = np.concatenate([t.column(c).to_numpy() for c in ("point", "id", "row")])
        return blob(keys[0].as_py(), keys[1].as_py(), -1, ids, x, ImpactIndex(x).postings.astype("<i4").tobytes())

    # more tasks than shards, as some hold several of them: building costs far more than the rows weigh
    index = ws.write(sharded.repartition(4 * shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, shape), "index")

    asked = ws.write(rows.filter(queries(F.col("id"))).join(points.select("v", "point"), "v").select("row", F.col("id").alias("query_id"), F.col("point").alias("query")), "asked")
    asking = ws.write(asked.select(F.col("query").alias("point")).distinct().join(points.select("point", "v", "dim"), "point"), "asking")
    blocks = max(1, math.ceil(asking.count() / QUERY_BLOCK))

    def stack(keys: tuple, t: pa.Table) -> pa.Table:
        return blob(keys[0].as_py(), 0, keys[1].as_py(), t.column("point").to_numpy(), _matrix(t, "v", keys[0].as_py()), None)

    packed = asking.withColumn("block", F.pmod(F.xxhash64("point"), F.lit(blocks)).cast("int")).groupBy("dim", "block").applyInArrow(stack, shape)
    # every block of the stated query set goes to every shard; an index moves once and stays while its shard's blocks pass
    visits = ws.write(packed, "query-blocks").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, here, own = None, None, None
        for b in batches:
            for i in range(b.num_rows):
                dim, shard, block, ids, x, postings = (c[i].as_py() for c in b.columns)
                ids = np.frombuffer(ids, "<i8")
                if block < 0:
                    own = ids.reshape(3, -1)
                    here, held = (dim, shard), ImpactIndex(np.frombuffer(x, "<f8").reshape(-1, dim) if dim else np.zeros((own.shape[1], 0)), np.frombuffer(postings, "<i4"))
                elif here == (dim, shard):
                    asked = np.frombuffer(x, "<f8").reshape(len(ids), dim)
                    exact = np.array([held.in_doubles(q) for q in asked], bool)
                    who, found, scores, _ = held.search_all(asked[exact], k + 1)
                    got = [(ids[exact][who], scores.astype(np.int64), *(a[found] for a in own))]
                    for query, q in zip(ids[~exact], asked[~exact]):
                        found, scores = _whole_search(held.x, q, k + 1)
                        got.append((np.full(len(found), query), scores.astype(np.int64), *(a[found] for a in own)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got)], names=["query", "score", "point", "id", "row"])

    # a task per shard: dealt by a hash some tasks would have several and others none
    sent = index.unionByName(visits).repartitionById(shards, F.col("shard")).sortWithinPartitions("dim", "shard", "block")
    hits = sent.select(*index.columns).mapInArrow(search, "query long, score long, point long, id long, row long")

    def top(df: DataFrame) -> DataFrame:
        """The k + 1 highest of each query, with their places."""
        return df.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id", "row"))).filter(F.col("place") <= k + 1)

    best = top(hits).select("query", "score", "point").join(points.select("point", "members"), "point")
    best = top(best.select("query", "score", F.explode("members").alias("m")).select("query", "score", "m.id", "m.row"))
    lists = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "id", "row", "score"))).alias("best"))
    # the row itself may be among them
    others = F.slice(F.filter("best", lambda t: t["row"] != F.col("row")), 1, k)
    out = asked.join(lists, "query").select("query_id", F.posexplode(others).alias("pos", "t"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("t.id").alias(key), F.col("t.score").alias("score"))


def op12_impact_search(spark, sf_dir: str) -> DataFrame:
    """The five highest inner products of every row whose vec_id is divisible by 50; nulls, ties and repeats are as search_exactly has them."""
    return search_exactly(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda key: key % 50 == 0)


OP12_SQL = f"""
WITH r AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(c::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM r q JOIN r c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM k WHERE rank <= {NEAREST}
"""
