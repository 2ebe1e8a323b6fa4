"""Nearest neighbours by robust-pruned directed graphs, one per shard of the vectors.

A shard's graph is built in growing batches: a greedy search of the graph so far proposes each new
point's neighbours, and of these relaxed distance pruning keeps diverse ones - a candidate goes if
some nearer neighbour is closer to it than it is to the point by a factor alpha. Edges are made
mutual and pruned again where too many. A query runs a beam search in every shard.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Workspace, read_table

DEGREE = 32
BUILD_BEAM = 48
SEARCH_BEAM = 96
ALPHA = 1.2
NEAREST = 10
#: Query vectors searched together in one task.
QUERY_BLOCK = 512
#: Most distinct vectors of one shard, for memory.
SHARD_MOST = 200_000


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the best `beam` points found for each query, nearest first; -1 fills up."""
    n = len(queries)
    ids = np.full((n, beam), -1, np.int64)
    dist = np.full((n, beam), np.inf, np.float32)
    done = np.ones((n, beam), bool)
    ids[:, 0], done[:, 0] = entry, False
    dist[:, 0] = ((x[entry] - queries) ** 2).sum(1)
    live = np.arange(n)
    while len(live):
        d, open_ = dist[live], ~done[live]
        first = np.argsort(np.where(open_, d, np.inf), axis=1, kind="stable")[:, :step]
        is_open = np.take_along_axis(open_, first, 1)
        live, first, is_open = live[is_open[:, 0]], first[is_open[:, 0]], is_open[is_open[:, 0]]
        if not len(live):
            break
        done[live[:, None], first] = True
        at = np.where(is_open, ids[live[:, None], first], -1)
        near = np.where(at[:, :, None] >= 0, edges[at], -1).reshape(len(live), -1)
        got = ((x[near] - queries[live][:, None, :]) ** 2).sum(2)
        got[near < 0] = np.inf
        all_ids, all_d = np.hstack([ids[live], near]), np.hstack([dist[live], got])
        all_done = np.hstack([done[live], np.zeros(near.shape, bool)])
        order = np.lexsort((~all_done, all_ids, all_d), axis=1)
        all_ids, all_d, all_done = (np.take_along_axis(a, order, 1) for a in (all_ids, all_d, all_done))
        again = np.zeros(all_ids.shape, bool)
        again[:, 1:] = all_ids[:, 1:] == all_ids[:, :-1]
        all_d[again] = np.inf
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        ids[live], dist[live] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_d, order, 1)
        done[live] = np.take_along_axis(all_done, order, 1) | ~np.isfinite(dist[live])
    ids[~np.isfinite(dist)] = -1
    return ids, dist


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most `degree` diverse neighbours for each point out of its row of candidates (-1: none)."""
    candidates = np.where(candidates == points[:, None], -1, candidates)
    c = x[candidates]
    d = ((c - x[points][:, None, :]) ** 2).sum(2)
    d[candidates < 0] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    candidates, d = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1)
    same = np.zeros(d.shape, bool)
    same[:, 1:] = candidates[:, 1:] == candidates[:, :-1]
    d[same] = np.inf
    c = x[candidates]
    norm = (c**2).sum(2)
    between = norm[:, :, None] + norm[:, None, :] - 2 * (c @ c.transpose(0, 2, 1))
    out = np.full((len(points), degree), -1, np.int64)
    alive, rows = np.isfinite(d), np.arange(len(points))
    for r in range(degree):
        has = alive.any(1)
        if not has.any():
            break
        pick = alive.argmax(1)
        out[has, r] = candidates[rows[has], pick[has]]
        alive &= ~((alpha * alpha * between[rows, pick] <= d) & has[:, None])
        alive[rows[has], pick[has]] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 1) -> tuple[np.ndarray, int]:
    """(edges, entry) over distinct vectors x; a row of edges is filled up with -1."""
    n = len(x)
    edges = np.full((n, degree), -1, np.int64)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at = 1
    while at < n:
        new = order[at : at + min(max(at, 8), 512)]
        found, _ = beam_search(x, edges, entry, x[new], beam)
        edges[new] = robust_prune(x, new, found, degree, alpha)
        ends = edges[new].ravel()
        starts = np.repeat(new, degree)[ends >= 0]
        ends = ends[ends >= 0]
        by = np.argsort(ends, kind="stable")
        ends, starts = ends[by], starts[by]
        targets, first, count = np.unique(ends, return_index=True, return_counts=True)
        width = int(count.max()) if len(count) else 0
        back = np.full((len(targets), width), -1, np.int64)
        place = np.arange(len(ends)) - np.repeat(first, count)
        back[np.repeat(np.arange(len(targets)), count), place] = starts
        for a in range(0, len(targets), 512):
            t = targets[a : a + 512]
            wide = np.hstack([edges[t], back[a : a + 512]])
            full = (wide >= 0).sum(1) > degree
            packed = np.take_along_axis(wide, np.argsort(wide < 0, axis=1, kind="stable"), 1)[:, :degree]
            if full.any():
                use = wide[full]
                if use.shape[1] > 3 * degree:  # the nearest of very many new ones
                    dd = ((x[use] - x[t[full]][:, None, :]) ** 2).sum(2)
                    dd[use < 0] = np.inf
                    use = np.take_along_axis(use, np.argsort(dd, axis=1)[:, : 3 * degree], 1)
                packed[full] = robust_prune(x, t[full], use, degree, alpha)
            edges[t] = packed
        at += len(new)
    return edges, entry


def valid_vectors(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """Rows whose vector is not null, empty or zero and holds only finite numbers."""
    v = F.col(column)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.select(key, column).filter(F.col(key).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda c: c != 0))


def nearest(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = NEAREST, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query among all other rows.

    vectors(key, column); queries has rows of the same kind. Only vectors of equal length are
    compared. Equal vectors are one point of a graph; of each, the k + 1 smallest keys can be asked
    for, so no more are kept with the point; ties go to the smaller key. A key that stands on several vectors is a row with each: as a
    query each has its own result, and the other ones are candidates. The number of shards grows with
    the square root of the number of points, which balances searches per query against the size of a
    graph. Null keys, and vectors that are null, empty, zero or hold null or non-finite components take no
    part, as rows or as queries; repeated rows count once; an empty table gives no rows. Other columns
    are ignored, whatever their names.
    """
    spark, ws = vectors.sparkSession, Workspace(vectors.sparkSession)
    good = valid_vectors(vectors, key, column).select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<float>").alias("v"))
    w = Window.partitionBy("v").orderBy("id")
    points = good.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("members"))
    points = ws.write(points.select(F.monotonically_increasing_id().alias("point"), "v", F.element_at("members", 1).alias("least"), "members", F.size("v").alias("dim")), "points")
    n = points.count()
    shards = max(1, math.ceil(math.sqrt(n) / 10), math.ceil(n / SHARD_MOST))
    sharded = points.select("point", "v", "least", "dim", F.pmod(F.xxhash64("point"), F.lit(shards)).cast("int").alias("shard"))

    def matrix(t: pa.Table, name: str) -> np.ndarray:
        flat = t.column(name).combine_chunks()
        flat = flat.flatten() if isinstance(flat, pa.Array) else pa.concat_arrays([c.flatten() for c in flat.chunks])
        return flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(t.num_rows, -1)

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by([("least", "ascending"), ("point", "ascending")])  # the order of ties
        x = matrix(t, "v")
        edges, entry = build_graph(x)
        return pa.Table.from_pylist([{"dim": t.column("dim")[0].as_py(), "shard": t.column("shard")[0].as_py(), "entry": entry, "ids": np.concatenate([t.column(c).to_numpy() for c in ("point", "least")]).astype("<i8").tobytes(), "x": x.astype("<f4").tobytes(), "edges": edges.astype("<i4").tobytes()}], schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("entry", pa.int32()), ("ids", pa.binary()), ("x", pa.binary()), ("edges", pa.binary())]))

    # a task per shard and no fewer: building costs far more than the rows weigh
    spread = sharded.repartition(shards, "dim", "shard")
    graphs = ws.write(spread.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, entry int, ids binary, x binary, edges binary"), "graphs")

    asked = valid_vectors(queries, key, column).select(F.col(key).cast("long").alias("query_id"), F.col(column).cast("array<float>").alias("q")).distinct()
    # queries are numbered, and know the point of their own vector
    asked = asked.join(points.select("v", F.col("point").alias("own")), F.col("q") == F.col("v"), "left").drop("v")
    asked = ws.write(asked.withColumn("dim", F.size("q")).withColumn("query", F.monotonically_increasing_id()), "queries")
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))

    def stack(t: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([{"dim": t.column("dim")[0].as_py(), "block": t.column("block")[0].as_py(), "qids": t.column("query").to_numpy().astype("<i8").tobytes(), "q": matrix(t, "q").astype("<f4").tobytes()}], schema=pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("qids", pa.binary()), ("q", pa.binary())]))

    packed = ws.write(asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).groupBy("dim", "block").applyInArrow(stack, "dim int, block int, qids binary, q binary"), "query-blocks")
    # every block of the stated query set goes to every shard; a graph moves once and stays while its shard's blocks pass
    none = F.lit(None).cast("binary")
    left = graphs.select("dim", "shard", F.lit(-1).alias("block"), "entry", "ids", "x", "edges")
    right = packed.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", F.lit(0).alias("entry"), F.col("qids").alias("ids"), F.col("q").alias("x"), none.alias("edges"))
    order = ["dim", "shard", "block"]

    def search(batches):
        held = None
        for b in batches:
            for i in range(b.num_rows):
                dim, shard, block, entry, ids, x, edges = (c[i].as_py() for c in b.columns)
                ids, x = np.frombuffer(ids, "<i8"), np.frombuffer(x, "<f4").reshape(-1, dim)
                if block < 0:
                    ids = ids.reshape(2, -1)
                    held = dim, shard, entry, ids, x, np.frombuffer(edges, "<i4").reshape(ids.shape[1], -1).astype(np.int64)
                elif held is not None and held[:2] == (dim, shard):
                    _, _, start, points_, v, links = held
                    found, _ = beam_search(v, links, start, x, beam)
                    # the beam's own order is in single precision; all of it is ordered anew, in parts
                    for at in range(0, len(ids), 64):
                        f = found[at : at + 64]
                        d = v[f].astype(np.float64) - x[at : at + 64, None, :].astype(np.float64)
                        score = np.sqrt((d * d).sum(2))
                        score[f < 0] = np.inf
                        best = np.lexsort((f, score), axis=1)[:, : k + 1]
                        score, f = np.take_along_axis(score, best, 1), np.take_along_axis(f, best, 1)
                        keep = np.isfinite(score)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + 64], keep.sum(1))), *(pa.array(p[f[keep]]) for p in points_), pa.array(score[keep])], names=["query", "point", "least", "score"])

    hits = left.unionAll(right).repartition(shards, "dim", "shard").sortWithinPartitions(*order).select(*order, "entry", "ids", "x", "edges").mapInArrow(search, "query long, point long, least long, score double")
    # a query's own vector may be among its k + 1 nearest points
    best = Window.partitionBy("query").orderBy("score", "least", "point")
    hits = hits.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1).drop("_r", "least")
    rows = hits.join(points.select("point", "members"), "point").join(asked.select("query", "query_id", "own"), "query")
    rows = rows.select("query", "query_id", "score", F.explode("members").alias("vec_id"), F.col("point").eqNullSafe(F.col("own")).alias("same")).filter("not (same and vec_id = query_id)")
    final = Window.partitionBy("query").orderBy("score", "vec_id")
    return rows.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_graph_search(spark, sf_dir: str) -> DataFrame:
    """The ten nearest of every row whose vec_id is divisible by 100; nulls, ties and repeats are as nearest has them."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
