"""Approximate search: recall with few probes, what is read, later vectors, and the service's search through it."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreweave.config import Config
from loreweave.functions import vectors as vc
from loreweave.operators import search as sr
from loreweave.operators.vector_index import Model, VectorIndex, _lloyd
from loreweave.plans.service import Service


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 24))
    x = centres[rng.integers(0, 60, 4000)] + 0.35 * rng.standard_normal((4000, 24))
    return x.astype(np.float32)


@pytest.fixture(scope="module")
def index(spark, clustered, tmp_path_factory):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered)], "id long, embedding array<float>").repartition(4)
    index = VectorIndex.train(df, str(tmp_path_factory.mktemp("index")), ["id"], 64, spill=2)
    index.add(df)
    return index


def exact(x, q, k):
    x, q = (a / np.linalg.norm(a, axis=-1, keepdims=True) for a in (x.astype(float), q.astype(float)))
    return np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :k]


def test_recall_with_an_eighth_of_the_lists(spark, clustered, index):
    q = clustered[::80] + 0.05
    found = {}
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id int, vector array<float>")
    for r in index.search(asked, 10, probes=8).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["similarity"]))
    want = exact(clustered, q, 10)
    hits = sum(len({j for _, j, _ in found[i]} & set(want[i].tolist())) for i in range(len(q)))
    assert hits >= 0.9 * 10 * len(q)
    for i, rows in found.items():  # scores are exact, ranks by score
        rows.sort()
        v = clustered[[j for _, j, _ in rows]].astype(float)
        s = v @ q[i].astype(float) / np.linalg.norm(v, axis=1) / np.linalg.norm(q[i].astype(float))
        assert [n for n, _, _ in rows] == list(range(1, 11)) and np.allclose(s, [x for _, _, x in rows], atol=1e-6) and (np.diff(s) <= 1e-9).all()


def files_scanned(df):
    """The number of files that the scan of a plan opens, by its own metric."""
    df.write.format("noop").mode("overwrite").save()
    ran = df._jdf.queryExecution().executedPlan()
    df.collect()
    todo = [ran]
    while todo:
        node = todo.pop()
        if "FileSourceScanExec" in node.getClass().getName():
            return node.metrics().apply("numFiles").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]


def test_only_probed_lists_are_opened(index):
    some, all_ = index.codes([3, 5]), index.codes(list(range(64)))
    assert "PartitionFilters: [list_id" in some._jdf.queryExecution().toString()
    assert 0 < files_scanned(some) * 8 < files_scanned(all_)


def test_later_vectors_join_without_training(spark, clustered, index):
    again = VectorIndex.open(spark, index.folder)
    assert (again.model.centres == index.model.centres).all() and (again.model.books == index.model.books).all()
    v = np.full(24, -3.0, np.float32)
    odd = [(90_000, v.tolist()), (90_000, v.tolist()), (90_001, None), (90_002, [0.0] * 24), (90_003, [1.0]), (90_004, [float("nan")] * 24), (90_005, (v * 2).tolist())]
    again.add(spark.createDataFrame(odd, "id long, embedding array<float>"))
    asked = spark.createDataFrame([(1, v.tolist()), (2, None), (3, [0.0] * 24), (4, [1.0])], "query_id int, vector array<float>")
    got = again.search(asked, 3, probes=1).collect()
    assert {r["query_id"] for r in got} == {1} and [r["id"] for r in sorted(got)][:2] == [90_000, 90_005]  # equal directions, by key
    none = again.search(asked.filter("query_id = 1"), 3, probes=1, valid=lambda c: c.filter("id < 90000"))
    assert all(r["id"] < 90_000 for r in none.collect())
    assert again.search(asked.filter("query_id > 1"), 3).count() == 0


def test_codebooks_and_tables():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 8)).astype(np.float32)
    books = np.stack([_lloyd(x[:, 2 * p : 2 * p + 2], 256) for p in range(4)])
    m = Model(np.zeros((1, 8), np.float32), books, 1)
    codes = m.codes(x, np.zeros(500, int))
    back = np.concatenate([books[p][codes[:, p]] for p in range(4)], 1)
    assert ((back - x) ** 2).sum() < 0.1 * (x**2).sum()
    scores = m.tables(x[:3])[:, np.arange(4), codes].sum(2)
    assert np.allclose(scores, x[:3] @ back.T, atol=1e-4)


def test_exact_search_of_a_stated_set(spark, clustered):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered[:300])] + [(900, None), (901, [0.0] * 24)], "id long, embedding array<float>")
    asked = df.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    got = {}
    for r in sr.top_k_of(df, asked, 5, "id").collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    assert got == {i: set(exact(clustered[:300], clustered[i : i + 1], 5)[0].tolist()) for i in range(0, 300, 50)}


def test_exact_search_in_shards_and_blocks_with_queries_of_two_lengths(spark, clustered, monkeypatch):
    monkeypatch.setattr(sr, "SHARD_LEAST", 50), monkeypatch.setattr(sr, "POINTS", 16), monkeypatch.setattr(sr, "BLOCK", 7)
    x = clustered[:300].copy()
    x[200:210] = x[50]  # ties go to the smaller key
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v[:3].tolist()) for i, v in enumerate(x[:9])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    asked = df.filter("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    got = {}
    for r in sr.top_k_of(df, asked, 5, "id").collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    assert {i: g for i, g in got.items() if i < 1000} == {i: set(exact(x, x[i : i + 1], 5)[0].tolist()) for i in range(0, 300, 5)}
    assert set(got) == {*range(0, 300, 5), 1000, 1005} and len(got[1000]) == 5 and min(got[1000]) >= 1000


def test_the_service_searches_through_the_index(spark, tmp_path):
    s = Service(spark, Config(content_folder=str(tmp_path), work_folder=str(tmp_path / "w"), dimension=16, lists=8, probes=8))
    s.INDEXED = 100
    e = vc.RandomEmbedder(16)
    row = lambda p, text, day: (p, f"n{p}", 1, 1, text, "enwiki", dt.datetime(2024, 1, day), e.embed([text])[0].tolist())
    s.store.upsert(spark.createDataFrame([row(p, f"text {p}", 1) for p in range(300)], s.store.schema))
    before = [tuple(r) for r in s.search("text 7", 5).collect()]
    s.build_index()
    assert s.index() is not None
    through = [tuple(r) for r in s.search("text 7", 5).collect()]
    assert [r[:3] for r in through] == [r[:3] for r in before] and np.allclose([r[3] for r in through], [r[3] for r in before], atol=1e-6)
    answer = s.search_answer("text 7", 2)
    assert answer["query"] == "text 7" and [r["name"] for r in answer["results"]] == [r[0] for r in before[:2]] and s.retrieve_answer(before[0][0])[0]["chunk_index"] == 1
    # what was replaced or deleted is not found; what came later is
    query = vc.query_text("text 7")
    better = spark.createDataFrame([(int(before[0][0][1:]), before[0][0], 1, 1, "other", "enwiki", dt.datetime(2024, 1, 2), (-e.embed([query])[0]).tolist()), (777, "best", 1, 1, "best", "enwiki", dt.datetime(2024, 1, 2), e.embed([query])[0].tolist())], s.store.schema)
    s.store.upsert(better)
    s.index().add(better)
    s.store.delete(spark.createDataFrame([(int(before[1][0][1:]), "enwiki")], "pid int, source string"))
    now = [tuple(r) for r in s.search("text 7", 4).collect()]
    assert now[0][0] == "best" and [r[0] for r in now[1:]] == [r[0] for r in before[2:5]]
    fresh = Service(spark, s.config)  # another process finds the index
    assert [tuple(r) for r in fresh.search("text 7", 4).collect()] == now
