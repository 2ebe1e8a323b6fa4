"""One id on several texts or vectors, and sources of a few words."""

import random
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from loreweave.llm import graph_search as gs, jaccard_join as jj, mixing as mx, registry

R = random.Random(7)
VOCAB = [f"w{i}" for i in range(300)]


def test_linked_rows_with_repeated_ids_against_sql(spark, tmp_path):
    bases = [[R.choice(VOCAB) for _ in range(R.choice([2, 30, 60, 90]))] for _ in range(40)]

    def text():
        w = list(R.choice(bases))
        for _ in range(R.choice([0, 0, 1, 2, 3])):
            w[R.randrange(len(w))] = R.choice(VOCAB)
        return R.choice([" ", "  ", "\t"]).join(w)

    rows = [(R.randrange(80), text(), "x") for _ in range(300)] + [(3, None, "x"), (3, "", "x"), (500, "x " * 20_000, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, id string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in registry.queries()["op10_jaccard_join"](spark, str(tmp_path)).select("doc_id", "n_shingles", "component_id").collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == Counter(db.execute(f"SELECT doc_id, n_shingles, component_id FROM ({jj.OP10_SQL})").fetchall())


def test_nearest_of_keys_on_several_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.standard_normal(8).round(2).tolist()) for i in rng.integers(0, 150, 400)]
    rows += [(0, [0.0] * 7 + [1.0]), (0, [1.0] + [0.0] * 7), (1, [8.0] + [0.0] * 7), (7, [8.0] + [0.0] * 7), (100, rows[5][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, 0.5) for i, v in rows], "vec_id long, embedding array<float>, score double").repartition(3)
    kept = {(i, tuple(float(np.float32(c)) for c in v)) for i, v in rows}  # repeated rows count once
    want = Counter()
    for i, v in kept:
        if i % 100 == 0:
            near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in kept if (j, w) != (i, v))[:10]
            want.update((i, n, j, round(s, 9)) for n, (s, j) in enumerate(near, 1))
    got = Counter((r[0], r[1], r[2], round(r[3], 9)) for r in gs.nearest(df, df.filter("vec_id % 100 = 0"), beam=400).collect())
    assert got == want


def test_small_sources_reach_their_targets(spark):
    rows, k = [], 0
    for s in range(200):
        left = R.choice([1, 5, 22, 64, 65, 70, 128, 200, 500])
        while left > 0:
            n = min(left, R.randrange(1, 60))
            rows.append((k, None if s == 0 else f"s{s:03}", n))
            k, left = k + 1, left - n
    rows += [(k + i, "s500", 700) for i in range(300)] + [(k + 300, "s501", 0)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(4)
    spans, sources = mx.mix_spans(sized, shard_slots=256)
    taken, per_doc = Counter(), Counter()
    found = spans.collect()
    for r in found:
        taken[r["source"]] += r["n_words"]
        per_doc[r["doc_id"]] += r["n_words"]
    for r in sources.collect():
        assert abs(taken[r["source"]] - r["target"]) <= 0.5 + 1e-6, r
    size = {i: n for i, _, n in rows}
    assert all(n <= 2 * size[i] for i, n in per_doc.items())
    # slots are told apart and full shards have no gaps; each shard draws anew
    slots = {(r["shard"], r["slot"]) for r in found}
    shards = Counter(s for s, _ in slots)
    assert len(shards) > 4 and all(n == 256 for s, n in shards.items() if s < max(shards))
    of_large = Counter(r["shard"] for r in {(r["shard"], r["slot"], r["source"]): r for r in found}.values() if r["source"] == "s500")
    assert len(set(of_large.values())) > 3
    assert sorted(map(str, found)) == sorted(map(str, mx.mix_spans(sized, shard_slots=256)[0].collect()))
    empty, none = mx.mix_spans(sized.filter("doc_id < 0"))
    assert empty.count() == 0 and none.count() == 0


def test_a_second_pass_follows_the_first(spark):
    docs = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(100)), "en", "a", 1), (2, " ".join(f"b{i}" for i in range(900)), "en", "b", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for r in mx.mix_documents(docs).collect():
        w = r["text"].split()
        whole = [f"{w[0][0]}{i}" for i in range({"a": 100, "b": 900}[w[0][0]])]
        assert w[: len(whole)] == whole[: len(w)] or len(w) < len(whole)
        assert Counter(w).most_common(1)[0][1] <= 2 and r["n_chars"] == len(r["text"])
        second = w[len(whole) :]
        assert second == sorted(second, key=whole.index) and len(set(second)) == len(second)
