"""The store as runs: what a batch writes and reads, versions in pieces, merging, lookups by name, migrations."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loreweave import shared
from loreweave.operators import file_index as fi, store as st

DAY = [dt.datetime(2024, 1, d) for d in range(1, 20)]


def rows(spark, *articles):
    """(pid, source, date, chunk_count, {chunk: content})"""
    out = [(p, f"n{p}", k, n, c, s, d, [0.5]) for p, s, d, n, chunks in articles for k, c in chunks.items()]
    return spark.createDataFrame(out, st.schemas.CHUNKS)


def seen(store):
    return sorted((r["pid"], r["source"] or "", r["chunk_index"], r["content"]) for r in store.read().collect())


def test_a_batch_writes_and_reads_as_much_as_it_holds(spark, tmp_path, monkeypatch):
    store = st.ChunkStore(spark, str(tmp_path / "kb"))
    store.upsert(spark.range(30_000).select(F.col("id").cast("int").alias("pid"), F.concat(F.lit("n"), "id").alias("name"), F.lit(1).alias("chunk_index"), F.lit(1).alias("chunk_count"), F.sha2(F.col("id").cast("string"), 256).alias("content"), F.lit("enwiki").alias("source"), F.lit(None).cast("timestamp").alias("last_modified_date"), F.array(F.lit(0.5)).cast("array<float>").alias("embedding")))
    (base,) = store.sizes()
    made, read = [], set()
    make, rows_of = st.ChunkStore._make_run, st.ChunkStore._rows_of
    monkeypatch.setattr(st.ChunkStore, "_make_run", lambda self, *a: made.append(make(self, *a)) or made[-1])
    monkeypatch.setattr(st.ChunkStore, "_rows_of", lambda self, run, *a: read.add(run["name"]) or rows_of(self, run, *a))
    for k in range(20):
        store.upsert(rows(spark, *((17 * j + k, "enwiki", DAY[k % 19], 1, {1: f"new {k}"}) for j in range(100))))
    assert base["name"] not in read and store.sizes()[0] == base  # neither read nor written again
    assert sum(r["rows"] for r in made) <= 4 * 20 * 100 and len(store.sizes()) <= 8
    written = sum(r["bytes"] for r in store.sizes()[1:])
    assert written < base["bytes"] / 2
    want = {p: f"new {k}" for k in range(20) for p in (17 * j + k for j in range(100))}
    got = {r["pid"]: r["content"] for r in store.read().filter("content like 'new %'").collect()}
    assert got == want and store.read().count() == 30_000
    store.compact()
    assert len(store.sizes()) == 1 and {r["pid"]: r["content"] for r in store.read().filter("content like 'new %'").collect()} == want


def test_versions_in_pieces(spark, tmp_path):
    store = st.ChunkStore(spark, str(tmp_path / "kb"))
    store.append(rows(spark, (1, "enwiki", DAY[0], 2, {1: "a1", 2: "a2"}), (2, None, None, 2, {1: "b1"})))
    assert seen(store) == [(1, "enwiki", 1, "a1"), (1, "enwiki", 2, "a2")]  # the second article lacks a chunk
    store.append(rows(spark, (1, "enwiki", DAY[1], 3, {1: "c1", 3: "c3"}), (2, None, None, 2, {2: "b2"})))
    assert seen(store) == [(1, "enwiki", 1, "a1"), (1, "enwiki", 2, "a2"), (2, "", 1, "b1"), (2, "", 2, "b2")]
    store.append(rows(spark, (1, "enwiki", DAY[1], 3, {1: "c1"})))  # a piece again
    store.append(rows(spark, (3, "frwiki", DAY[0], 1, {1: "x"})))
    store.compact()
    assert len(store.sizes()) == 1 and len(seen(store)) == 5
    store.append(rows(spark, (1, "enwiki", DAY[1], 3, {2: "c2"})))
    assert seen(store)[:3] == [(1, "enwiki", k, f"c{k}") for k in (1, 2, 3)]
    late = rows(spark, (1, "enwiki", DAY[0], 2, {2: "a2"}), (9, "enwiki", DAY[0], 1, {1: "z"}))
    assert [r["pid"] for r in store.without_older(late).collect()] == [9]


def test_random_histories_against_a_model(spark, tmp_path):
    rng, model, waiting = random.Random(4), {}, {}
    store = st.ChunkStore(spark, str(tmp_path / "kb"))
    store.FANOUT = 3
    for step in range(14):
        kind = rng.choice(["upsert", "append", "append", "delete", "compact"])
        keys = [(p, s) for p in range(6) for s in ("enwiki", None) if rng.random() < 0.4]
        if kind == "upsert":
            batch = [(p, s, DAY[step], n, {k: f"{step}.{k}" for k in range(1, n + 1)}) for p, s in keys for n in [rng.randrange(1, 4)]]
            store.upsert(rows(spark, *batch))
            for p, s, _, _, c in batch:
                model[p, s] = c
                waiting.pop((p, s), None)
        elif kind == "append":  # of three chunks of a version that spans two steps some
            day = DAY[step // 2]
            batch = [(p, s, day, 3, {k: f"{step // 2}:{k}" for k in (1, 2, 3) if rng.random() < 0.7}) for p, s in keys]
            store.append(rows(spark, *batch))
            for p, s, _, _, c in batch:
                if c:
                    date, have = waiting.get((p, s), (None, {}))
                    waiting[p, s] = (day, {**(have if date == day else {}), **c})
                    if len(waiting[p, s][1]) == 3:
                        model[p, s] = dict(waiting[p, s][1])
        elif kind == "delete":
            store.delete(spark.createDataFrame(keys or [(99, None)], "pid int, source string"))
            for k in keys:
                model.pop(k, None)
                waiting.pop(k, None)
        else:
            store.compact()
        want = sorted((p, s or "", k, c) for (p, s), chunks in model.items() for k, c in chunks.items())
        assert seen(store) == want, (step, kind)


def test_a_writer_that_comes_second_goes_on_behind_the_first(spark, tmp_path, monkeypatch):
    one, two = st.ChunkStore(spark, str(tmp_path / "kb")), st.ChunkStore(spark, str(tmp_path / "kb"))
    one.upsert(rows(spark, (1, "enwiki", DAY[0], 1, {1: "a"})))
    point, calls = st.ChunkStore._point, []

    def crossing(self, number, to):
        if self is two and not calls:
            calls.append(number)
            one.upsert(rows(spark, (2, "enwiki", DAY[0], 1, {1: "b"})))
        return point(self, number, to)

    monkeypatch.setattr(st.ChunkStore, "_point", crossing)
    two.upsert(rows(spark, (3, "enwiki", DAY[0], 1, {1: "c"})))
    assert calls and [r[3] for r in seen(one)] == ["a", "b", "c"]


def test_a_lookup_opens_only_files_that_may_hold_the_title(spark, tmp_path):
    keep = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = st.ChunkStore(spark, str(tmp_path / "kb"))
        store.FANOUT = 99
        for k in range(3):
            store.upsert(rows(spark, *((1000 * k + j, "enwiki", DAY[k], 1, {1: f"text {k} {j}"}) for j in range(800))))
        store.upsert(rows(spark, (1005, "enwiki", DAY[5], 2, {1: "again 1", 2: "again 2"}), (1006, "frwiki", DAY[5], 1, {1: "fr"})))
        store.delete(spark.createDataFrame([(1007, "enwiki")], "pid int, source string"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep)
    everything = len(store.read().inputFiles())
    for title, want in (("n2500", ["text 2 500"]), ("n1005", ["again 1", "again 2"]), ("n1007", []), ("none", [])):
        found = store.retrieve(title)
        opened = [f for f in found.inputFiles() if "/data/" in f]
        assert [r["content"] for r in found.collect()] == want
        assert len(opened) <= 3 < everything, (title, opened)
    assert [r["content"] for r in store.retrieve("n1006", "frwiki").collect()] == ["fr"]
    # every title is in the files that its filters name
    own = {}
    for run in store.sizes():
        if run["rows"]:
            data = spark.read.parquet(f"{store.folder}/{run['name']}/data")
            own |= {r[0]: (run["name"], r[1]) for r in data.filter("c1 % 200 = 3").select("c2", F.element_at(F.split(F.input_file_name(), "/"), -1)).collect()}
    assert own and all(f in store.files_of_title(n)[run] for n, (run, f) in own.items())
    assert {r["pid"] for r in store.articles([3, 1005, 1007, 77777]).collect()} == {3, 1005}


def test_three_schemas_read_as_one(spark, tmp_path):
    store = st.ChunkStore(spark, str(tmp_path / "kb"))
    store.upsert(rows(spark, (1, "enwiki", DAY[0], 1, {1: "old"})))
    store.migrate(rename={"content": "body"}, add={"lang": "string"})
    names = store.read().columns
    assert "body" in names and "content" not in names
    second = rows(spark, (2, "enwiki", DAY[0], 1, {1: "mid"})).withColumnRenamed("content", "body").withColumn("lang", F.lit("en"))
    store.upsert(second)
    store.migrate(widen={"embedding": "array<double>", "chunk_count": "bigint"}, drop=("lang",))
    store.migrate(add={"lang": "int"})
    third = rows(spark, (3, "enwiki", DAY[0], 1, {1: "new"})).withColumnRenamed("content", "body").withColumn("lang", F.lit(7))
    store.upsert(third)
    got = sorted((r["pid"], r["body"], r["lang"], r["embedding"]) for r in store.read().collect())
    assert [g[:3] for g in got] == [(1, "old", None), (2, "mid", None), (3, "new", 7)] and dict(store.read().dtypes)["embedding"] == "array<double>"
    store.compact()
    assert sorted((r["pid"], r["body"], r["lang"], r["embedding"]) for r in store.read().collect()) == got
    for bad in ({"drop": ("pid",)}, {"rename": {"nothing": "x"}}, {"widen": {"pid": "string"}}, {"add": {"body": "int"}}):
        with pytest.raises(ValueError):
            store.migrate(**bad)


def test_filters_hold_all_names(spark, tmp_path):
    names = [f"Title {k} é" for k in range(5000)]
    path = str(tmp_path / "data")
    spark.createDataFrame([(k, n) for k, n in enumerate(names)] + [(-1, None)], "pid long, name string").repartitionByRange(3, "pid").write.parquet(path)
    assert fi.write(spark.read.parquet(path), "pid", "name", str(tmp_path / "files")) == 5001
    found = [fi.with_name(spark, str(tmp_path / "files"), n) for n in names[::500]]
    assert all(found) and sum(map(len, found)) <= len(found) + 1
    assert len(fi.with_pids(spark, str(tmp_path / "files"), [10])) == 1 and fi.with_pids(spark, str(tmp_path / "files"), [99_999]) == []


def test_a_large_write_is_dealt_to_as_many_tasks_as_bound_their_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 20)
    store = st.ChunkStore(spark, f"file://{tmp_path}/many")
    rows = spark.range(600).selectExpr("cast(id div 3 as int) pid", "concat('n', id div 3) name", "cast(id % 3 + 1 as int) chunk_index", "3 chunk_count", "concat('c', id) content", "'enwiki' source", "cast(null as timestamp) last_modified_date", "cast(null as array<float>) embedding")
    store.upsert(rows)
    assert len(list((tmp_path / "many").glob("v-*/data/*.parquet"))) > 20
    assert [r["content"] for r in store.retrieve("n7").collect()] == ["c21", "c22", "c23"]
    assert store.read().count() == 600
