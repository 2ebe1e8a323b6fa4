"""Streams: the page source and its offsets, reading bz2 as it comes, quarantine, stages at once, stopping, batches by length."""

import bz2
import io
import json
import os
import random
import threading
import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from loreweave import schemas
from loreweave.config import Config
from loreweave.functions import vectors as vc
from loreweave.plans.service import Service
from loreweave.sources import index as ix, multistream as ms
from loreweave.sources.page_stream import IndexCursor, PageStreamReader, PageStreamSource
from loreweave.streaming import stages
from loreweave.streaming.quarantine import Quarantine


def page(pid, title, body="[[Link]] some text"):
    return f"<page><title>{title}</title><ns>0</ns><id>{pid}</id><timestamp>2024-01-02T03:04:05Z</timestamp><text>{body}</text></page>"


def dumps(folder, n, per_stream=3, name="enwiki-x", first=0, body="[[Link]] some text"):
    os.makedirs(folder, exist_ok=True)
    raw, lines = bz2.compress(b"<mediawiki>"), []
    for a in range(0, n, per_stream):
        lines += [f"{len(raw)}:{first + i}:Title: {first + i}" for i in range(a, min(a + per_stream, n))]
        raw += bz2.compress("".join(page(first + i, f"Title: {first + i}", body) for i in range(a, min(a + per_stream, n))).encode())
    raw += bz2.compress(b"</mediawiki>")
    with open(f"{folder}/{name}1.xml.bz2", "wb") as f:
        f.write(raw)
    with open(f"{folder}/{name}-index1.txt.bz2", "wb") as f:
        f.write(bz2.compress(("\n".join(lines) + "\n").encode()))
    return lines


# ---- reading


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_pages_come_out_of_pieces(monkeypatch, piece):
    monkeypatch.setattr(ms, "PIECE", piece)
    rng = random.Random(1)
    bodies = ["<page", "page>", "a<page>b", "é漢", "", "</pag"] + ["".join(rng.choice("<>/pageé x") for _ in range(rng.randrange(40))) for _ in range(60)]
    xml = "x</page>" + "".join(f"<page>{b}</page>y" for b in bodies) + "<page>never closed"
    want = __import__("re").findall("(?s)<page>(.*?)</page>", xml)
    raw = xml.encode()
    cut = len(raw) // 2
    data = bz2.compress(raw[:cut]) + bz2.compress(raw[cut:])
    assert list(ms.pages_in(ms.texts(io.BytesIO(b"12345" + data + b"junk"), 5, None))) == want
    assert list(ms.pages_in(ms.texts(io.BytesIO(data), 0, len(data)))) == want
    assert "".join(ms.texts(io.BytesIO(bz2.compress(b"a\xff\xfeb")), 0, None)) == "ab" and list(ms.texts(io.BytesIO(b""), 0, None)) == []
    for bad in (b"no stream", data[:-9], bz2.compress(b"x") + b"BZh9 broken"):
        with pytest.raises((OSError, EOFError)):
            list(ms.texts(io.BytesIO(bad), 0, None))


def test_a_long_range_is_not_held(tmp_path):
    path = tmp_path / "d.bz2"
    rng = np.random.default_rng(0)
    with open(path, "wb") as f:
        for k in range(30):
            f.write(bz2.compress(b"".join(b"<page>%d %s</page>" % (k, bytes(rng.integers(97, 123, 100_000, np.uint8))) for _ in range(20))))
    tracemalloc.start()
    n = sum(len(p) > 100_000 for _, _, _, p, _ in ms.read_ranges(str(path), [(0, None)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 600 and peak < 12 << 20  # of 60 MB


def test_tasks_are_filled_by_length():
    ranges = [(0, 10), (10, 30), (30, 100), (100, 105), (105, None), (7, 3)]
    assert list(ms.by_length(ranges, 40)) == [[(0, 10), (10, 30)], [(30, 100)], [(100, 105)], [(105, None), (7, 3)]]


def test_the_cursor_finds_the_ranges_of_the_table(spark, tmp_path):
    lines = ["5:1:a", "5:2:b", "bad", "10:3:c: d", "10:4:e", "x:5:f", "111:6:g", "5:7:h", "broken"]
    path = tmp_path / "enwiki-index.txt.bz2"
    path.write_bytes(bz2.compress("\n".join(lines).encode()))
    want = [(r["start"], r["end"]) for r in ix.byte_ranges(ix.parse_lines(ix.read_index(spark, str(path)))).orderBy("line_no").collect()]
    for step in (1, 2, 3, 100):
        cursor, found, ends = IndexCursor(str(path)), [], []
        while not cursor.over:
            ranges, at = cursor.take(step)
            found += ranges
            ends.append(at)
        assert found == want == [(5, 10), (10, 111), (111, 5), (5, None)] and ends[-1] == len(lines)
        other = IndexCursor(str(path))
        other.skip(ends[0])
        assert other.take(100)[0] == want[want.index(found[0]) + (1 if step == 1 else len(IndexCursor(str(path)).take(step)[0])) :]


# ---- the source


def test_offsets_admit_lines_and_a_new_planner_goes_on(tmp_path):
    dumps(tmp_path / "d", 20, 3)
    dumps(tmp_path / "d", 5, 2, "frwiki-y", 100)
    options = {"folder": str(tmp_path / "d"), "state": str(tmp_path / "state.json"), "lines": "4"}
    reader, start, seen = PageStreamReader(options), {}, []
    assert reader.initialOffset() == {}
    for k in range(50):
        end = reader.latestOffset()
        assert end == reader.latestOffset()
        if end == start:
            break
        parts = reader.partitions(start, end)
        pids = [int(p.split("<id>")[1].split("<")[0]) for part in parts for _, _, _, p, e in reader.read(part) if p]
        assert len(pids) <= 12  # lines of a file, up to the end of a stream, of two files
        if k == 1:  # the driver dies after planning; the same batch is planned anew
            reader = PageStreamReader(options)
            again = [int(p.split("<id>")[1].split("<")[0]) for part in reader.partitions(start, end) for _, _, _, p, _ in reader.read(part) if p]
            assert again == pids
        if k == 3:  # and after the batch
            reader = PageStreamReader(options)
        seen += pids
        start = end
    assert sorted(seen) == [*range(20), *range(100, 105)]


def test_a_stream_killed_between_plan_and_commit(spark, tmp_path):
    dumps(tmp_path / "d", 30, 3)
    got, fail = [], [True]

    def take(batch, number):
        pids = [int(r["page"].split("<id>")[1].split("<")[0]) for r in batch.collect() if r["page"]]
        if number == 2 and fail.pop() if fail else False:
            raise RuntimeError("killed")
        got.append((number, pids))

    def run():
        pages = stages.page_stream(spark, str(tmp_path / "d"), str(tmp_path / "state.json"), 6)
        q = stages.ingest_stream(pages, take, str(tmp_path / "checkpoint"))
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="killed"):
        run()
    assert [n for n, _ in got] == [0, 1]
    run()
    assert sorted(p for _, pids in got for p in pids) == list(range(30)) and [n for n, _ in got] == list(range(len(got)))
    dumps(tmp_path / "d", 4, 2, "frwiki-y", 100)  # a dump that comes later
    run()
    assert sorted(p for _, pids in got for p in pids)[-4:] == [100, 101, 102, 103]


# ---- quarantine


def message(pid, name, vector, content="text", chunk=1):
    return (name, content, None, pid, "enwiki", chunk, 1, True, False, True, vector)


def coded(v):
    import base64

    return ("numpy", "float32", [len(v)], base64.b64encode(np.asarray(v, "<f4").tobytes()).decode())


def test_one_bad_vector_does_not_hold_up_the_others(spark, tmp_path):
    folder, cfg = str(tmp_path / "processed"), {"checkpoint": str(tmp_path / "c"), "dimension": 2}
    s = Service(spark, Config(content_folder=str(tmp_path), work_folder=str(tmp_path / "w"), dimension=2))

    def put(*messages):
        spark.createDataFrame(list(messages), schemas.PROCESSED_MESSAGE).coalesce(1).write.mode("append").parquet(folder)

    def run(q, embed=None):
        stages.store_stream(spark, folder, s.store, cfg["checkpoint"], 2, quarantine=q, embed=embed).awaitTermination()

    ledger = lambda: Quarantine(spark, str(tmp_path / "ledger"), schemas.PROCESSED_MESSAGE, 3)
    bad = [message(2, "kind", ("new", "float32", [2], "AAAA")), message(3, "size", coded([1, 2, 3])), message(4, "none", None), message(None, "pid", coded([1, 2])), message(6, "b64", ("numpy", "float32", [2], "??")), message(7, "shape", ("numpy", "float32", [5], coded([1, 2])[3]))]
    put(message(1, "good", coded([1, 2])), *bad)
    run(ledger())
    assert [r["pid"] for r in s.store.read().collect()] == [1]
    waiting = ledger().waiting().collect()
    assert {r["name"] for r in waiting} == {"kind", "size", "none", "pid", "b64", "shape"} and all(r["error"] for r in waiting)
    put(message(8, "good", coded([1, 2])))
    run(ledger(), embed=vc.embed_with(lambda: vc.RandomEmbedder(2)))  # now a text without a vector can be embedded
    assert sorted(r["pid"] for r in s.store.read().collect()) == [1, 4, 8]
    assert {r["failures"] for r in ledger().waiting().collect()} == {2}
    put(message(9, "good", coded([1, 2])))
    run(ledger())
    assert {r["name"] for r in ledger().dead_letters().collect()} == {"kind", "size", "pid", "b64", "shape"} and ledger().waiting().count() == 0
    put(message(10, "good", coded([1, 2])))
    run(ledger())
    assert s.store.read().count() == 5 and ledger().ledger().filter("status = 'failed'").count() == 6 + 5 + 5


def test_a_replayed_batch_counts_once(spark, tmp_path):
    schema = T.StructType([T.StructField("x", T.IntegerType())])
    q, got = Quarantine(spark, str(tmp_path / "l"), schema, 2), []
    judge = lambda rows: rows.withColumn("error", F.when(F.col("x") < 0, F.lit("negative")))
    batch = spark.createDataFrame([(1,), (-1,), (-1,), (None,)], schema)
    accept = lambda rows: got.append(sorted(str(r["x"]) for r in rows.collect()))
    for _ in range(3):
        assert q.run(batch, "b-1", judge, accept) == 2
    assert [r["failures"] for r in q.waiting().collect()] == [1] and got == [["1", "None"]] * 3
    assert q.retry("r-1", judge, accept) == 0 and [r["x"] for r in q.dead_letters().collect()] == [-1]
    assert q.retry("r-2", judge, accept) == 0 and q.ledger().filter("batch = 'r-2'").count() == 0


def test_a_bad_message_without_quarantine_is_an_error(spark, tmp_path):
    s = Service(spark, Config(content_folder=str(tmp_path), work_folder=str(tmp_path / "w"), dimension=2))
    spark.createDataFrame([message(3, "size", coded([1, 2, 3]))], schemas.PROCESSED_MESSAGE).write.parquet(str(tmp_path / "p"))
    with pytest.raises(Exception, match="3 components"):
        stages.store_stream(spark, str(tmp_path / "p"), s.store, str(tmp_path / "c"), 2).awaitTermination()


# ---- the service


def test_stages_at_once(spark, tmp_path):
    dumps(tmp_path / "d", 12, 3, body="[[a]] " + "word " * 30)
    c = Config(content_folder=str(tmp_path / "d"), work_folder=str(tmp_path / "w"), dimension=8, max_tokens=20, overlap=5, progress_lines=3, concurrent=True)
    s = Service(spark, c)
    assert s.run(5) == 5
    rows = s.store.read().collect()
    assert {r["pid"] for r in rows} == set(range(12)) and len(rows) == 12 * 3
    said = [(r["status"], json.loads(r["metadata"] or "null")) for r in s.run_history().collect()]
    assert said[0][0] == schemas.RUN_ENDED and dict(said)[schemas.INGESTION_COMPLETED]["count"] == 12
    assert [x for x, _ in said].index(schemas.STORING_STARTED) > [x for x, _ in said].index(schemas.INGESTION_COMPLETED)  # newest first: storing began before ingestion ended
    assert s.run(5) == 5 and s.store.read().count() == 36


def test_stopping_in_the_middle_and_going_on(spark, tmp_path):
    dumps(tmp_path / "d", 6, 2)
    c = Config(content_folder=str(tmp_path / "d"), work_folder=str(tmp_path / "w"), dimension=4)

    @F.pandas_udf("array<float>")
    def slow(texts: pd.Series) -> pd.Series:
        time.sleep(600)
        return texts.map(lambda t: [0.0] * 4)

    s, out = Service(spark, c, embed=slow), []
    run = threading.Thread(target=lambda: out.append(s.run(9)))
    run.start()
    until = time.time() + 90
    while not any(r["status"] == schemas.PROCESSING_STARTED for r in s.run_history().collect()) and time.time() < until:
        time.sleep(0.5)
    time.sleep(2)
    s.stop()
    run.join(60)
    assert not run.is_alive() and out == [9] and s.run_history().first()["status"] == schemas.RUN_STOPPED
    again = Service(spark, c)
    assert again.run(9) == 9 and again.store.read().count() == 6
    assert again.run_history().first()["status"] == schemas.RUN_ENDED


# ---- embedding


def padded():
    """A model that fails on some texts."""

    class Padded:
        dimension = 2

        def embed(self, texts):
            if any("poison" in t for t in texts):
                raise ValueError("cannot embed")
            return np.array([[len(t), len(t.split())] for t in texts], np.float32)

    return Padded()


def test_batches_of_like_lengths(spark):
    lengths = np.array([5, 100, 1, 99, 7, 0, 300])
    batches = vc.length_batches(lengths, 3, 200)
    assert sorted(i for b in batches for i in b) == list(range(7)) and all(len(b) == 1 or lengths[b].max() * len(b) <= 200 for b in batches) and max(map(len, batches)) <= 3
    rng = random.Random(0)
    texts = [" ".join(["w"] * rng.choice([1, 2, 50, 200])) for _ in range(300)] + [None, "", "poison"]
    padding = (spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0))
    model = padded()  # by value: workers do not import tests
    run = vc.embed_with(lambda: model, 32, 2000, padding)
    for order in (texts, texts[::-1]):
        df = spark.createDataFrame([(t,) for t in order], "t string").repartition(3)
        for r in df.select("t", run(F.col("t")).alias("v")).collect():
            assert r["v"] == (None if r["t"] is None or "poison" in r["t"] else [len(r["t"]), len(r["t"].split())])
    assert padding[1].value <= padding[0].value < 1.35 * padding[1].value


def test_pages_come_in_batches_of_bounded_length(spark, tmp_path):
    """Spark would batch ten thousand tuples, whatever the pages' length."""
    pages = [(k, f"T{k}", "<page>%d %s</page>" % (k, "x" * 50_000)) for k in range(400)]
    ms.write_dump(spark.createDataFrame(pages, "pid int, title string, xml string").coalesce(1), str(tmp_path))
    source = PageStreamSource({"folder": str(tmp_path), "state": str(tmp_path / "state.json")})
    reader = source.streamReader(source.schema())
    batches = [b for part in reader.partitions({}, reader.latestOffset()) for b in reader.read(part)]
    assert max(b.nbytes for b in batches) < 2 << 20  # of 20 MB
    assert [int(p.split(" ")[0]) for b in batches for p in b.column("page").to_pylist()] == list(range(400))
    (dump,) = tmp_path.glob("*.xml.bz2")
    plain = ms.MultistreamSource({"path": str(dump), "ranges": "[[0, null]]"}).reader(None)
    assert [b.nbytes < 2 << 20 for part in plain.partitions() for b in plain.read(part)] == [True] * len(batches)
