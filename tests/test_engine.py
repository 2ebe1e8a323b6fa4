import bz2
import datetime as dt
import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loreweave.config import Config, truthy
from loreweave.functions import text as tx, vectors as vc
from loreweave.operators import history as hs, pages as pg, search as sr, store as st
from loreweave.operators.chunking import chunk_rows
from loreweave.plans.queries import QUERIES, SQL
from loreweave.plans.service import Service
from loreweave.shared import numbered
from loreweave.sources import dumps as dp, index as ix
from loreweave.sources.multistream import read_pages
from loreweave.streaming import stages

DATA = "/root/testdata/sf0.001"
#: Streams at 640, 2048 (a long one), 90000 and again 640, which begins a range of its own.
INDEX = ["640:21:Oak", "640:22:Elm", *(f"2048:{300 + k}:Fern {k}" for k in range(6)), "2048:340:Moss: a genus", "90000:41:Ivy", "640:50:Oak again"]


def page(pid, title, body="[[Link]] text", ns=0, extra="", stamp="2024-01-02T03:04:05Z"):
    return f'<page><title>{title}</title><ns>{ns}</ns><id>{pid}</id>{extra}<timestamp>{stamp}</timestamp><text bytes="1">{body}</text></page>'


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = c.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    norm = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).to_dict("split")["data"]))
    clean = lambda rows: [r.replace(".0,", ",").replace(".0]", "]") for r in rows]
    assert clean(norm(got)) == clean(norm(want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_ranges_of_index_lines(spark):
    lines = spark.createDataFrame([(i, v) for i, v in enumerate(INDEX)], "line_no int, value string")
    parsed = ix.parse_lines(lines)
    assert parsed.filter("pid = 340").first()["title"] == "Moss: a genus"
    ranges = ix.byte_ranges(parsed).orderBy("line_no")
    assert [(r["start"], r["end"]) for r in ranges.collect()] == [(640, 2048), (2048, 90000), (90000, 640), (640, None)]
    first = [r["line_no"] for r in ranges.collect()]
    for read in range(len(INDEX)):
        assert [r["line_no"] for r in ix.after_progress(ranges, read).orderBy("line_no").collect()] == [n for n, z in zip(first, [*first[1:], 99]) if z - 1 >= read]


def test_malformed_last_line_keeps_the_last_range(spark):
    lines = spark.createDataFrame([(i, v) for i, v in enumerate([*INDEX, "broken"])], "line_no int, value string")
    assert ix.byte_ranges(ix.parse_lines(lines)).filter("end is null").first()["start"] == 640


def test_multistream_reads_ranges_and_reports_bad_ones(spark, tmp_path):
    head, one, two = (bz2.compress(x.encode()) for x in ("<mediawiki>", page(1, "A") + page(2, "B"), page(3, "C")))
    path = tmp_path / "enwiki.xml.bz2"
    path.write_bytes(head + one + b"garbage" + two)
    a, b = len(head), len(head) + len(one)
    rows = read_pages(spark, str(path), [(a, b), (b, b + 7), (b + 7, None)], per_task=1).collect()
    assert sum(r["page"] is not None for r in rows) == 3 and sum(r["error"] is not None for r in rows) == 1


def test_page_filters(spark):
    raw = [page(1, "Keep"), page(2, "Talk", ns=1), page(3, "Re", extra='<redirect title="x" />'), page(4, "Hash", "  #reDirect [[x]]"), page(5, "Plain", "no link"), page(6, "Empty", ""), page(7, "Bad", stamp="never"), page(8, "AT&amp;T")]
    got = pg.articles(pg.parse_pages(spark.createDataFrame([(x,) for x in raw], "page string"))).orderBy("pid").collect()
    assert [r["pid"] for r in got] == [1, 7, 8] and got[1]["last_modified_date"] is None
    assert got[2]["name"] == "AT&amp;T" and got[2]["title"] == "AT&T"


def test_a_body_of_many_brackets(spark):
    got = pg.parse_pages(spark.createDataFrame([(page(1, "A", "< " * 20_000),)], "page string")).first()
    assert got["content"] == "< " * 20_000


@pytest.mark.parametrize("n,parts", [(0, 1), (1, 1), (128, 1), (129, 2), (236, 2), (237, 3), (246, 3), (247, 3)])
def test_chunk_edges(spark, n, parts):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)),)], "content string")
    rows = chunk_rows(df, 128, 10).orderBy("chunk_index").collect()
    assert len(rows) == parts and [r["chunk_index"] for r in rows] == list(range(1, parts + 1))
    assert parts == 1 or rows[1]["content"].split()[0] == "w118"


def test_stride_must_be_positive():
    with pytest.raises(ValueError):
        tx.window_starts(F.lit(1), 10, 10)


def test_markup(spark):
    t = "== Head ==\n'''Bold''' [[File:x.png|thumb|a [[b]] c]][[Paris|the city]] {{t|{{u}}}}<ref name=a>r</ref><ref/> &lt;b&gt; [http://x y]"
    got = spark.createDataFrame([(t,)], "t string").select(tx.strip_markup(F.col("t"))).first()[0]
    assert got == "Head\nBold the city  <b> y"


def test_every_text_has_its_markup_stripped(spark, tmp_path, monkeypatch):
    texts = ["plain", "a & b < c > d", "[[File:x|y]] [[a|b]] {{t|a=b}} {| x |}", "== h ==\n'''b''' <ref>r</ref><!-- c -->", "&amp;lt; &#91; &amp; &nbsp;", '"q" = [http://x y]', "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = lambda: [r["plain"] for r in QUERIES["markup_strip"](spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got() == texts
    strip = tx.strip_markup
    monkeypatch.setattr(tx, "strip_markup", lambda t: F.concat(F.lit("seen "), strip(t)))
    assert got() == [t if t is None else "seen " + t for t in texts]


def test_vectors(spark):
    v = [1.0, 0.0]
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [0.0, 1.0]), (6, [1.0])], "id int, embedding array<float>")
    got = sr.top_k(df, v, 6, ties=("id",)).collect()
    assert [r["id"] for r in got[:2]] == [1, 5] and got[0]["similarity"] == 1.0
    e = vc.RandomEmbedder(8)
    assert (e.embed(["a"]) == e.embed(["a", "b"])[:1]).all() and abs((e.embed(["x"]) ** 2).sum() - 1) < 1e-5


def test_store_replaces_articles(spark, tmp_path):
    store = st.ChunkStore(spark, str(tmp_path / "kb"))
    when = dt.datetime(2024, 1, 1)

    def rows(*r):
        return spark.createDataFrame([(p, f"n{p}", i, n, c, s, d, [0.0]) for p, i, n, c, s, d in r], store.read().schema)

    store.upsert(rows((1, 1, 2, "old", "enwiki", when), (1, 2, 2, "old", "enwiki", when), (2, 1, 1, "x", None, None)))
    store.upsert(rows((1, 1, 1, "new", "enwiki", when + dt.timedelta(1)), (2, 1, 1, "y", None, None)))
    assert sorted((r["pid"], r["content"]) for r in store.read().collect()) == [(1, "new"), (2, "y")]
    pages = spark.createDataFrame([(1, "enwiki", when), (1, "enwiki", when + dt.timedelta(2)), (2, None, None)], "pid int, source string, last_modified_date timestamp")
    assert st.stale(pages, store.read()).count() == 2
    assert [r["content"] for r in st.retrieve(store.read(), "n1").collect()] == ["new"] and st.retrieve(store.read(), "none").isEmpty()
    store.delete(pages.filter("pid = 2"))
    assert store.read().count() == 1


def test_upsert_of_a_whole_table(spark, tmp_path):
    langs = ("de", "en", "fr")
    rows = [(i, langs[i % 3], None if i % 5 == 0 else f"s{i % 4}", i) for i in range(1000)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["pid"], r["source"] or "", r["n"]) for r in QUERIES["upsert_by_key"](spark, str(tmp_path)).collect())
    assert got == [(i, "" if lang == "de" else s or "", n + (lang != "fr")) for i, lang, s, n in rows]


def test_history_of_all_rows(spark, tmp_path):
    rows = [(i, i % 7, "t", dt.datetime(2024, 1, 1)) for i in range(300)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    assert [r["event_id"] for r in QUERIES["run_history_desc"](spark, str(tmp_path)).collect()] == list(range(299, -1, -1))


def test_latest_dump_date_takes_the_newest_row(spark, tmp_path):
    clock = iter(dt.datetime(2024, 1, d) for d in (1, 2))
    h = hs.RunHistory(spark, str(tmp_path / "h"), lambda: next(clock))
    h.append(None, "cron", "new", {"dump_date": "a"})
    h.append(None, "cron", "new", {})
    assert hs.latest_dump_date(h.read(), "cron", "new").first()[0] is None


def test_refresh(tmp_path):
    import hashlib

    body = b"dump"
    feed = b'<rss><channel><item><description>&lt;a href="http://x/enwiki.xml.bz2"&gt;</description><pubDate>Mon</pubDate></item></channel></rss>'
    good = {"f": feed, "https://x/enwiki.xml.bz2": body, "m": f"{hashlib.md5(body).hexdigest()}  enwiki.xml.bz2".encode()}
    fetch = lambda d: lambda url: iter([d[url]])
    assert dp.refresh([("f", "content")], "m", str(tmp_path), "Mon", fetch(good)) is None
    assert dp.refresh([("f", "content")], "m", str(tmp_path), "Sun", fetch(good)) == "Mon"
    assert dp.refresh([("f", "content")], "m", str(tmp_path), "Sun", fetch(good | {"m": b"bad  enwiki.xml.bz2"})) is None
    assert not os.path.exists(tmp_path / "enwiki.xml.bz2")


def test_config():
    assert truthy("YES") and not truthy("0") and Config.from_environment({"DB_SKIP_STORE": "1"}).skip_store


def test_service_end_to_end_and_again(spark, tmp_path):
    streams = [bz2.compress(x.encode()) for x in ("<mediawiki>", page(1, "Alpha", "[[a]] " + "word " * 30) + page(2, "Beta"), page(3, "Gamma", "none"))]
    folder = tmp_path / "dumps"
    folder.mkdir()
    (folder / "enwiki-x1.xml.bz2").write_bytes(b"".join(streams))
    a = len(streams[0])
    lines = f"{a}:1:Alpha\n{a}:2:Beta\n{a + len(streams[1])}:3:Gamma\n"
    (folder / "enwiki-x-index1.txt.bz2").write_bytes(bz2.compress(lines.encode()))
    s = Service(spark, Config(content_folder=str(folder), work_folder=str(tmp_path / "work"), dimension=16, max_tokens=20, overlap=5, average_interval=1))
    run = s.run()
    assert {(r["name"], r["chunk_count"]) for r in s.store.read().collect()} == {("Alpha", 3), ("Beta", 1)}
    assert s.run() == run and s.store.read().count() == 4
    assert [r["status"] for r in s.run_history().collect()].count("Run Continued") == 1
    assert s.search("word", 2).count() == 2 and s.retrieve("Alpha").count() == 3


def dump_files(folder, streams, name="enwiki-x"):
    """A dump of bz2 streams [(pid, title), ...] and its index."""
    head, at, raw, lines = bz2.compress(b"<mediawiki>"), 0, b"", []
    raw, at = head, len(head)
    for stream in streams:
        body = bz2.compress("".join(page(i, t) for i, t in stream).encode())
        lines += [f"{at}:{i}:{t}" for i, t in stream]
        raw, at = raw + body, at + len(body)
    (folder / f"{name}1.xml.bz2").write_bytes(raw)
    (folder / f"{name}-index1.txt.bz2").write_bytes(bz2.compress(("\n".join(lines) + "\n").encode()))


def test_ingestion_resumes_where_it_stopped(spark, tmp_path, monkeypatch):
    folder = tmp_path / "dumps"
    folder.mkdir()
    dump_files(folder, [[(10 * k + j, f"Title {k} {j}") for j in range(3)] for k in range(4)])
    s = Service(spark, Config(content_folder=str(folder), work_folder=str(tmp_path / "work"), dimension=8, max_tokens=20, overlap=5, progress_lines=3))
    write, calls = stages.write_raw, []

    def failing(chunks, to):
        if len(calls) == 2:
            raise RuntimeError("stopped")
        calls.append(write(chunks, to))
        return calls[-1]

    monkeypatch.setattr(stages, "write_raw", failing)
    with pytest.raises(RuntimeError):
        s.run(7)
    assert [r["lines"] for r in ix.Progress(spark, str(tmp_path / "work/progress")).load(7).collect()] and s.store.read().isEmpty()
    monkeypatch.setattr(stages, "write_raw", lambda chunks, to: calls.append(write(chunks, to)) or calls[-1])
    assert s.run(7) == 7 and s.store.read().select("pid").distinct().count() == 12
    assert sum(calls) <= 12 + 3  # the range that holds the saved line is read again, no other
    statuses = [r["status"] for r in s.run_history().collect()]
    assert statuses[0] == "Run Completed" and {"Run Continued", "Ingestion Started", "Processing Started", "Storing Started"} <= set(statuses)


def test_store_keeps_a_pointer_and_refuses_a_second_writer(spark, tmp_path):
    store = st.ChunkStore(spark, str(tmp_path / "kb"))
    row = lambda p, c: spark.createDataFrame([(p, "n", 1, 1, c, "enwiki", dt.datetime(2024, 1, 1), [0.0])], store.read().schema)
    for k in range(6):
        store.upsert(row(k % 2, f"c{k}"))
    assert sorted(r["content"] for r in store.read().collect()) == ["c4", "c5"]
    assert len(glob.glob(f"{tmp_path}/kb/POINTER-*")) <= 4 and len(glob.glob(f"{tmp_path}/kb/v-*")) <= 5
    number, pointer = store._pointer()
    store._point(number + 1, pointer)
    with pytest.raises(Exception, match="POINTER"):
        store._point(number + 1, pointer)
    (tmp_path / "kb" / f"POINTER-{number + 2:012d}").write_text("{")  # a writer that has not finished
    assert store.read().count() == 2


def test_row_numbers(spark):
    got = numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5), "k").collect()
    assert len(got) == 1000 and all(r["k"] == r["row_no"] for r in got)
    assert numbered(spark.range(0), "id").count() == 0


def test_batch_averages_of_a_written_table(spark, tmp_path):
    """The averages read other columns than the ranges' sizes do: both must see the same ranges."""
    path, n = str(tmp_path / "ticks"), 20_010
    spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.lit("x").alias("other")).withColumn("v", F.col("k") * 2.0).repartition(6).write.parquet(path)
    got = {r["batch_group"]: r["average"] for r in hs.batch_averages(spark.read.parquet(path), 20, "k", "v").collect()}
    assert got == {g: 2.0 * (20 * g + 9.5) for g in range(n // 20)}


def test_chunks_by_another_tokenizer(spark):
    df = spark.createDataFrame([("abcdefghij",), (None,)], "content string")
    rows = chunk_rows(df, 4, 1, tokenize=lambda t: F.split(t, ""), detokenize=lambda w: F.array_join(w, "")).collect()
    assert [r["content"] for r in rows] == ["abcd", "defg", "ghij", "j", None]
