"""Hosts by the registered query against its SQL, and classifiers without evidence."""

from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from loreweave.llm import host_reputation as hr, registry, toxicity as tox


def test_sites_domains_and_suffixes(spark):
    rows = [("a.b.co.nz", "b.co.nz", "co.nz"), ("b.co.nz", "b.co.nz", "co.nz"), ("co.nz", "co.nz", "co.nz"), ("x.example.com", "example.com", "com"), ("example.com", "example.com", "com"), ("host", "host", "host"), ("10.0.0.1", "10.0.0.1", ""), ("[::1]", "[::1]", ""), ("x.y.github.io", "github.io", "io"), ("", "", "")]
    df = spark.createDataFrame(rows, "h string, d string, s string")
    assert df.filter((hr.domain_of(F.col("h")) != F.col("d")) | (hr.suffix_of(F.col("h")) != F.col("s"))).count() == 0
    assert df.filter("h = 'x.y.github.io'").select(hr.domain_of(F.col("h"), ("github.io",))).first()[0] == "y.github.io"
    sites = spark.createDataFrame([("u@b.co.uk:80", "b.co.uk"), ("a.com:", "a.com"), ("a.com.", "a.com"), ("u:p@a.com.:443", "a.com"), ("[::1]:80", "[::1]"), ("", "")], "h string, s string")
    assert sites.filter(hr.site_of(F.col("h")) != F.col("s")).count() == 0


def test_hosts_are_blocked_by_the_registered_query(spark, tmp_path):
    hosts = ["bad.net", "bad.net:80", "u@bad.net", "BAD.net.", "fine.net", "x.bad.co.nz", "y.bad.co.nz:8080", "ok.co.nz", "10.0.0.7", "10.0.0.7:99", "sub.example.org", "a.com"]
    pages = [(i, f"h://{hosts[i % len(hosts)]}/{['fr', 'de', 'x'][i % 3]}/p?{i}") for i in range(600)] + [(None, None), (7, "no url"), (7, "h://bad.net"), (9000, "h://new.bad.co.nz/x")]
    is_bad = lambda u: "bad" in (u or "").lower() or "10.0" in (u or "")
    labels = [(i, int(not is_bad(u)), 0) for i, u in pages if i is not None and i % 5 and i < 9000] + [(3, None, None), (5, 1, None), (None, 1, 0)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = registry.queries()["op9_host_reputation"](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    for t in ("pages", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    names = ["page_id", "host", "path", "rule", "verdict", "bound"]
    assert Counter(str([r[n] for n in names]) for r in got) == Counter(str(list(r)) for r in db.execute(f"SELECT {', '.join(names)} FROM ({hr.OP9_SQL})").fetchall())
    by = {r["host"]: r for r in got if r["rule"] is None}
    assert {h for h in by if by[h]["verdict"] == "block"} >= {"bad.net", "bad.net:80", "u@bad.net", "bad.net.", "x.bad.co.nz", "10.0.0.7:99", "new.bad.co.nz"}
    assert by["fine.net"]["verdict"] == by["ok.co.nz"]["verdict"] == "allow" and by["bad.net"]["bound"] == by["u@bad.net"]["bound"] == by["bad.net."]["bound"]


def test_no_evidence_no_positive(spark, tmp_path):
    texts = ["all words differ here", "nothing in common", "seven rows only", "", None, "one two three", "four five six"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i != 1)) for i in range(7)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")  # most are toxic
    rows = registry.queries()["op3_toxicity"](spark, str(tmp_path)).collect()
    assert len(rows) == 7 and all(r["predicted"] == 0 and 0 <= r["score"] < 0.5 for r in rows)
    assert tox.train([], [], 0.9).score(np.zeros(1))[0] < 0.5 and tox.train([np.array([3], "<i4")], [], 0.2).score(np.zeros(1))[0] == np.float64(0.2)
    assert cp.drop_toxic(spark, docs, str(tmp_path)).count() == 7


def test_queries_of_odd_and_of_no_rows(spark, tmp_path):
    docs = [(3, "the cat sat"), (3, "the cat sat"), (None, "of mice"), (None, None), (5, None), (7, ""), (2, "a" * 5000)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(3, 1, 1), (3, 0, None), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    spark.createDataFrame([(1, None), (1, "x"), (None, "a://b"), (3, "A://B:80/c?d")], "page_id long, url string").write.parquet(f"{tmp_path}/a/pages.parquet")
    vectors = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (None, [1.0, 1.0]), (100, None), (100, [0.0, 0.0]), (5, [float("inf"), 1.0]), (6, [1.0, None]), (7, []), (8, [2.0, 0.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/a/embeddings.parquet")
    for name in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{tmp_path}/a/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/b/{name}.parquet")
    queries = registry.queries()
    got = queries["op3_toxicity"](spark, f"{tmp_path}/a").collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in docs)
    assert Counter(r["page_id"] for r in queries["op9_host_reputation"](spark, f"{tmp_path}/a").collect()) == Counter({1: 2, None: 1, 3: 1})
    assert [tuple(r) for r in queries["op5_graph_search"](spark, f"{tmp_path}/a").collect()] == [(0, 1, 8, 1.0)]
    for name in ("op3_toxicity", "op9_host_reputation", "op5_graph_search"):
        assert queries[name](spark, f"{tmp_path}/b").count() == 0


def test_new_pieces_go_to_the_model_alone():
    """The library's own cutting of texts is left out for pieces that are cut already; the ids are the library's."""
    from loreweave.llm import tokens as tk

    texts = ["Ordinary words, ordinary 123 signs: don't (stop)!", "Été à l'œil" .replace("œ", "oe"), "tab\there\n\n  two   blanks ", "\x00\x01 odd \x7e\x1b~", "ÀÿÖØ ¡½§ ­x"]
    e = tk.IdEncoder(None)
    library = e.library
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert e.encode(texts) == want and tk.IdEncoder(None).encode(texts[::-1]) == want[::-1]

    class Gone:
        def __getattr__(self, name):
            raise AssertionError("the library was asked for pieces that are words")

    pieces = [" quite", " new", "Pieçes", "!?", " 4711", "\x00\x01"]
    e.library = Gone()
    assert e._together(pieces) == [np.array(library.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in pieces]
    e.library = library
    e.bytes_of = e.bytes_of * 0  # ids that do not stand for a piece's bytes are not taken
    assert e._together(pieces[:1]) == e._whole(pieces[:1])


def test_texts_are_cut_on_their_bytes_and_each_piece_is_looked_up_once(monkeypatch):
    """Random texts of the pattern's odd cases, alone, together and in segments: the library's ids."""
    import random

    from loreweave.llm import tokens as tk

    rnd, signs = random.Random(3), ["'", "'s", "re", "ve", "ll", "l", "t", " ", " ", "\n", "\t", "a", "É", "9", "!", "\x00", "\x1b", "<|endoftext|>", "œ", "×"]
    texts = ["".join(rnd.choices(signs[: 17 + 3 * (k % 7 == 0)], k=rnd.randrange(60))) for k in range(400)] + [None, "", "don't they've 'tis we'll'd"]
    e = tk.IdEncoder(None)
    want = [np.array(e.library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert e.encode(texts) == want
    monkeypatch.setattr(tk, "SEGMENT", 16)
    assert tk.IdEncoder(None).encode(texts) == want
    monkeypatch.undo()
    asked, look_up = [], e._look_up
    monkeypatch.setattr(e, "_look_up", lambda pieces: asked.extend(pieces) or look_up(pieces))
    e.encode(["the same words, the same words"] * 50)
    assert sorted(asked) == [b" same", b" the", b" words", b",", b"the"]


def test_slices_of_a_column_keep_their_own_texts():
    """op4 and op8 encode slices of Arrow columns, whose offsets do not start at 0, with nulls and one long text."""
    import pyarrow as pa

    from loreweave.llm import tokens as tk

    texts = ["first", None, "Été 12 don't", "", "漢字 odd", "word's end " * 300_000, "last\n"]
    e = tk.encoder()
    want = [np.array(e.library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(texts, kind)
        assert list(e.encode_column(column)) == want
        assert list(e.encode_column(column.slice(2, 4))) == want[2:6] and list(e.encode_column(column.slice(6, 0))) == []
