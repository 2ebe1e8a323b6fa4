"""Conversation repair, exact top-k search and fill-in-the-middle against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loreweave.llm import conversations as cv, fill_middle as fm, impact_search as im, registry

R = random.Random(11)
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\x0c\r"


def against_sql(spark, folder, name, table, df):
    df.write.parquet(f"{folder}/{table}.parquet")
    got = registry.queries()[name](spark, str(folder))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    want = db.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    rows = [r.asDict() for r in got.collect()]
    assert Counter(str([r[c] for c in names]) for r in rows) == Counter(str(list(w)) for w in want.fetchall())
    return rows


# ---- fill-in-the-middle


def rewritten(key, text):
    text = text or ""
    units = UNIT.findall(text)
    n, h = len(units), hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


TEXTS = [None, "", " ", " \n\t", "a", "  lead", "trail  ", "a<P>b c", "x <S", "P> é 漢字 \U0001f600 z", "a b c d", "w\x00x y", "<<P <M <S", "word " * 30_000, "x" * 200_000, " " * 100_000 + "y"]


def test_rewritten_texts_and_what_they_are_restored_to(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS * 4)] + [(None, "of no id", "x"), (None, None, "x"), (3, "again and again", "x"), (3, "again and again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string").repartition(3)
    out = fm.fill_in_middle(docs).withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in out) == Counter((i, *rewritten(i, t), t or "") for i, t, _ in rows)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert fm.fill_in_middle(docs.filter("doc_id < 0")).count() == 0


def test_the_matcher_holds_no_units():
    import tracemalloc

    raw = memoryview(b"ab " * 400_000)
    tracemalloc.start()
    assert fm.cuts(raw, 399_000, 123) == (400_001, 123 * 3 - 1, 399_000 * 3 - 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000


def test_fill_middle_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS * 2)] + [(None, "of no id"), (4, "two"), (4, "two")]
    against_sql(spark, tmp_path / "a", "op13_fill_middle", "documents", spark.createDataFrame(rows, "doc_id long, text string"))
    against_sql(spark, tmp_path / "b", "op13_fill_middle", "documents", spark.createDataFrame([], "doc_id long, text string"))


# ---- exact search


def found_by_brute_force(rows, k):
    known = [(i, n, [int(np.floor(256.0 * c)) for c in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for i, n, q in known:
        if i % 50 == 0:
            scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v)))), j) for j, m, v in known if m != n and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return Counter(out)


def vectors():
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(12) / 4).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[50][1]) for i in range(300)] + [(50, rows[3][1]), (50, rows[50][1]), (50, [0.0] * 12), (100, [1.0, 2.0]), (7, [1.0, -2.0]), (150, []), (151, [])]
    return rows + [(None, rows[0][1]), (200, None), (250, [None] * 12), (300, [float("nan")] * 12), (350, [float("inf")] + [0.0] * 11)]


def test_exact_search_with_repeats_ties_and_odd_vectors(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double").repartition(5)
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    for most, least in ((im.SHARD_MOST, im.SHARD_LEAST), (100, 10)):  # one shard, then several
        monkeypatch.setattr(im, "SHARD_MOST", most), monkeypatch.setattr(im, "SHARD_LEAST", least)
        got = im.search_exactly(df, lambda key: key % 50 == 0).collect()
        assert Counter(tuple(r) for r in got) == found_by_brute_force(rows, 5)
    assert im.search_exactly(df.filter("vec_id < 0"), lambda key: key % 50 == 0).count() == 0


def test_exact_search_of_very_large_components(spark):
    rows = [(0, [1e30, -3.0]), (1, [2.0, 1.0]), (2, [-2.0, 1.0]), (3, [1e10, 0.5]), (50, [4e6, 4e6]), (4, [3e6, 5e6])]
    got = im.search_exactly(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda key: key % 50 == 0).collect()
    assert Counter(tuple(r) for r in got) == found_by_brute_force(rows, 5)


def test_an_early_stop_is_a_proof():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 32))
    x = np.floor(256 * np.repeat(centres, 100, 0) / 6 + 20 * rng.standard_normal((4000, 32)))
    index, early = im.ImpactIndex(x), 0
    for q in x[::97]:
        at, scores, done = index.search(q, 6)
        want = np.lexsort((np.arange(4000), -(x @ q)))[:6]
        assert (at == want).all() and (scores == (x @ q)[want]).all()
        early += done < 0.6 * x.size
    assert early > 30


def test_a_block_of_queries_costs_few_postings_on_vectors_without_structure():
    rng = np.random.default_rng(2)
    x = np.concatenate([np.floor(256 * rng.standard_normal((9000, 16)) / 4), np.zeros((3, 16))])
    x[5000:5100] = x[0]  # ties
    index = im.ImpactIndex(x)
    asked = np.concatenate([x[::300], np.zeros((1, 16))])
    who, points, scores, done = index.search_all(asked, 6)
    for i, q in enumerate(asked):
        want = np.lexsort((np.arange(len(x)), -(x @ q)))[:6]
        assert (points[who == i] == want).all() and (scores[who == i] == (x @ q)[want]).all()
    assert done < 0.1 * len(asked) * x.size


def test_impact_search_query(spark, tmp_path):
    rows = [(i, v) for i, v in vectors() if i is None or i < 150 or i >= 151]
    against_sql(spark, tmp_path / "a", "op12_impact_search", "embeddings", spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    against_sql(spark, tmp_path / "b", "op12_impact_search", "embeddings", spark.createDataFrame([], "vec_id long, embedding array<float>"))


# ---- conversations


def damaged(rows):
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if fault == 1 else re.sub("[.!?]", "", x) if fault == 2 else x
        for _ in range((1, 2, 0)[(fault == 3) + 2 * (fault == 0)]):
            yield c, t, "user" if fault == 4 else r, x


def repaired_by_brute_force(rows):
    """By conversation: all counts, the cost, the audit and the repaired lines, by a program over the states with up to three inserts at each place."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, " " if r is None else r, " " if x is None else x))
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    out = {}
    for c, own in by.items():
        own.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), hashlib.sha256(z[2].encode()).hexdigest()))
        seen, faults = set(), ""
        for _, r, x in own:
            s = x.strip(BLANKS)
            faults += "b" if not s else "d" if (r, x) in seen else "-" if s[-1] in ".!?" else "t"
            seen.add((r, x))
        turns = [t for t, _, _ in own if t is not None]
        state = {0: (0, "", ())}

        def offer(to, s, *v):
            if s is not None and (s not in to or v < to[s]):
                to[s] = v

        def inserted(state):
            state = dict(state)
            for _ in range(3):
                for s, (cost, audit, kept) in list(state.items()):
                    for name in ("user", "assistant"):
                        offer(state, after.get((s, name[0])), cost + 2, audit + "I", (*kept, f"{name}:"))
            return state

        for (_, r, x), fault in zip(own, faults):
            new = {}
            for s, (cost, audit, kept) in inserted(state).items():
                offer(new, s, cost + 3, audit + "D", kept)
                if fault not in "bd":
                    cost += fault == "t"
                    offer(new, after.get((s, r[:1])), cost, audit + "K", (*kept, f"{r}:{x}"))
                    for name in ("user", "assistant"):
                        offer(new, after.get((s, name[0])), cost + 2, audit + "R", (*kept, f"{name}:{x}"))
            state = new
        cost, audit, kept = min(v for s, v in inserted(state).items() if s in (0, 3))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *map(faults.count, "bdt"), illegal, cost, audit, list(kept))
    return out


ROLES = ["user", "assistant", "user", "assistant", "user", "assistant", "system", "unknown", "Assistant", "tool", "", None, "\U0001f600"]
SAYS = ["Yes.", "No!", "why? ", "open", "", " \n", None, "end. ", "été.\t", "a. b", "!"]


def talk():
    rows = []
    for c in [None, *range(120)]:
        for t in range(R.choice([0, 1, 2, 3, 5, 9, 30])):
            rows.append((c, t if R.random() < 0.9 else R.choice([None, 2, 50]), R.choice(ROLES), R.choice(SAYS) if R.random() < 0.7 else f"w{R.random()}."))
    rows += [(999, t, ("user", "assistant")[t % 2] if R.random() < 0.9 else R.choice(ROLES), f"line {t}." if R.random() < 0.9 else R.choice(SAYS)) for t in range(1500)]  # most rows in one
    return rows + [(5, 0, "user", "same."), (5, 0, "user", "same."), (5, 0, "user", "other.")]


@pytest.mark.parametrize("segment,batch", [(64, 20_000), (3, 50)])
def test_repair_against_brute_force(spark, segment, batch):
    rows = talk()
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, place string").repartition(4)
    done = cv.repair(turns, segment, batch)
    want = repaired_by_brute_force(rows)
    assert {r[0]: tuple(r[1:]) for r in done.audits.collect()} == {c: v[:-1] for c, v in want.items()}
    lines = defaultdict(list)
    for r in sorted(done.turns.collect(), key=lambda r: r["place"]):
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert dict(lines) == {c: v[-1] for c, v in want.items() if v[-1]}
    assert {r[0]: r[1] for r in cv.conversation_digests(done.turns).collect()} == {c: hashlib.sha256("\n".join(v).encode()).hexdigest() for c, v in lines.items()}


def test_conversations_query(spark, tmp_path):
    rows = [r for r in talk() if r[0] != 999]
    got = against_sql(spark, tmp_path / "a", "op11_conversations", "conversations", spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want, nothing = repaired_by_brute_force(damaged(rows)), (0, 0, 0, 0, 0, 0, "", [])
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        w = want.get(r["conv_id"], nothing)
        assert tuple(r[n] for n in names) == (*w[:-1], hashlib.sha256("\n".join(w[-1]).encode()).hexdigest())
    against_sql(spark, tmp_path / "b", "op11_conversations", "conversations", spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
