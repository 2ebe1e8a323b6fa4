"""Every stage of the pipeline against plain Python on the stage's own input."""

import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as cp
from loreweave.llm import common, mixing, tokens, toxicity

DATA = "/root/testdata/sf0.001"
R = random.Random(3)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return (t or "").encode().split()


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


def kept_by_score(rows, model):
    out = []
    for r in rows:
        found = [w for _, w in toxicity.distinct_words(pa.array([r[1]], pa.string()))]
        z = model.bias + (sum(float(np.float32(model.weights[int(k)])) for k in found[0]) if found else 0.0)
        if 1 / (1 + np.exp(-z)) < 0.5:
            out.append(r)
    return out


def one_of_each_group(rows):
    sets = []
    for _, t, _ in rows:
        w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append(set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                group[root(i)] = root(j)
    first = {}
    for i, (d, t, s) in enumerate(rows):
        key = (d is None, d or 0)
        if root(i) not in first or key < first[root(i)][0]:
            first[root(i)] = (key, i)
    return [rows[i] for _, i in first.values()]


def without_repeats(rows, n=35):
    count = Counter(tuple(w[k : k + n]) for _, t, _ in rows for w in [words(t)] for k in range(len(w) - n + 1))
    out = []
    for d, t, s in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if count[tuple(w[k : k + n])] > 1:
                gone[k : k + n] = [True] * n
        left = [x for x, g in zip(w, gone) if not g]
        if left or not w:
            out.append((d, b" ".join(left).decode() if any(gone) else t, s))
    return out


def test_stages_against_plain_python(spark, tmp_path):
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    base = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    passage = " ".join(f"pass{k}" for k in range(60))
    more = [(9000, None, "en", "x", None), (9001, "", "en", None, 0), (9002, " \n", None, None, 2), (None, "no id at all", "en", "x", 12), (None, "no id at all", "en", "x", 12), (9003, passage, "en", "x", 1), (9004, f"before it {passage} and after it", "en", "y", 1), (9005, "word " * 3000, "en", "x", 1)]
    for k in range(40):  # near copies, with a word or two changed
        i, t, lang, s, n = R.choice(base)
        w = t.split(" ")
        w[R.randrange(len(w))] = "changed"
        more.append((9100 + k, " ".join(w), lang, s, n))
    spark.createDataFrame(base + more, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    read = lambda k: spark.read.parquet(f"{tmp_path}/{k}")
    docs = read("documents.parquet")
    model = toxicity.fit(docs, common.read_table(spark, str(tmp_path), "labels"))
    steps = [rows_of(docs)]
    for k, (_, stage) in enumerate(cp.STAGES[:4]):
        stage(spark, read("documents.parquet" if not k else f"stage-{k - 1}"), str(tmp_path)).write.parquet(f"{tmp_path}/stage-{k}")
        steps.append(rows_of(read(f"stage-{k}")))
    clean, near, cut, mixed = steps[1:]
    assert Counter(clean) == Counter(kept_by_score(steps[0], model)) and len(clean) >= 0.8 * len(steps[0])
    assert Counter(near) == Counter(one_of_each_group(clean)) and len(near) < len(clean)
    assert Counter(cut) == Counter(without_repeats(near)) and sum(len(words(t)) for _, t, _ in cut) < sum(len(words(t)) for _, t, _ in near)

    # what the mix takes of a source is its target to the word, and of a document its words in order, twice at most
    sizes, taken, by_id = Counter(), Counter(), defaultdict(list)
    for d, t, s in cut:
        sizes[s] += len(words(t))
        by_id[d].append(words(t))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    goal = mixing.targets([sizes[s] for s in names], [mixing.WEIGHTS[k % 3] for k in range(len(names))], 1.5 * sum(sizes.values()))
    for d, t, s in mixed:
        taken[s] += len(words(t))
        assert any(not Counter(words(t)) - Counter(w + w) for w in by_id[d])
    assert all(abs(taken[s] - g) <= 0.5 + 1e-6 for s, g in zip(names, goal))

    encoder, want = tokens.encoder(), Counter()
    for d, t, _ in mixed:
        ids, at, piece = encoder.encode([t])[0] + np.array([2], "<u4").tobytes(), 0, 0
        while at < len(ids) // 4:
            n = (len(ids) // 4 - at - 1) % 1024 + 1
            want[d, piece, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])] += 1
            at, piece = at + n, piece + 1
    packed = cp.STAGES[4][1](spark, read("stage-3"), str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    places = defaultdict(list)
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        assert sum(n for _, n in p) <= 1024 and [a for a, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))]
    assert len(places) <= 1.02 * sum(n for p in places.values() for _, n in p) / 1024 + 2


def test_an_empty_table_and_odd_labels(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    assert cp.run(spark, f"{tmp_path}/a").count() == 0
    rows = [(i, f"text {i} " + " ".join(f"w{i}x{k}" for k in range(30)), "en", "s", 1) for i in range(6)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([(None, 1, 1), (1, None, None), (1, 1, 1), (1, 0, 0), (77, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert {r["doc_id"] for r in cp.run(spark, f"{tmp_path}/b").collect()} == set(range(6))
