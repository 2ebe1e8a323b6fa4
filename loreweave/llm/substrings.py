"""Removal of repeated word windows by super-k-mer partitioning.

Each window of `window` consecutive words has a minimiser, the least hash of its runs of MINIMISER
words. Consecutive windows with one minimiser form a super-k-mer. Equal windows have equal
minimisers, so only super-k-mers whose minimiser occurs again can hold a repeated window; these
travel, each packed as one string of its words, to the minimiser's bucket. There equal strings are
one with a count, and sorting the windows by content counts them exactly.

A minimiser that very many super-k-mers share is divided by a second minimiser of each window, also
a function of the window alone, so that a common line does not fill one bucket. A passage in very
many different contexts still gives many different strings with one pair of minimisers: such a bucket
is dealt out by its windows' own contents, and counted by an aggregation that merges before it shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import BROADCAST_ROWS, Workspace, read_table
from .textblocks import gram_hashes, mix64, slices, windowed_min, word_blocks

WINDOW = 35
MINIMISER = 8
#: Super-k-mers with one minimiser from which on a second minimiser divides them.
CROWDED = 256
#: Different strings in one bucket from which on it is dealt out window by window.
DENSE = 1024


def super_kmers(words: np.ndarray, window: int, gram: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, number of windows) of each run of windows with one minimiser."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = windowed_min(gram_hashes(words, gram, seed), window - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return least[first], first, np.diff(np.append(first, n))


def _again_inside(grams: np.ndarray, least: np.ndarray, first: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Whether a super-k-mer holds its minimiser more than once, so that it may repeat itself.

    Of all places of the minimiser the first lies in the first window and the last in the last.
    """
    reach, last = np.arange(width), first + n - 1
    left = first + (grams[first[:, None] + reach] == least[:, None]).argmax(1)
    right = last + width - 1 - (grams[last[:, None] + width - 1 - reach] == least[:, None]).argmax(1)
    return left != right


def _doc_runs(column: pa.Array, window: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """super_kmers of each text and whether each may repeat itself, computed over blocks of texts at once."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    for block in word_blocks(column):
        n = len(block.hashes)
        if n >= window:
            grams = gram_hashes(block.hashes, gram, 0)
            least = windowed_min(grams, window - gram + 1)
            change = np.concatenate([[True], least[1:] != least[:-1]])
        for k in range(block.last - block.first):
            a, z = int(block.first_word[k]), int(block.first_word[k + 1])
            if z - a < window:
                yield none
                continue
            mine = change[a : z - window + 1].copy()
            mine[0] = True
            first = np.flatnonzero(mine)
            sizes = np.diff(np.append(first, z - a - window + 1))
            yield least[a + first], first, sizes, _again_inside(grams, least[a + first], a + first, sizes, window - gram + 1)


def repeated_windows(strings: list[bytes], times: np.ndarray, window: int) -> list[tuple[int, list[int], list[int]]]:
    """(string, starts, ends) of the runs of windows that occur at least twice in all strings, each counted `times`."""
    lists = [s.split(b" ") for s in strings]
    sizes = np.array([len(x) for x in lists])
    codes = pd.factorize(np.array([w for x in lists for w in x], dtype=object))[0]
    begin = np.cumsum(sizes) - sizes
    count = sizes - window + 1
    at = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    owner = np.repeat(np.arange(len(strings)), count)
    rows = np.lib.stride_tricks.sliding_window_view(codes, window)
    hashes = gram_hashes(mix64(codes.astype(np.uint64)), window)[at]
    order = np.argsort(hashes, kind="stable")
    same = np.zeros(len(order), bool)
    close = np.flatnonzero(hashes[order][1:] == hashes[order][:-1]) + 1
    for a in range(0, len(close), 20_000):  # equal hashes are compared word by word
        c = close[a : a + 20_000]
        same[c] = (rows[at[order[c]]] == rows[at[order[c - 1]]]).all(1)
    if not same[close].all():  # two contents share a hash: sort these exactly
        order = order[np.lexsort(tuple(rows[at[order]].T[::-1]))]
        same = np.concatenate([[False], (rows[at[order]][1:] == rows[at[order]][:-1]).all(1)])
    group = np.cumsum(~same) - 1
    total = np.bincount(group, times[owner[order]].astype(float))
    again = np.zeros(len(order), bool)
    again[order] = total[group] >= 2
    starts = at - begin[owner]
    edge = np.flatnonzero(again & ~np.concatenate([[False], again[:-1] & (owner[1:] == owner[:-1])]))
    stop = np.flatnonzero(again & ~np.concatenate([again[1:] & (owner[1:] == owner[:-1]), [False]]))
    out: dict[int, tuple[int, list[int], list[int]]] = {}
    for a, z in zip(edge.tolist(), stop.tolist()):
        _, s, e = out.setdefault(int(owner[a]), (int(owner[a]), [], []))
        s.append(int(starts[a]))
        e.append(int(starts[z]) + window)
    return list(out.values())


def windows_of(string: bytes, window: int) -> Iterator[bytes]:
    """The string's windows in order, each its words joined by one space."""
    ends = np.flatnonzero(np.frombuffer(string + b" ", np.uint8) == 32)
    begins = np.concatenate([[0], ends[:-1] + 1])
    for a, z in zip(begins[: len(ends) - window + 1].tolist(), ends[window - 1 :].tolist()):
        yield string[a:z]


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = MINIMISER, dense: int = DENSE) -> DataFrame:
    """docs(doc_id, text, ...) with kept_text, n_words and n_removed added.

    Words are runs outside blanks, unchanged; kept_text is the words that no repeated window covers,
    joined by one space. A null text has no words and an empty kept_text. Rows are told apart by
    doc_id and text, so a row that occurs twice repeats itself. Clashing columns are replaced. An empty table gives
    no rows. A very long text is hashed in pieces and cut whole.
    """
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession)
    gram = min(gram, window)
    keyed = docs.drop("kept_text", "n_words", "n_removed").withColumn("_hash", F.xxhash64("text"))
    plain = keyed.select("doc_id", "_hash", "text")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            found = list(_doc_runs(b.column(2), window, gram))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0].view(np.int64) for f in found], pa.list_(pa.int64())), pa.array([f[1].astype(np.int32) for f in found], pa.list_(pa.int32())), pa.array([f[2].astype(np.int32) for f in found], pa.list_(pa.int32())), pa.array([f[3] for f in found], pa.list_(pa.bool_()))], names=["doc_id", "_hash", "minis", "starts", "counts", "selves"])

    table = ws.write(plain.mapInArrow(runs, "doc_id long, _hash long, minis array<long>, starts array<int>, counts array<int>, selves array<boolean>"), "runs")
    spans = table.select("doc_id", "_hash", F.explode(F.arrays_zip("minis", "starts", "counts", "selves")).alias("s")).select("doc_id", "_hash", F.col("s.minis").alias("mini"), F.col("s.starts").alias("start"), F.col("s.counts").alias("n"), F.col("s.selves").alias("self"))
    counts = ws.write(spans.groupBy("mini").agg(F.count("*").alias("count"), F.max("self").alias("self")).filter("count > 1 or self").select("mini", (F.col("count") >= CROWDED).alias("crowded")), "counts")
    ws.release()
    chosen = spans.join(counts, "mini").groupBy("doc_id", "_hash").agg(F.sort_array(F.collect_set(F.struct("start", "n", "mini", "crowded"))).alias("spans"))
    chosen = ws.write(chosen, "chosen")
    ws.release()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("packed", pa.binary()), ("doc_id", pa.int64()), ("_hash", pa.int64()), ("start", pa.int32())])
        for b in slices(batches, 2):
            ids, keys, texts, lists = (b.column(k) for k in range(4))
            hashed = {}
            for block in word_blocks(texts):
                for k in range(block.last - block.first):
                    hashed[block.first + k] = block.hashes[block.first_word[k] : block.first_word[k + 1]]
            out: list[list] = [[] for _ in range(6)]
            for i in range(b.num_rows):
                doc, key, words = ids[i].as_py(), keys[i].as_py(), texts[i].as_py().encode().split()
                for s in lists[i].as_py():
                    a, n = s["start"], s["n"]
                    parts = [(0, a, n)]
                    if s["crowded"]:
                        m, f, c = super_kmers(hashed[i][a : a + n + window - 1], window, gram, 1)
                        parts = zip(m.view(np.int64).tolist(), (f + a).tolist(), c.tolist())
                    for k2, a2, n2 in parts:
                        for o, v in zip(out, (s["mini"], k2, b" ".join(words[a2 : a2 + n2 + window - 1]), doc, key, a2)):
                            o.append(v)
                if len(out[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, schema)], schema=schema)
                    out = [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, schema)], schema=schema)

    joined = plain.join(chosen.withColumnRenamed("doc_id", "_d").withColumnRenamed("_hash", "_h"), (F.col("_hash") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    packed = joined.select("doc_id", "_hash", "text", "spans").mapInArrow(pack, "k1 long, k2 long, packed binary, doc_id long, _hash long, start int").withColumn("ph", F.xxhash64("packed"))
    packed = ws.write(packed, "packed")
    ws.release()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ph", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])

        def buckets(t: pa.Table) -> pa.RecordBatch:
            found = repeated_windows(t.column("packed").to_pylist(), t.column("times").to_numpy(), window)
            rows = pa.array([f[0] for f in found], pa.int64())
            keys = t.select(["k1", "k2", "ph"]).take(rows).combine_chunks()
            return pa.RecordBatch.from_arrays([*(keys.column(c).combine_chunks() if keys.num_rows else pa.array([], pa.int64()) for c in range(3)), pa.array([f[1] for f in found], pa.list_(pa.int32())), pa.array([f[2] for f in found], pa.list_(pa.int32()))], schema=schema)

        held: list[pa.RecordBatch] = []
        for b in batches:  # sorted by bucket: a batch may end inside one, which waits for the next
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            if held and len(k1) and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (k1[0], k2[0]):
                new = np.concatenate([[0], new])
            if len(new):
                cut = int(new[-1])
                whole = [*held, b.slice(0, cut)]
                if sum(x.num_rows for x in whole):
                    yield buckets(pa.Table.from_batches(whole))
                held = [b.slice(cut)]
            else:
                held.append(b)
        if sum(x.num_rows for x in held):
            yield buckets(pa.Table.from_batches(held))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ph", pa.int64()), ("at", pa.int32()), ("words", pa.binary()), ("times", pa.int64())])
        out: list[list] = [[] for _ in schema]
        for b in batches:
            for k1, k2, ph, string, times in zip(*(c.to_pylist() for c in b.columns)):
                for at, words in enumerate(windows_of(string, window)):
                    for o, v in zip(out, (k1, k2, ph, at, words, times)):
                        o.append(v)
                    if len(out[0]) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, schema)], schema=schema)
                        out = [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, schema)], schema=schema)

    # narrow rows, merged before they move: a string counts once, however often it occurs
    crowds = ws.write(packed.select("k1", "k2", "ph").distinct().groupBy("k1", "k2").count().filter(F.col("count") >= dense).select("k1", "k2"), "crowds")
    n_crowds = crowds.count()
    if n_crowds <= BROADCAST_ROWS:
        crowds = F.broadcast(crowds)

    def strings_of(rows: DataFrame) -> DataFrame:
        return rows.groupBy("k1", "k2", "ph", "packed").agg(F.count("*").alias("times")).select("k1", "k2", "ph", "packed", "times")

    strings = strings_of(packed.join(crowds, ["k1", "k2"], "left_anti") if n_crowds else packed)
    bucketed = strings.repartition("k1", "k2").sortWithinPartitions("k1", "k2")
    flags = ws.write(bucketed.mapInArrow(count, "k1 long, k2 long, ph long, starts array<int>, ends array<int>"), "flags")
    ws.release()
    if n_crowds:
        dealt = strings_of(packed.join(crowds, ["k1", "k2"], "left_semi")).mapInArrow(deal, "k1 long, k2 long, ph long, at int, words binary, times long")
        # 128 bits, by two hashes, stand for a window's words, which would be 35 times as much as the strings
        dealt = ws.write(dealt.withColumn("wh", F.xxhash64("words")).withColumn("wh2", F.xxhash64(F.lit("w"), F.reverse(F.hex("words")))).drop("words"), "dealt")
        again = dealt.groupBy("wh", "wh2").agg(F.sum("times").alias("times")).filter("times > 1").select("wh", "wh2")
        again = ws.write(again, "repeated")  # a side of its own in the join: the rows of a window in very many strings can be split over tasks
        again = dealt.select("k1", "k2", "ph", "at", "wh", "wh2").join(again, ["wh", "wh2"]).groupBy("k1", "k2", "ph").agg(F.sort_array(F.collect_set("at")).alias("starts"))
        flags = flags.unionByName(ws.write(again.withColumn("ends", F.transform("starts", lambda s: s + window)), "again"))
        ws.release()
    covers = packed.select("k1", "k2", "ph", "doc_id", "_hash", "start").join(flags, ["k1", "k2", "ph"])
    covers = covers.select("doc_id", "_hash", F.struct(F.transform("starts", lambda s: s + F.col("start")).alias("a"), F.transform("ends", lambda s: s + F.col("start")).alias("z")).alias("c"))
    covers = ws.write(covers.groupBy(F.col("doc_id").alias("_d"), F.col("_hash").alias("_h")).agg(F.collect_set("c").alias("covers")), "covers")
    ws.release()

    names = [c for c in keyed.columns if c != "_hash"]
    at = names.index("text")
    schema = T.StructType([*(keyed.schema[c] for c in names), T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            kept, n_words, n_removed = [], [], []
            for text, covers in zip(b.column(at), b.column(len(names))):
                words = (text.as_py() or "").encode().split()
                n_words.append(len(words))
                if covers.is_valid:
                    step = np.zeros(len(words) + 1, np.int64)
                    for c in covers.as_py():
                        np.add.at(step, c["a"], 1)
                        np.add.at(step, c["z"], -1)
                    stays = np.cumsum(step)[:-1] == 0
                    words = [w for w, s in zip(words, stays.tolist()) if s]
                kept.append(b" ".join(words).decode())
                n_removed.append(n_words[-1] - len(words))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*names, "kept_text", "n_words", "n_removed"])

    out = keyed.join(covers, (F.col("_hash") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    return out.select(*names, "covers").mapInArrow(keep, schema)


def op2_super_kmers(spark, sf_dir: str) -> DataFrame:
    """What repeated windows leave of every text; nulls, repeated rows and an empty table are as remove_repeats has them."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
t AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i, len(ws) AS n FROM l),
g AS (SELECT r, i, word, CASE WHEN i + {WINDOW} <= n THEN string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) END AS g FROM t),
h AS (SELECT r, i, word, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY g) > 1 THEN 1 ELSE 0 END AS again FROM g),
k AS (SELECT r, i, word, max(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM h)
SELECT d.doc_id, count(word)::BIGINT AS n_words, coalesce(sum(gone), 0)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '')) AS kept_sha256
FROM d LEFT JOIN k USING (r) GROUP BY d.r, d.doc_id
"""
