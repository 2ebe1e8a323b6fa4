"""Mixing sources to target weights in fixed-length blocks of words.

Each source's documents, in doc_id order, form one stream of words cut into blocks. Output shards
draw how many of their slots each source fills; a source's slots are numbered through all shards,
and slot j holds the block at place j of the source's pseudorandom permutation, which starts anew
after each pass and ends with the short block, if there is one. Slots and blocks meet in a join by source and block index, so a hot source spreads
over as many tasks as it has blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import BROADCAST_ROWS, Workspace, numbered, read_table, with_ranks
from .textblocks import mix64

BLOCK_WORDS = 64
SHARD_SLOTS = 8192
SHARE = 1.5
MOST = 2.0
WEIGHTS = (3.0, 1.0, 2.0)
#: Rows known by a number of their own (doc_id here) keep the order of their documents (key); equal ones go by text.
ROW_ORDER = ("key", "hash", "doc_id")


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """Shares of total by weight, none above most times its size; what is cut off is reshared by weight."""
    out = [0.0] * len(sizes)
    free = [i for i, n in enumerate(sizes) if n > 0]
    left = float(total)
    while free:
        scale = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * scale > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = weights[i] * scale
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def permute(index: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Each index below its size at its place in the permutation that its key names (a Feistel network, walked until inside)."""
    bits = np.maximum(2, np.ceil(np.log2(np.maximum(sizes, 2).astype(float)) + 1e-9).astype(np.int64))
    half = ((bits + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, keys = index.astype(np.uint64), keys.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            h, m, k = half[todo], mask[todo], keys[todo]
            a, b = out[todo] >> h, out[todo] & m
            for r in range(4):
                a, b = b, a ^ (mix64(k + np.uint64(r * 0x9E3779B9 + 1) + b * np.uint64(0x9E3779B97F4A7C15)) & m)
            out[todo] = (a << h) | b
            todo = todo[out[todo] >= sizes[todo].astype(np.uint64)]
    return out.astype(np.int64)


def mix_spans(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 7, order: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """Mixes sized(doc_id, source, size): (spans, sources). doc_id names one row; order may name other columns of sized.

    spans: shard, slot, source, block, doc_id, first_word, n_words - a row per document in a slot's
    block. sources: source, source_size, target; a null source is one of its own and comes last.
    Weights repeat over the sources by code point. Documents without words are in no span; an empty table gives no rows. Draws
    are seeded and documents ordered by doc_id, so reruns agree. The totals of the sources, a row
    each, are what the driver holds, as the weights are per source too.

    A source's slots are as many as its target takes, and its last one is cut to the words still wanted, so each source comes to its
    target rounded to a word, whatever its size. Each shard draws all its slots by one multinomial; over all shards a source
    may so have more or fewer than it needs, and slots beyond the need go to the sources that lack some.
    """
    spark, ws = sized.sparkSession, Workspace(sized.sparkSession)
    sized = ws.write(sized.select("doc_id", "source", "size", *(c for c in order if c != "doc_id")), "sized")
    found = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [int(r["n"]) for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), most)
    sources = spark.createDataFrame([(r["source"], n, g) for r, n, g in zip(found, sizes, goal)], "source string, source_size long, target double")

    n_words = np.array(sizes, np.int64)
    wanted = np.array([math.floor(g + 0.5) for g in goal], np.int64)
    blocks, full = -(-n_words // block_words), n_words // block_words
    passes = wanted // np.maximum(n_words, 1)
    rest = wanted - passes * n_words
    need = passes * blocks + -(-rest // block_words)
    slots = int(need.sum())
    n_shards = max(1, -(-slots // shard_slots))
    chance = need / max(slots, 1)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard in b["id"]:
                n = min(shard_slots, slots - int(shard) * shard_slots)
                got = np.random.Generator(np.random.Philox(key=[seed, int(shard)])).multinomial(n, chance)
                yield pd.DataFrame({"shard": shard, "src": np.arange(len(got)), "n": got, "at": np.cumsum(got) - got, "of": n})

    drawn = ws.write(spark.range(n_shards if slots else 0).mapInPandas(draw, "shard long, src int, n long, at long, of long").filter("n > 0"), "draws")
    w = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # need and draws of a source: as many rows as the driver's list of them
    drawn_of = {r["src"]: int(r["n"]) for r in drawn.groupBy("src").agg(F.sum("n").alias("n")).collect()}
    needs = spark.createDataFrame([(i, int(x)) for i, x in enumerate(need)], "src int, need long")
    runs = drawn.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).join(needs, "src")
    runs = ws.write(runs.withColumn("kept", F.least("n", F.greatest(F.col("need") - F.col("before"), F.lit(0)))), "runs")
    main = runs.filter("kept > 0").select("shard", "src", F.col("kept").alias("n"), "at", "of", "before")
    # the slots beyond the need, one by one, and the lacking ones, by one and the same number
    spare = runs.filter("kept < n").select("shard", "of", F.explode(F.sequence(F.col("at") + F.col("kept"), F.col("at") + F.col("n") - 1)).alias("at"))
    spare = numbered(spare, ["shard", "at"], ws, "spare")
    lack, first = [], 0
    for i, x in enumerate(need.tolist()):
        if (n := x - drawn_of.get(i, 0)) > 0:
            lack.append((i, first, n, drawn_of.get(i, 0)))
            first += n
    lacking = spark.createDataFrame(lack, "src int, first long, n long, before long").select("src", F.posexplode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)).alias("pos", "before"), "first")
    moved = spare.join(lacking.select("src", "before", (F.col("first") + F.col("pos")).alias("rank")), "rank").select("shard", "src", F.lit(1).cast("long").alias("n"), "at", "of", "before")

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                j, s = row.before + np.arange(row.n), row.src
                place = np.arange(row.at, row.at + row.n)
                at = j % blocks[s]
                key = mix64(np.uint64(seed) + np.uint64(s) * np.uint64(1 << 32) + (j // blocks[s]).astype(np.uint64))
                block = at.copy()  # a short block comes last in each pass
                inner = at < full[s]
                block[inner] = permute(at[inner], np.full(int(inner.sum()), full[s]), key[inner])
                left = np.where(j == need[s] - 1, wanted[s] - (j // blocks[s]) * n_words[s] - at * block_words, block_words)
                slot = permute(place, np.full(len(j), row.of), np.full(len(j), mix64(np.array([row.shard + (seed << 40)], np.uint64))[0]))
                yield pd.DataFrame({"shard": row.shard, "slot": slot, "src": s, "block": block, "most": left})

    # a run of slots is a row: dealt over all tasks before they are laid out, as its size is not a row's
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = main.unionByName(moved).repartition(parallel, "shard", "src", "at").mapInPandas(lay, "shard long, slot long, src int, block long, most long")
    # null-safe numbers for the sources; their table is as small as the driver's list of them
    numbers = spark.createDataFrame([(r["source"], i) for i, r in enumerate(found)], "_s string, src int")
    streams = with_ranks(sized.filter("size > 0"), "source", list(order), "size", ws, "streams")
    parts = (
        streams.join(F.broadcast(numbers) if len(found) <= BROADCAST_ROWS else numbers, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("block", F.explode(F.sequence(F.expr(f"before div {block_words}"), F.expr(f"(before + size - 1) div {block_words}"))))
        .withColumn("first_word", F.greatest(F.lit(0), F.col("block") * block_words - F.col("before")))
        .withColumn("n_words", F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("before")) - F.col("first_word"))
        .withColumn("inside", F.col("before") + F.col("first_word") - F.col("block") * block_words)
    )
    # both sides grow with the input, whatever size the planner expects of them
    spans = laid.hint("merge").join(parts.select("src", "block", "source", "doc_id", "first_word", "n_words", "inside"), ["src", "block"])
    spans = spans.withColumn("n_words", F.least("n_words", F.col("most") - F.col("inside"))).filter("n_words > 0")
    return spans.select("shard", "slot", "source", "block", "doc_id", "first_word", "n_words"), sources


def sized_documents(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source and the number of words of each text (null: 0), and more columns."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    return docs.select("doc_id", "source", words.cast("long").alias("size"), *more)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every row, added up from its spans; rows with a null or repeated doc_id each have their own share."""
    ws = Workspace(spark)
    sized = ws.write(sized_documents(read_table(spark, sf_dir, "documents"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row")), "documents")
    spans, sources = mix_spans(sized.withColumnsRenamed({"doc_id": "key", "row": "doc_id"}), order=ROW_ORDER)
    taken = spans.groupBy(F.col("doc_id").alias("row")).agg(F.sum("n_words").alias("taken"))
    sources = sources.withColumnRenamed("source", "_s")  # Spark sends it out if it is small
    out = sized.join(taken, "row", "left").join(sources, F.col("source").eqNullSafe(F.col("_s")), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each text replaced by the words that the mix takes of it, in their order, a second pass after the first.

    Documents of which nothing is taken go; an empty table gives no rows. Null texts and texts without words are in no block and go too.
    Rows are told apart by a number of their own, so a null or repeated doc_id loses none and mixes up no texts;
    n_chars is counted anew; other columns stay.
    """
    rows = Workspace(docs.sparkSession).write(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    sized = sized_documents(rows.select(F.col("_row").alias("doc_id"), F.col("doc_id").alias("key"), "source", "text"), F.col("key"), F.xxhash64("text").alias("hash"))
    spans, _ = mix_spans(sized, order=ROW_ORDER, **options)
    # a block taken twice has one span with two lengths, the longer one first
    times = spans.groupBy("doc_id", "first_word").agg(F.sort_array(F.collect_list("n_words"), asc=False).alias("ns"))
    lists = times.groupBy(F.col("doc_id").alias("_row")).agg(F.sort_array(F.collect_list(F.struct("first_word", "ns"))).alias("_spans"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    most = F.aggregate("_spans", F.lit(0), lambda a, s: F.greatest(a, F.size(s["ns"])))
    copies = F.flatten(F.transform(F.sequence(F.lit(1), most), lambda k: F.transform(F.filter("_spans", lambda s: F.size(s["ns"]) >= k), lambda s: F.struct(s["first_word"].alias("first_word"), F.get(s["ns"], k - 1).alias("n_words")))))

    def taken(w):
        return F.array_join(F.flatten(F.transform(copies, lambda s: F.slice(w, (s["first_word"] + 1).cast("int"), s["n_words"].cast("int")))), " ")

    # the words are bound once, as the element of a one-row array, and not split anew for each span
    text = F.element_at(F.transform(F.array(words), taken), 1)
    out = rows.join(lists, "_row").withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
