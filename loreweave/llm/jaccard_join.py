"""Jaccard self-join of shingle sets by vertical partitioning.

Equal sets form one class. All shingles have a global order: those that many sets hold come last,
by how many, the others by hash. Two sets that are alike enough share a shingle among the first few
of both (prefix filter), which proposes the pairs. The order is cut into fragments; a set is cut
into one segment per fragment, the overlap of a pair is counted in each fragment separately, and the
partial counts are summed per pair.

Dense groups are not expanded into all their pairs: first every class is compared with one leader
(of all proposed by its prefix, the one with the fewest uncommon shingles); then only pairs that
share a prefix shingle and are not yet connected. So every link that could join two components is
counted, and connectivity is exact. A pair is proposed where its prefixes first meet: a row knows the
shingles just before it, and a pair that shares one of them was proposed there. Before whole sets
move, a parity bitmap of a few bits a shingle bounds a pair's overlap from above.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Workspace, read_table
from .components import components
from .textblocks import gram_hashes, slices, word_blocks

SHINGLE_WORDS = 4
PERCENT = 85
FRAGMENTS = 4
#: A shingle is common if a batch of texts has it in so many different sets ...
LOCAL_LEAST = 4
#: A batch of texts is counted in parts of so many shingles, for memory.
LOCAL_SHINGLES = 2_000_000
#: ... and all of them together in one of so many sets (at least 16); so at most this times the mean set size are common.
COMMON_SHARE = 5000
#: Prefix shingles before its own that a row knows; any number gives the same pairs.
BEFORE = 4


def shingle_sets(column: pa.Array, n_words: int = SHINGLE_WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit shingles) for each text, ASCII letters lower-cased."""
    for block in word_blocks(column, lower=True):
        grams = gram_hashes(block.hashes, n_words)
        for k in range(block.last - block.first):
            a, z = int(block.first_word[k]), int(block.first_word[k + 1])
            if z - a >= n_words:
                yield block.first + k, np.unique(grams[a : z - n_words + 1])
            else:
                yield block.first + k, gram_hashes(block.hashes[a:z], z - a, 1) if z > a else np.zeros(0, np.uint64)


def parity_bits(s: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of at least 2 * len(s) slots (a power of two), in 64-bit words.

    The slots in which two sets differ are at most as many as the shingles that only one of them holds.
    """
    slots = max(64, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _may_link(bits: str, bits2: str, percent: int) -> Column:
    """Whether parity bitmaps leave sets of n and n2 shingles enough to share; the longer one is folded to the other's length."""

    def fold(x: str, y: str) -> Column:
        k = F.size(y)
        return F.when(F.size(x) > k, F.zip_with(F.slice(x, F.lit(1), k), F.slice(x, k + 1, k), lambda a, b: a.bitwiseXOR(b))).otherwise(F.col(x))

    apart = F.aggregate(F.zip_with(fold(bits, bits2), fold(bits2, bits), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, x: t + x)
    total = F.col("n") + F.col("n2")
    return (total - apart) * (100 + percent) >= total * 2 * percent


def common_shingles(docs: DataFrame, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, level 1 and up) that many sets hold, counted over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(sets: list[np.ndarray], n: int) -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, int))
            keep = counts >= LOCAL_LEAST
            # the number of sets travels under shingle null
            return pa.RecordBatch.from_arrays([pa.array([None, *values[keep].view(np.int64).tolist()], pa.int64()), pa.array([n, *counts[keep].tolist()], pa.int64())], names=["shingle", "n"])

        for b in batches:
            seen, sets, held = set(), [], 0
            for part in slices(iter([b]), 0):
                for _, s in shingle_sets(part.column(0), n_words):
                    key = blake2b(s.tobytes(), digest_size=16).digest()
                    if len(s) and key not in seen:
                        seen.add(key)
                        sets.append(s)
                        held += len(s)
                    if held > LOCAL_SHINGLES:
                        yield counted(sets, len(sets))
                        sets, held = [], 0
            yield counted(sets, len(sets))

    counts = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).persist()
    total = counts.filter("shingle is null").first()
    least = max(16, (total["n"] if total else 0) // COMMON_SHARE)
    rows = counts.filter(f"shingle is not null and n >= {least}").collect()
    counts.unpersist()
    found = np.array([r["shingle"] for r in rows], np.int64).view(np.uint64)
    level = np.array([1 + int(np.log2(r["n"] / least)) for r in rows], np.int64)
    by = np.argsort(found)
    return found[by], level[by]


def _in_order(s: np.ndarray, common: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, int]:
    """A set's shingles in the global order, and how many are not common."""
    if not len(common):
        return s, len(s)
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    rank = np.where(common[at] == s, level[at], 0)
    return s[np.lexsort((s, rank))], int((rank == 0).sum())


def link_documents(docs: DataFrame, n_words: int = SHINGLE_WORDS, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """doc_id, n_shingles, component_id for docs(doc_id, text).

    Links: 100 * intersection >= percent * union of the sets. Null and empty texts have no set and
    no links; their component is their own id. Repeated rows share a class; rows with one doc_id and different texts are rows
    of their own, each in its own class. A null doc_id is in no class and has a null component. An empty table gives no rows. A very
    long text is shingled in pieces and held alone. Other columns are ignored, whatever their names.

    Classes are known by a number of their own; `doc` is the smallest doc_id in a class, and doc and `th`, the hash of a text, find
    one of its texts again.
    """
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    common = spark.sparkContext.broadcast(common_shingles(docs, n_words))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, level = common.value
        for b in slices(batches, 1):
            n, rare, one, two, first, bits = [], [], [], [], [], []
            for _, s in shingle_sets(b.column(1), n_words):
                ordered, r = _in_order(s, shingles, level)
                key = np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), "<i8")
                n.append(len(s)), rare.append(r), one.append(int(key[0])), two.append(int(key[1]))
                bits.append(parity_bits(s))
                first.append(ordered[: len(s) - -(-percent * len(s) // 100) + 1].view(np.int64) if len(s) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(rare, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["doc_id", "th", "n", "rare", "one", "two", "prefix", "bits"])

    sets = ws.write(docs.mapInArrow(prefixes, "doc_id long, th long, n long, rare long, one long, two long, prefix array<long>, bits array<long>"), "sets")
    classes = sets.filter("n > 0 and doc_id is not null").groupBy("one", "two", "n").agg(F.min(F.struct("doc_id", "th")).alias("of"), F.first("rare").alias("rare"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    wide = ws.write(classes.select("one", "two", "n", F.col("of.doc_id").alias("doc"), F.col("of.th").alias("th"), "rare", "prefix", "bits").withColumn("id", F.monotonically_increasing_id()), "classes-wide")
    classes = ws.write(wide.select("one", "two", "n", "id", "doc", "th"), "classes")
    sets = ws.write(sets.drop("prefix", "bits", "rare", "th"), "members")
    ws.drop("sets")
    ws.release()

    # prefix shingles that at least two classes hold; 31 bits of the shingle are enough to drop the rest
    spots = wide.select("id", F.col("n").cast("int").alias("n"), F.col("rare").cast("int").alias("rare"), F.posexplode("prefix").alias("pos", "shingle")).withColumn("low", F.col("shingle").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    shared = spots.groupBy("low").count().filter("count > 1").select("low")
    shared = ws.write(shared, "shared")
    hits = ws.write(spots.join(shared, "low", "left_semi").drop("low"), "hits")
    ws.drop("shared")
    ws.release()

    fits = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent
    need = F.ceil((F.col("n") + F.col("n2")) * percent / (100 + percent) - 1e-9)
    reach = 1 + F.least(F.col("n") - 1 - F.col("pos"), F.col("n2") - 1 - F.col("pos2")) >= need
    # shingles that a pair shares outside both prefixes all lie behind the prefix of one and the same set
    behind = F.greatest(F.ceil(F.col("n") * percent / 100 - 1e-9), F.ceil(F.col("n2") * percent / 100 - 1e-9)) - 1
    in_prefix = F.greatest(need - behind, F.lit(1))

    # one leader for each class: the head of many of its shingles; a choice that costs no link
    heads = hits.groupBy("shingle").agg(F.min(F.struct("rare", "id", "n", "pos")).alias("h"), F.count("*").alias("c")).filter("c > 1")
    heads = heads.select("shingle", F.col("h.rare").alias("rare2"), F.col("h.id").alias("id2"), F.col("h.n").alias("n2"), F.col("h.pos").alias("pos2"))
    led = hits.join(heads, "shingle").filter((F.col("id") != F.col("id2")) & fits)
    led = led.groupBy("id", "id2").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("n2").alias("n2"), F.first("rare2").alias("rare2")).filter(F.col("c") * 2 >= in_prefix)
    led = led.groupBy("id").agg(F.max(F.struct("c", (-F.col("rare2")).alias("r"), (-F.col("id2")).alias("l"), "n2")).alias("h"), F.first("n").alias("n")).select("id", "n", (-F.col("h.l")).alias("leader"), F.col("h.n2").alias("n2"))
    bitmaps = wide.select("id", "bits")

    def likely(pairs: DataFrame, a: str, b: str) -> DataFrame:
        """Pairs (a, b, n, n2) whose bitmaps don't rule a link out."""
        known = pairs.join(bitmaps.withColumnRenamed("id", a), a).join(bitmaps.select(F.col("id").alias(b), F.col("bits").alias("bits2")), b)
        return known.filter(_may_link("bits", "bits2", percent)).select(*pairs.columns)

    led = ws.write(likely(led, "id", "leader").drop("n2"), "led")
    ws.release()

    bound = [(f * (1 << 64)) // fragments for f in range(1, fragments)]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, _ = common.value
        cuts = np.array(bound, np.uint64)
        for b in slices(batches, 4):
            for k, s in shingle_sets(b.column(4), n_words):
                usual = np.isin(s, shingles, assume_unique=True)
                rest = s[~usual]
                at = np.searchsorted(rest, cuts)
                parts = [*np.split(rest, at), s[usual]]  # the last fragment holds the end of the order
                one = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays([pa.array([v] * len(parts), t) for v, t in zip((c[0].as_py() for c in one.columns[:4]), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))] + [pa.array(range(len(parts)), pa.int32()), pa.array([p.view(np.int64) for p in parts], pa.list_(pa.int64()))], names=["id", "n", "leader", "leads", "fragment", "shingles"])

    def cut_sets(wanted: DataFrame, name: str) -> DataFrame:
        """Segments of the sets of wanted(id, n, leader, leads), from the whole texts."""
        found = wanted.join(classes.select("id", "doc", F.col("th").alias("_th")), "id")
        texts = docs.join(found, (F.col("doc_id") == F.col("doc")) & F.col("th").eqNullSafe(F.col("_th"))).select("id", "n", "leader", "leads", "text").dropDuplicates(["id"])
        out = ws.write(texts.mapInArrow(segments, "id long, n long, leader long, leads boolean, fragment int, shingles array<long>"), name)
        ws.release()
        return out

    def linked(parts: DataFrame) -> DataFrame:
        """Pairs (a, b, n, n2, part) whose summed partial overlaps reach the threshold."""
        sums = parts.groupBy("a", "b").agg(F.sum("part").alias("both"), F.first("n").alias("n"), F.first("n2").alias("n2"))
        return sums.filter(F.col("both") * (100 + percent) >= (F.col("n") + F.col("n2")) * percent).select("a", "b")

    overlap = F.size(F.array_intersect("shingles", "shingles2")).alias("part")
    chiefs = led.select(F.col("leader").alias("id"), F.lit(True).alias("leads")).distinct()
    sizes = led.join(chiefs, "id", "full").join(classes.select("id", F.col("n").alias("n_all")), "id")
    cut = cut_sets(sizes.select("id", F.col("n_all").alias("n"), "leader", "leads"), "segments-1")
    heads = cut.filter("leads").select(F.col("id").alias("b"), F.col("n").alias("n2"), "fragment", F.col("shingles").alias("shingles2"))
    members = cut.filter("leader is not null").select(F.col("id").alias("a"), F.col("leader").alias("b"), "n", "fragment", "shingles")
    first = ws.write(linked(members.join(heads, ["b", "fragment"]).select("a", "b", "n", "n2", overlap)), "links-1")
    ws.drop("segments-1")
    joined = ws.write(components(first, ws, "stars"), "joined")
    ws.release()

    # pairs that share a prefix shingle and are not yet connected
    known = hits.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id")).drop("rare")
    open_ = known.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("shingle", F.lit(True).alias("open"))
    # shared: prefix shingles that another class holds too; only these can be in both prefixes of a pair
    known = known.join(open_, "shingle", "left").withColumn("shared", F.count("*").over(Window.partitionBy("id"))).filter("open").drop("open")
    earlier = Window.partitionBy("id").orderBy("pos")
    known = ws.write(known.withColumn("before", F.array(*(F.lag("shingle", k).over(earlier) for k in range(1, BEFORE + 1)))), "open")
    other = known.select("shingle", *(F.col(c).alias(f"{c}2") for c in ("id", "n", "pos", "component", "shared", "before")))
    # of the two prefixes one ends first in the order: its set can only share what lies behind it and those
    possible = F.greatest(*(F.ceil(F.col(f"n{k}") * percent / 100 - 1e-9) - 1 + F.col(f"shared{k}") for k in ("", "2"))) >= need
    # the first shingle that a pair shares lies within reach of the threshold in both sets
    first_met = ~F.coalesce(F.arrays_overlap("before", "before2"), F.lit(False))
    pairs = known.join(other, "shingle").filter((F.col("id") < F.col("id2")) & (F.col("component") != F.col("component2")) & fits & reach & possible & first_met)
    pairs = ws.write(pairs.select("id", "id2", "n", "n2").distinct(), "near")
    pairs = ws.write(likely(pairs, "id", "id2").select(F.col("id").alias("a"), F.col("id2").alias("b"), "n", "n2"), "pairs")
    ws.drop("classes-wide", "near", "open", "hits")
    ws.release()
    ends = pairs.select(F.col("a").alias("id"), "n").unionAll(pairs.select(F.col("b").alias("id"), F.col("n2").alias("n"))).distinct()
    cut = cut_sets(ends.select("id", F.col("n").cast("long").alias("n"), F.lit(None).cast("long").alias("leader"), F.lit(None).cast("boolean").alias("leads")), "segments-2")
    left = pairs.select("a", "b").join(cut.select(F.col("id").alias("a"), "n", "fragment", "shingles"), "a")
    right = cut.select(F.col("id").alias("b"), F.col("n").alias("n2"), "fragment", F.col("shingles").alias("shingles2"))
    second = ws.write(linked(left.join(right, ["b", "fragment"]).select("a", "b", "n", "n2", overlap)), "links-2")
    ws.drop("segments-2")
    ws.release()
    final = components(first.unionAll(second), ws, "components")
    # a component goes by the smallest doc_id of its classes
    named = ws.write(final.join(classes.select("id", "doc"), "id").groupBy("component").agg(F.min("doc").alias("least")), "named")
    of_class = classes.join(final.join(named, "component").select("id", "least"), "id", "left").select("one", "two", "n", F.coalesce("least", "doc").alias("component_id"))
    out = sets.select("doc_id", "one", "two", "n").join(of_class, ["one", "two", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """The component of every document; nulls, repeated rows and an empty table are as link_documents has them."""
    return link_documents(read_table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
l AS (SELECT r, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
t AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i, len(ws) AS n FROM l),
g AS (SELECT r, i, n, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {SHINGLE_WORDS - 1} FOLLOWING) AS s FROM t),
e AS (SELECT DISTINCT r, s FROM g WHERE i + {SHINGLE_WORDS} <= n OR (n < {SHINGLE_WORDS} AND i = 0)),
n AS (SELECT r, count(*) AS n FROM e GROUP BY r),
both_ AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM e a JOIN e b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM d JOIN reach ON reach.a = d.r JOIN d o ON o.r = reach.b LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id
"""
