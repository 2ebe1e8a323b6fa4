"""Document fingerprints by spot signatures, in DataFrame functions only.

A signature is a chain: an anchor (a very common word) and the content words that follow it, other
anchors left out. A fingerprint is the set of a text's signatures; likeness is the Jaccard measure
of two sets. The near-duplicate join partitions fingerprints by set length, so that only sets whose
lengths allow the threshold meet, and prunes by a prefix of each set's order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import Workspace, numbered, read_table

#: Common words of the corpus' four languages (fixed values): articles, prepositions, pronouns, auxiliaries.
ANCHORS = (
    "a an and are as at be by for from had has have he in is it of on or that the they this to was were which with "
    "au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui se sur un une "
    "als auf das dem den der die ein eine für im ist mit nicht sich sie und von werden zu "
    "al como con del el es las los más no para por se su una y"
).split()
CHAIN = 2
SIGNATURE_DIGITS = 10
THRESHOLD = 0.8


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def spot_signatures(words: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """Sorted distinct signatures of an array of words.

    Every anchor directly before a content word starts a chain of that word and the next content
    words (fewer at the end of the text). A text with words but without chains has one signature of
    all its words, and a text without words has none.
    """
    tagged = F.transform(words, lambda w, i: F.struct(F.when(i > 0, F.get(words, i - 1)).alias("before"), w.alias("word")))
    content = F.filter(tagged, lambda x: ~x["word"].isin(*anchors))

    def digest(c: Column) -> Column:
        return F.substring(F.md5(c.cast("binary")), 1, SIGNATURE_DIGITS)

    def chains(content: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            follow = [F.coalesce(F.get(content, i + k)["word"], F.lit("")) for k in range(1, chain)]
            return F.when(x["before"].isin(*anchors), digest(F.concat_ws(" ", x["before"], x["word"], *follow)))

        return F.array_sort(F.array_distinct(F.filter(F.transform(content, one), lambda s: s.isNotNull())))

    # bound once as an element of a one-row array, so that later functions reuse it
    sigs = F.element_at(F.transform(F.array(content), chains), 1)
    return F.element_at(F.transform(F.array(sigs), lambda s: F.when(F.size(s) > 0, s).when(F.size(words) > 0, F.array(digest(F.array_join(words, " ")))).otherwise(F.array().cast("array<string>"))), 1)


def signatures_of(text: Column) -> Column:
    return F.element_at(F.transform(F.array(words_of(text)), lambda w: spot_signatures(w)), 1)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard measure of two signature sets; two empty sets are alike."""
    both = F.size(a) + F.size(b)
    # bound once as an element of a one-row array: a branch would intersect twice
    measure = F.element_at(F.transform(F.array(F.size(F.array_intersect(a, b))), lambda n: n / (both - n)), 1)
    return F.when(both == 0, F.lit(1.0)).otherwise(measure)


def fingerprint(sigs: Column) -> Column:
    return F.array_join(sigs, "")


def message(sigs: Column) -> Column:
    """The set as bytes, half a byte for a digit: an array's slots would take six times the room."""
    return F.unhex(F.array_join(sigs, ""))


def signatures_in(sent: Column) -> Column:
    """The set that a message holds, cut in one pass."""
    return F.regexp_extract_all(F.lower(F.hex(sent)), F.lit(f".{{{SIGNATURE_DIGITS}}}"), F.lit(0))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links between classes of equal fingerprints at a likeness of threshold or more: a, b (class ids, a < b), likeness.

    A class id is the smallest doc_id with that fingerprint. Sets fall into length partitions whose
    bounds grow by 1 / threshold, so a set can only be like one of its own or the next partition;
    within these a pair must share a signature among the first len - ceil(threshold * len) + 1 of
    both, which are looked up under (partition, signature). Null and empty texts have empty
    sets and no links. A fingerprint shared by any number of documents is one class.
    """
    step = math.log(1 / threshold)
    sets = docs.select("doc_id", signatures_of(F.col("text")).alias("sigs")).groupBy("sigs").agg(F.min("doc_id").alias("id")).filter(F.size("sigs") > 0)
    sets = sets.withColumn("len", F.size("sigs")).withColumn("cell", F.floor(F.log(F.col("len").cast("double")) / step + 1e-9))
    keep = (F.col("len") - F.ceil(F.col("len") * threshold - 1e-9) + 1).cast("int")
    first = sets.select("id", "sigs", "len", "cell", F.explode(F.slice("sigs", F.lit(1), keep)).alias("sig"))
    right = first.select(F.col("id").alias("id2"), F.col("sigs").alias("sigs2"), F.col("len").alias("len2"), "sig", "cell")
    left = first.withColumn("cell", F.explode(F.array(F.col("cell"), F.col("cell") + 1)))
    fits = ((F.col("len") < F.col("len2")) | ((F.col("len") == F.col("len2")) & (F.col("id") < F.col("id2")))) & (F.col("len") >= F.col("len2") * threshold - 1e-9)
    pairs = left.join(right, ["cell", "sig"]).filter(fits)
    pairs = pairs.withColumn("likeness", likeness(F.col("sigs"), F.col("sigs2"))).filter(F.col("likeness") >= threshold)
    return pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), "likeness").distinct()


def op1_spotsigs(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The next document is found by rank over narrow rows, in descending doc_id, then by the texts' hashes;
    a null doc_id comes last. Texts then move once by the row's number, and only the needed start of a text and its
    fingerprint go on to the row before it. Rows are told apart by that number, so repeated rows stay as
    often as they occur and equal ones follow each other. A null text is empty: without signatures, like
    another empty one and unlike any other. A single row is its own next; an empty table gives no rows. A very long text
    is one row's work, by functions that hold its words. Letters are lower-cased as Java does, which differs from other rules in a few (U+0130).
    """
    ws = Workspace(spark)
    # a row is known by its file and its place in it: plain columns, so that both joins share one exchange of the texts
    place = [F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *place)
    slim = ws.write(docs.select("_file", "_row", F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("down"), F.xxhash64("text").alias("hash"), F.length("text").cast("long").alias("n_chars")), "slim")
    ordered = numbered(slim, ["none", "down", "hash", "_file", "_row"], ws, "ordered")
    ranked = ws.write(ordered.select("_file", "_row", "down", "n_chars", "rank"), "ranked")
    total = ranked.count()
    # what each row must send to the one before it
    before = ranked.select(F.col("_file").alias("to_file"), F.col("_row").alias("to_row"), (-F.col("down")).alias("doc_id"), F.floor(F.col("n_chars") / 3).cast("int").alias("wanted"), F.expr(f"(rank + 1) % {max(total, 1)}").alias("rank"))
    sends = ranked.select(F.col("_file").alias("from_file"), F.col("_row").alias("from_row"), "rank").join(before, "rank").drop("rank")
    # a text's signatures are found once and go with it
    texts = docs.drop("doc_id").withColumn("sigs", message(signatures_of(F.col("text"))))
    parts = texts.join(sends, (F.col("_file") == F.col("from_file")) & (F.col("_row") == F.col("from_row")))
    messages = parts.select("to_file", "to_row", "doc_id", F.substr("text", F.lit(1), F.col("wanted")).alias("start"), F.col("sigs").alias("next_sigs"))
    own = texts.join(messages, (F.col("_file") == F.col("to_file")) & (F.col("_row") == F.col("to_row"))).withColumn("n_chars", F.length("text"))
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int")), F.col("start"))
    out = own.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"), signatures_in(F.col("sigs")).alias("sigs"), signatures_of(edited).alias("edited"), signatures_in(F.col("next_sigs")).alias("next"))
    return out.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("sigs"), F.col("edited")).alias("near_edited"), likeness(F.col("sigs"), F.col("next")).alias("near_next"))


def _anchor_list() -> str:
    return ", ".join("'" + a + "'" for a in dict.fromkeys(ANCHORS))


OP1_SQL = f"""
WITH a AS (SELECT [{_anchor_list()}] AS anchors),
d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text FROM d),
e AS (SELECT doc_id, n, text, next_text, substr(text, 1, n - n // 3) || substr(next_text, 1, n // 3) AS edited FROM n),
t AS (SELECT doc_id, 1 AS kind, text AS t FROM e UNION ALL SELECT doc_id, 2, edited FROM e UNION ALL SELECT doc_id, 3, next_text FROM e),
w AS (SELECT doc_id, kind, list_filter(string_split_regex(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM t),
c AS (SELECT doc_id, kind, ws, list_filter(list_transform(ws, lambda x, i: {{'b': CASE WHEN i > 1 THEN ws[i - 1] END, 'w': x}}), lambda s: NOT list_contains(anchors, s.w)) AS cs, anchors FROM w, a),
g AS (SELECT doc_id, kind, ws, list_sort(list_distinct(list_filter(list_transform(cs, lambda s, i: CASE WHEN list_contains(anchors, s.b) THEN substr(md5(s.b || ' ' || s.w || ' ' || coalesce(cs[i + 1].w, '')), 1, {SIGNATURE_DIGITS}) END), lambda x: x IS NOT NULL))) AS sigs FROM c),
f AS (SELECT doc_id, kind, CASE WHEN len(sigs) > 0 THEN sigs WHEN len(ws) > 0 THEN [substr(md5(array_to_string(ws, ' ')), 1, {SIGNATURE_DIGITS})] ELSE [] END AS s FROM g)
SELECT e.doc_id, e.n::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, coalesce(array_to_string(f1.s, ''), '') AS fingerprint, coalesce(array_to_string(f2.s, ''), '') AS edited_fingerprint,
  CASE WHEN len(f1.s) = 0 AND len(f2.s) = 0 THEN 1.0::DOUBLE WHEN len(f1.s) = 0 OR len(f2.s) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(f1.s, f2.s))::DOUBLE / (len(f1.s) + len(f2.s) - len(list_intersect(f1.s, f2.s))) END AS near_edited,
  CASE WHEN len(f1.s) = 0 AND len(f3.s) = 0 THEN 1.0::DOUBLE WHEN len(f1.s) = 0 OR len(f3.s) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(f1.s, f3.s))::DOUBLE / (len(f1.s) + len(f3.s) - len(list_intersect(f1.s, f3.s))) END AS near_next
FROM e JOIN f f1 ON e.doc_id = f1.doc_id AND f1.kind = 1 JOIN f f2 ON e.doc_id = f2.doc_id AND f2.kind = 2 JOIN f f3 ON e.doc_id = f3.doc_id AND f3.kind = 3
"""
