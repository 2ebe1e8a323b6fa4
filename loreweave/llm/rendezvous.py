"""Shards by rendezvous hashing: each record goes to the shard that scores highest for its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Workspace, read_table, with_ranks

SHARDS = 40
_LOW = 0xFFFFFFFF


def mix32(x: Column) -> Column:
    """Bijective mixing of a 32-bit value held in a long; no product exceeds 63 bits."""
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 16))
    x = (x * F.lit(0x21F0AAAD)).bitwiseAND(F.lit(_LOW))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 15))
    x = (x * F.lit(0x735A2D97)).bitwiseAND(F.lit(_LOW))
    return x.bitwiseXOR(F.shiftrightunsigned(x, 15))


def shard_seed(shard: int) -> int:
    """A shard's seed, by the same mixing."""
    x = shard * 2 + 1
    for shift, factor in ((16, 0x21F0AAAD), (15, 0x735A2D97)):
        x = ((x ^ (x >> shift)) * factor) & _LOW
    return x ^ (x >> 15)


def key_hash(key: Column) -> Column:
    """32 bits of a long key; a null key counts as -1."""
    key = F.coalesce(key.cast("long"), F.lit(-1))
    return mix32(mix32(key.bitwiseAND(F.lit(_LOW))).bitwiseXOR(F.shiftrightunsigned(key, 32)))


def best_of(hashed: Column, weights: list[float], first: int = 0) -> Column:
    """struct(score, -shard) of the best among shards first, first + 1, ... of these weights.

    The score is -weight / ln(u), where u is the mixed hash of key and shard in (0, 1). A shard added at
    the end leaves every other score as it was, so it only takes rows to itself. Ties go to the smaller shard.
    """
    scores = []
    for shard, weight in enumerate(weights, first):
        u = (mix32(hashed.bitwiseXOR(F.lit(shard_seed(shard)))) + F.lit(0.5)) / F.lit(float(1 << 32))
        # equal weights need no logarithm: the order is that of u
        score = u if len(set(weights)) == 1 else F.lit(-float(weight)) / F.log(u)
        scores.append(F.struct(score.alias("score"), F.lit(-shard).alias("shard")))
    return scores[0] if len(scores) == 1 else F.greatest(*scores)


def rendezvous(hashed: Column, weights: list[float]) -> Column:
    """The shard with the highest score."""
    return (-best_of(hashed, weights)["shard"]).cast("int")


def shard_records(df: DataFrame, key: str, weights: list[float]) -> DataFrame:
    """Adds shard to any rows; a column named shard is replaced. A null key counts as -1; rows with one key share a shard."""
    # hashed in a projection of its own: every shard's score refers to it
    return df.withColumn("_hash", key_hash(F.col(key))).withColumn("shard", rendezvous(F.col("_hash"), weights)).drop("_hash")


def op6_rendezvous(spark, sf_dir: str) -> DataFrame:
    """Every document's shard among 40 and among 41; slot is its place in its shard by doc_id, then the text's crc32 and size.

    Null texts have size 16 and the crc32 of no bytes. Rows with a null doc_id share the shard of key -1
    and come first in it; rows with a repeated doc_id share a shard and have a slot each; equal rows
    take their slots in any order. An empty table gives no rows.
    """
    docs = read_table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    # texts are read once and left behind: the exchanges that follow move a few numbers per row
    slim = docs.select("doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    slim = slim.withColumn("_hash", key_hash(F.col("doc_id")))
    slim = slim.withColumn("_best", best_of(F.col("_hash"), [1.0] * SHARDS))
    grown = F.greatest("_best", best_of(F.col("_hash"), [1.0], SHARDS))
    slim = slim.select("doc_id", "size", "text_crc32", (-F.col("_best.shard")).cast("int").alias("shard"), (-grown["shard"]).cast("int").alias("grown_shard"), F.lit(1).cast("long").alias("one"))
    ws = Workspace(spark)
    slim = ws.write(slim, "slim")
    placed = with_ranks(slim, "shard", ["doc_id", "text_crc32", "size"], "one", ws, "slots")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("before").alias("slot"), "grown_shard")


#: The same in SQL. crc32 goes through the hexadecimal digits of the bytes, the low half of each byte first, by its table for four bits.
_NIBBLES = []
for _n in range(16):
    for _ in range(4):
        _n = (_n >> 1) ^ (0xEDB88320 if _n & 1 else 0)
    _NIBBLES.append(_n)


def _sql_mix(x: str, to: str, source: str, keep: str) -> str:
    """Three nested selects that mix the 32-bit column x of source into column `to`."""
    a = f"SELECT {keep}, (xor({x}, {x} >> 16) * {0x21F0AAAD}) & {_LOW} AS m1 FROM ({source})"
    b = f"SELECT {keep}, (xor(m1, m1 >> 15) * {0x735A2D97}) & {_LOW} AS m2 FROM ({a})"
    return f"SELECT {keep}, xor(m2, m2 >> 15) AS {to} FROM ({b})"


_ID = "row_id, doc_id, text"
_HASHED = _sql_mix("x2", "h", f"SELECT {_ID}, xor(h0, (k >> 32) & {_LOW}) AS x2 FROM (" + _sql_mix("lo", "h0", f"SELECT {_ID}, k, k & {_LOW} AS lo FROM r", f"{_ID}, k") + ")", _ID)
OP6_SQL = f"""
WITH r AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text, coalesce(doc_id, -1)::BIGINT AS k FROM documents),
hashed AS ({_HASHED}),
seeds AS (SELECT * FROM (VALUES {", ".join(f"({s}, {shard_seed(s)}::BIGINT)" for s in range(SHARDS + 1))}) t(shard, seed)),
u AS ({_sql_mix("x", "u", "SELECT row_id, shard, xor(h, seed) AS x FROM hashed, seeds", "row_id, shard")}),
best AS (SELECT row_id, arg_max(shard, u * 100 - shard) FILTER (shard < {SHARDS}) AS shard, arg_max(shard, u * 100 - shard) AS grown_shard FROM u GROUP BY row_id),
crc AS (
  SELECT row_id, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(regexp_replace(hex(encode(text)), '(.)(.)', '\\2\\1', 'g'), ''), lambda c: (strpos('0123456789ABCDEF', c) - 1)::BIGINT),
    lambda a, n: xor(a >> 4, [{", ".join(f"{n}::BIGINT" for n in _NIBBLES)}][(xor(a, n) & 15) + 1])), 4294967295::BIGINT) AS c
  FROM r WHERE text <> ''),
d AS (SELECT doc_id, (octet_length(encode(text)) + 16)::BIGINT AS size, coalesce(c, 0)::BIGINT AS text_crc32, shard, grown_shard FROM hashed JOIN best USING (row_id) LEFT JOIN crc USING (row_id))
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard::INT AS grown_shard FROM d
"""
