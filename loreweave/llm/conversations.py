"""Repair of conversations to a grammar of roles at the least cost.

Rows of a conversation, in turn order, are cut into segments of a fixed number of rows, which are hash-partitioned into
batches of bounded size. In each batch one recursive DuckDB query walks all segments at once: each recursion advances every segment by one
turn and keeps, for each grammar state to start from and each to be in, the least cost and of equal ones the least
audit. The segments of a long conversation are then joined by the same recursion over their own outcomes, level by level, so
no task holds a conversation, however long. From the best outcome of the whole the states between segments
are looked up again, downwards, which gives each row its edit.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Workspace, read_table, with_ranks
from .rendezvous import _NIBBLES

#: Rows of a segment and segments joined at a time; rows of a batch, about.
SEGMENT, BATCH = 64, 20_000
#: Costs of edits; a kept row costs nothing. Rows that stay and are truncated cost TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The grammar (s?(ua)+)?: states 0 (start), 1 (after s), 2 (after u), 3 (after a) and what leads from one to the next. It may end in 0 and 3.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Inserts that lead from each state to an end.
ENDS = {0: "", 1: "ua", 2: "a", 3: ""}
ROLES = {"u": "user", "a": "assistant"}
BLANK, STOPS = "\\x20\\x09-\\x0D", ".!?"


def moves(initial: str, deleted: bool, truncated: bool) -> dict[tuple[int, int], tuple[int, str, str]]:
    """(from, to) -> (cost, letters, role initials) of the cheapest edits of one row, with inserts before it; ties go to the least letters."""
    best: dict[tuple[int, int], tuple[int, str, str]] = {}

    def offer(start: int, end: int | None, *found) -> None:
        if end is not None and found < best.get((start, end), (math.inf, "", "")):
            best[start, end] = found

    for start in range(4):
        for inserted in ("", "u", "a", "ua", "au"):
            at: int | None = start
            for r in inserted:
                at = NEXT.get((at, r))
            if at is None:
                continue
            cost, letters = INSERT * len(inserted), "I" * len(inserted)
            offer(start, at, cost + DELETE, letters + "D", inserted)
            if not deleted:
                offer(start, NEXT.get((at, initial)), cost + TRUNCATED * truncated, letters + "K", inserted + initial)
                for r in ROLES:
                    offer(start, NEXT.get((at, r)), cost + REROLE + TRUNCATED * truncated, letters + "R", inserted + r)
    return best


#: A row's kind: its initial (other: x), whether it has to go, whether it is truncated.
KINDS = [(i, d, t) for i, d, t in product("suax", (False, True), (False, True))]
_RULES = ", ".join(f"({k}, {f}, {to}, {cost}, '{letters}', '{roles}')" for k, kind in enumerate(KINDS) for (f, to), (cost, letters, roles) in moves(*kind).items())
_WALK = """
WITH RECURSIVE groups AS MATERIALIZED (SELECT c, seg, count(DISTINCT i) AS n FROM steps GROUP BY ALL),
walk(c, seg, origin, state, i, cost, letters, roles, path) USING KEY (c, seg, origin, state) AS (
  SELECT c, seg, s, s, 0::BIGINT, 0::BIGINT, '', '', '' FROM groups, (VALUES (0), (1), (2), (3)) t(s) WHERE s = 0 OR seg > 0
  UNION
  SELECT c, seg, origin, dest, i, m.cost, m.letters, m.roles, m.path FROM (
    SELECT w.c, w.seg, w.origin, v.dest, w.i + 1 AS i, min({'cost': w.cost + v.cost, 'letters': w.letters || v.letters, 'roles': w.roles || v.roles, 'path': w.path || v.dest}) AS m
    FROM walk w JOIN steps v ON v.c = w.c AND v.seg = w.seg AND v.i = w.i AND v.origin = w.state GROUP BY w.c, w.seg, w.origin, v.dest, w.i)
)
SELECT c, seg, origin, state::INT AS dest, cost, letters, roles, path FROM walk JOIN groups USING (c, seg) WHERE walk.i = groups.n
"""
_FIRST = f"""
CREATE TEMP TABLE steps AS SELECT c, seg, i, origin, dest, cost::BIGINT AS cost, letters, roles
FROM batch JOIN (VALUES {_RULES}) r(kind, origin, dest, cost, letters, roles) USING (kind) WHERE NOT peek
"""
#: Neighbours in a segment and the first row of the next one.
_ILLEGAL = """
SELECT c, seg, -1 AS origin, -1 AS dest, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS cost, '' AS letters, '' AS roles, '' AS path
FROM (SELECT c, seg, lag(initial) OVER (PARTITION BY c, seg ORDER BY i) || initial AS pair FROM batch) GROUP BY ALL
"""
_PARTS = "c string, seg long, origin int, dest int, cost long, letters string, roles string, path string"
_SCHEMA = pa.schema([("c", pa.string()), ("seg", pa.int64()), ("origin", pa.int32()), ("dest", pa.int32()), ("cost", pa.int64()), ("letters", pa.string()), ("roles", pa.string()), ("path", pa.string())])


def _database(batch: pa.Table):
    import duckdb

    db = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
    db.register("batch", batch)
    return db


def _walk_rows(batch: pa.Table) -> pa.Table:
    """The outcomes of each segment of a batch of rows, and a row with dest -1 that counts its illegal neighbours."""
    with _database(batch) as db:
        db.execute(_FIRST)
        return db.sql(f"{_WALK} UNION ALL {_ILLEGAL}").to_arrow_table().cast(_SCHEMA)


def _walk_parts(batch: pa.Table) -> pa.Table:
    """The outcomes of each run of segments. Role initials are kept with the segments only."""
    with _database(batch) as db:
        db.execute("CREATE TEMP TABLE steps AS SELECT c, seg, i, origin, dest, cost, letters, '' AS roles FROM batch")
        return db.sql(_WALK).to_arrow_table().cast(_SCHEMA)


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by the crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes its role user. Nulls in texts and keys are one space."""
    space = F.lit(" ")
    known = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    known = known.withColumn("_fault", F.crc32(key.cast("binary")) % 20).filter("_fault <> 0")
    known = known.withColumn("text", F.when(F.col("_fault") == 1, F.lit("")).when(F.col("_fault") == 2, F.regexp_replace("text", f"[{STOPS}]", "")).otherwise(F.col("text")))
    known = known.withColumn("role", F.when(F.col("_fault") == 4, F.lit("user")).otherwise(F.col("role")))
    return known.withColumn("_copy", F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_fault", "_copy")


@dataclass
class Repaired:
    """audits: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation that has rows.
    turns: conv_id, place, edit, role, text of the repaired conversations; place grows with the order, edit is K, R or I."""

    audits: DataFrame
    turns: DataFrame


def repair(turns: DataFrame, segment: int = SEGMENT, batch: int = BATCH) -> Repaired:
    """Repairs turns(conv_id, turn, role, text) at the least cost; of equally cheap audits the ASCII-least.

    Null roles and texts are one space. Rows go by turn (nulls first), then role and sha256 of the text, so equal rows stand
    together and reruns agree. Null conversation ids are one conversation. A role other than one that begins with s, u or a (also an empty one)
    can't be kept as it is. Other columns are left out, whatever their names; an empty table has no conversations. Very long
    texts move whole but are only matched and hashed; a very long conversation is many segments.
    """
    spark, ws = turns.sparkSession, Workspace(turns.sparkSession)
    space, kind_of = F.lit(" "), turns.schema["conv_id"].dataType
    # ids as text: a null one is a space, which no number is
    rows = turns.select(F.coalesce(F.col("conv_id").cast("string"), space).alias("c"), "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    rows = ws.write(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    words_end = F.regexp_extract("text", f"([^{BLANK}])[{BLANK}]*\\z", 1)
    facts = rows.select("c", "row", "turn", "role", F.substring("role", 1, 1).alias("initial"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), (~F.col("text").rlike(f"[^{BLANK}]")).alias("blank"), (~words_end.isin(*STOPS)).alias("open"), F.lit(1).cast("long").alias("one"))
    ranked = ws.write(with_ranks(facts, "c", ["turn", "role", "sha"], "one", ws, "ranks").drop("one").withColumnRenamed("before", "rank"), "ranked")
    content = ["c", "role", "sha"]
    repeated = ranked.filter("not blank").groupBy(*content).agg(F.min("rank").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    ranked = ranked.join(ws.write(repeated, "repeated"), content, "left").withColumn("duplicate", F.coalesce(F.col("rank") > F.col("first"), F.lit(False)) & ~F.col("blank"))
    ranked = ranked.withColumn("truncated", F.col("open") & ~F.col("blank") & ~F.col("duplicate"))
    ranked = ws.write(ranked.select("c", "row", "rank", "turn", "initial", "blank", "duplicate", "truncated"), "facts")
    ws.drop("ranks", "ranks-totals", "ranked", "repeated")

    n = ranked.count()
    code = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for i, c in enumerate("sua") for x in (c, i))), F.col("initial")), F.lit(3))
    kind = code * 4 + (F.col("blank") | F.col("duplicate")).cast("int") * 2 + F.col("truncated").cast("int")
    seg = F.floor(F.col("rank") / segment)
    # the first row of a segment is also looked at from the one before
    placed = ranked.select("c", "rank", "initial", kind.alias("kind"), F.explode(F.when((F.col("rank") % segment == 0) & (F.col("rank") > 0), F.array(seg, seg - 1)).otherwise(F.array(seg))).alias("seg"))
    placed = placed.select("c", "seg", (F.col("rank") - F.col("seg") * segment).alias("i"), "initial", "kind", (F.col("rank") >= (F.col("seg") + 1) * segment).alias("peek"))

    def batched(df: DataFrame, size: int) -> DataFrame:
        return df.groupBy(F.pmod(F.xxhash64("c", "seg"), F.lit(max(1, math.ceil(size / batch)))).alias("_b"))

    levels = [ws.write(batched(placed, n).applyInArrow(_walk_rows, _PARTS), "level-0")]
    while (last := levels[-1].agg(F.max("seg")).first()[0] or 0) > 0:
        parts = levels[-1].filter("dest >= 0").select("c", F.floor(F.col("seg") / segment).alias("seg"), (F.col("seg") % segment).alias("i"), "origin", "dest", "cost", "letters")
        levels.append(ws.write(batched(parts, n // segment ** (len(levels) - 1)).applyInArrow(_walk_parts, _PARTS), f"level-{len(levels)}"))

    tail = F.element_at(F.create_map(*(F.lit(x) for k, v in ENDS.items() for x in (k, v))), F.col("dest"))
    ends = levels[-1].filter("dest >= 0").withColumn("tail", tail).groupBy("c").agg(F.min(F.struct((F.col("cost") + F.length("tail") * INSERT).alias("cost"), F.concat("letters", F.repeat(F.lit("I"), F.length("tail"))).alias("audit"), "dest", "path", "tail", "letters", "roles")).alias("m"))
    best = ws.write(ends.select("c", "m.*"), "best")

    chosen = best.select("c", F.lit(0).cast("long").alias("seg"), F.lit(0).alias("origin"), "path", "letters", "roles")
    for k in range(len(levels) - 2, -1, -1):
        states = F.split("path", "")
        steps = chosen.select("c", F.col("seg").alias("_s"), "origin", states.alias("_p"), F.posexplode(states).alias("pos", "dest"))
        steps = steps.select("c", (F.col("_s") * segment + F.col("pos")).alias("seg"), F.when(F.col("pos") == 0, F.col("origin")).otherwise(F.get("_p", F.col("pos") - 1).cast("int")).alias("origin"), F.col("dest").cast("int").alias("dest"))
        chosen = steps.join(levels[k].select("c", "seg", "origin", "dest", "path", "letters", "roles"), ["c", "seg", "origin", "dest"]).drop("dest")
    letters = chosen.select("c", "seg", "letters", "roles", F.posexplode(F.split("letters", "")).alias("p", "edit")).filter("edit <> ''")
    so_far = F.substring("letters", F.lit(1), F.col("p") + 1)
    edits = letters.select("c", "seg", "p", "edit", F.when(F.col("edit") != "I", F.col("seg") * segment + F.length(F.replace(so_far, F.lit("I"))) - 1).alias("rank"), F.substring("roles", F.length(F.replace(so_far, F.lit("D"))), F.lit(1)).alias("as")).filter("edit <> 'D'")
    at_end = best.select("c", F.lit((1 << 40) - 1).alias("seg"), F.posexplode(F.split("tail", "")).alias("p", "as")).filter("as <> ''").select("c", "seg", "p", F.lit("I").alias("edit"), F.lit(None).cast("long").alias("rank"), "as")
    known = edits.filter("edit <> 'I'").join(ranked.select("c", "rank", "row"), ["c", "rank"]).join(rows.select("row", "role", "text"), "row")
    as_role = F.element_at(F.create_map(*(F.lit(x) for k, v in ROLES.items() for x in (k, v))), F.col("as"))
    known = known.select("c", "seg", "p", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(as_role).alias("role"), "text")
    new = edits.filter("edit = 'I'").unionByName(at_end).select("c", "seg", "p", "edit", as_role.alias("role"), F.lit("").alias("text"))
    own_id = F.nullif("c", space).cast(kind_of).alias("conv_id")
    mended = known.unionByName(new).select(own_id, (F.col("seg") * (1 << 20) + F.col("p")).alias("place"), "edit", "role", "text")

    counts = ranked.groupBy("c").agg(*(F.count_if(x).alias(x) for x in ("blank", "duplicate", "truncated")), (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    illegal = levels[0].filter("dest < 0").groupBy("c").agg(F.sum("cost").alias("illegal"))
    audits = counts.join(illegal, "c").join(best.select("c", "cost", "audit"), "c")
    return Repaired(audits.select(own_id, F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"), mended)


def conversation_digests(turns: DataFrame) -> DataFrame:
    """conv_id, sha256 of the newline-joined `role:text` of turns(conv_id, place, role, text).

    A hash is made in order, so a conversation's rows pass through one task; they stream by and are not held.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state, begun = None, None, False
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for i, key in enumerate(ids):
                if not begun or key != here:
                    if begun:
                        out.append((here, state.hexdigest()))
                    here, state, begun = key, hashlib.sha256(), True
                else:
                    state.update(b"\n")
                for part in (b.column(1)[i].as_buffer(), b":", b.column(2)[i].as_buffer()):
                    state.update(part)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], b.column(0).type), pa.array([x[1] for x in out], pa.string())], names=["conv_id", "sha256"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([here], b.column(0).type), pa.array([state.hexdigest()], pa.string())], names=["conv_id", "sha256"])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "role", "text")
    return ordered.mapInArrow(digest, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, sha256 string")


def op11_conversations(spark, sf_dir: str) -> DataFrame:
    """Damages the conversations and repairs them: a row for each id of the table; nulls, ties and repeats are as repair has them."""
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = repair(damage(table))
    out = table.select("conv_id").distinct()
    for more in (done.audits, conversation_digests(done.turns)):
        more = more.withColumnRenamed("conv_id", "_id")
        out = out.join(more, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    zeros = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


_SQL_INSERTS = "(0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (3, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])"
_SQL_NEXT = "(0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)"
#: One turn of all conversations in each recursion, over whole conversations and with the repaired rows carried along.
OP11_SQL = f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
f AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(regexp_replace(hex(encode(key)), '(.)(.)', '\\2\\1', 'g'), ''), lambda x: (strpos('0123456789ABCDEF', x) - 1)::BIGINT),
  lambda a, n: xor(a >> 4, [{", ".join(f"{n}::BIGINT" for n in _NIBBLES)}][(xor(a, n) & 15) + 1])), 4294967295::BIGINT) % 20 AS fault FROM k),
d AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[{STOPS}]', '', 'g') ELSE text END AS text, unnest(CASE fault WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM f WHERE fault <> 0),
o AS (SELECT conv_id, turn, role, text, dense_rank() OVER (ORDER BY conv_id) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d),
p AS (SELECT *, NOT regexp_matches(text, '[^{BLANK}]') AS blank, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, lag(role[1:1]) OVER (PARTITION BY c ORDER BY i) || role[1:1] AS pair FROM o),
h AS MATERIALIZED (SELECT *, again AND NOT blank AS duplicate, NOT blank AND NOT again AND NOT regexp_matches(text, '[{STOPS}][{BLANK}]*$') AS truncated FROM p),
inserts AS (SELECT * FROM (VALUES {_SQL_INSERTS}) t(f, g, cost, letters, added)),
grammar AS (SELECT * FROM (VALUES {_SQL_NEXT}) t(f, initial, g)),
edits AS MATERIALIZED (
  SELECT c, i, s AS f, s AS g, {DELETE} AS cost, 'D' AS letter, []::VARCHAR[] AS added FROM h, range(4) t(s)
  UNION ALL SELECT c, i, f, g, truncated::INT, 'K', [role || ':' || text] FROM h JOIN grammar ON initial = role[1:1] WHERE NOT (blank OR duplicate)
  UNION ALL SELECT c, i, f, g, {REROLE} + truncated::INT, 'R', [CASE initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] FROM h JOIN grammar ON initial IN ('u', 'a') WHERE NOT (blank OR duplicate)),
walk(c, i, s, m) AS (
  SELECT DISTINCT c, 0::BIGINT, 0::BIGINT, {{'cost': 0::BIGINT, 'audit': '', 'kept': []::VARCHAR[]}} FROM h
  UNION ALL
  SELECT w.c, w.i + 1, e.g::BIGINT, min({{'cost': w.m.cost + n.cost + e.cost, 'audit': w.m.audit || n.letters || e.letter, 'kept': w.m.kept || n.added || e.added}})
  FROM walk w JOIN inserts n ON n.f = w.s JOIN edits e ON e.c = w.c AND e.i = w.i + 1 AND e.f = n.g GROUP BY ALL),
ends AS (SELECT w.c, min({{'cost': w.m.cost + n.cost, 'audit': w.m.audit || n.letters, 'kept': w.m.kept || n.added}}) AS m FROM walk w JOIN inserts n ON n.f = w.s AND n.g IN (0, 3) WHERE w.i = (SELECT max(i) FROM h WHERE h.c = w.c) GROUP BY w.c),
counts AS (SELECT conv_id, c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM h GROUP BY conv_id, c)
SELECT t.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(m.cost, 0)::BIGINT AS cost, coalesce(m.audit, '') AS audit, sha256(coalesce(array_to_string(m.kept, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) t LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN ends USING (c)
"""
