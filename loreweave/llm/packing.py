"""Packing token pieces into sequences of fixed capacity by a configuration linear program.

A configuration says how many pieces of each length one sequence holds. The covering program
(fewest sequences so that every length is covered as often as it occurs) is solved by
multiplicative weights: a length's price falls as it is covered, and a knapsack dynamic program
prices the configurations. The fractional solution is rounded down on the integer histogram, then
its configurations are taken once each while their pieces last; the program is solved again for what
is left, until little is. Only that remainder is placed best-fit. Only the length histogram (at most
`capacity` rows) reaches the driver; the plan is a table of ranges (so many copies of a
configuration), and every piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import BROADCAST_ROWS, Workspace, read_table
from .textblocks import slices
from .tokens import encoder

CAPACITY = 1024
END_ID = 2
#: Rounds in which the program covers the whole histogram, an equal share of each length's need in each.
ROUNDS = 10
#: A length's price falls by exp(-STEP) while it is covered once.
STEP = 0.02
#: What a configuration may be worth less than the best one, and the best one of a round's later prices less than of its first.
SLACK, TIRED = 0.006, 0.01
#: The program is solved again while more than this share of the ids is left.
LITTLE = 0.02
#: Configurations drawn at one set of prices.
DRAWS = 64

Items = list[tuple[int, int]]


def _price(value: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack: the best value within each capacity; lengths ascend."""
    best = np.zeros(capacity + 1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for w in range(int(lengths[0]), capacity + 1):
        n = fitting[w]
        best[w] = max(best[w - 1], (best[w - lengths[:n]] + value[:n]).max())
    return best


def _draw(best: np.ndarray, value: np.ndarray, lengths: np.ndarray, quota: np.ndarray, first: int, spare: float) -> Counter | None:
    """A configuration that starts with `first`, goes on with the longest pieces that fit and is worth `spare` less than the best at most."""
    items, w, k = Counter(), len(best) - 1, first
    while True:
        spare -= max(best[w] - best[w - lengths[k]] - value[k], 0.0)
        if spare < 0:
            return None
        items[k] += 1
        w -= int(lengths[k])
        n = int(np.searchsorted(lengths, w, "right"))
        fits = np.flatnonzero((quota[:n] > 0) & (best[w] - best[w - lengths[:n]] - value[:n] <= spare))
        if not len(fits):
            return items if best[w] <= spare + 1e-12 else None
        k = int(fits[-1])


def fractional(lengths: np.ndarray, need: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[Counter, np.ndarray]:
    """({configuration: sequences of it}, how many times each length is covered); lengths ascend, configurations name their indices.

    Each configuration rises by its own bottleneck, the least that its lengths may still gain in a
    round, so the number of rounds does not depend on the scarcest length. Lengths that have gained
    all they may leave the dynamic program until the next round; what a round could not cover well is
    left to the later ones at a higher price, and after the last to rounds of their own, until every
    length is covered within 1 %.
    """
    covered, use, r, before = np.zeros(len(lengths)), Counter(), 0, -1.0
    while (ratio := covered / need).min() < 0.99 and (r < rounds or covered.sum() > before):
        r, before = r + 1, covered.sum()
        value = lengths / capacity * np.exp(-STEP * (ratio - ratio.min()))
        quota, top, made = min(r / rounds, 1.0) * need - covered, 0.0, 1
        quota[quota < 1e-9 * need] = 0
        while made and len(open_ := np.flatnonzero(quota)):
            best = _price(value[open_], lengths[open_], capacity)
            top, made = top or best[capacity], 0
            if best[capacity] < (1 - TIRED) * top:
                break
            good = open_[best[capacity] - best[capacity - lengths[open_]] - value[open_] <= SLACK * top]
            for k in good[::-1][:DRAWS].tolist():  # long pieces first
                if quota[k] <= 0 or (items := _draw(best, value, lengths, quota, k, SLACK * top)) is None:
                    continue
                at, a = np.array(list(items)), np.array(list(items.values()), float)
                step, made = float((quota[at] / a).min()), made + 1
                use[tuple(sorted(items.items()))] += step
                covered[at] += step * a
                quota[at] -= step * a
                quota[quota < 1e-9 * need] = 0
    return use, covered / need


def plan_parts(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list, list, list]:
    """The plan in three parts: sequences that one piece fills, those of the program's configurations, and the remainder's."""
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("lengths must lie between 1 and the capacity")
    whole = [(n, [(capacity, 1)])] if (n := left.pop(capacity, 0)) else []
    program: list[tuple[int, Items]] = []
    remainder: list[tuple[int, Items]] = []
    lengths = np.array(sorted(left), np.int64)
    rest = np.array([left[k] for k in lengths.tolist()], np.int64)

    def take(to: list, have: np.ndarray, items, copies: int) -> int:
        """Takes so many copies, or as many as the pieces left allow."""
        copies = min(copies, *(int(rest[have[k]]) // a for k, a in items))
        if copies > 0:
            to.append((copies, [(int(lengths[have[k]]), a) for k, a in items]))
            for k, a in items:
                rest[have[k]] -= copies * a
        return copies

    most = float((rest * lengths).sum())
    while float((rest * lengths).sum()) > LITTLE * most:
        have = np.flatnonzero(rest)
        use, ratio = fractional(lengths[have], rest[have].astype(float), capacity, rounds)
        scale = 1 / max(float(ratio.mean()), 1e-9)
        empty = {c: capacity - sum(a * int(lengths[have[k]]) for k, a in c) for c in use}
        # what only emptier sequences cover is left to the next program, whose pieces are others
        full = min(empty.values()) + (SLACK + TIRED) * capacity
        ordered = sorted(((c, x) for c, x in use.items() if empty[c] <= full), key=lambda t: (-t[1], t[0]))
        got = sum(take(program, have, c, int(x * scale)) for c, x in ordered if x * scale >= 1)
        got += sum(take(program, have, c, 1) for c, _ in ordered)
        if not got:
            break
    while rest.any():
        have = np.flatnonzero(rest)
        take(remainder, have, _fullest(lengths[have], rest[have], capacity), int(rest.max()))
    return whole, program, remainder


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[int, Items]]:
    """[(copies, [(length, pieces of it in a sequence)])] that holds each piece of the histogram once."""
    whole, program, remainder = plan_parts(histogram, capacity, rounds)
    return whole + program + remainder


def _fullest(lengths: np.ndarray, rest: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """A sequence that starts with the longest piece left and is filled as far as a bounded knapsack can."""
    room, top = capacity - int(lengths[-1]), len(lengths) - 1
    reach = 1  # bit w: fill w can be made
    seen: list[tuple[int, int, int]] = []  # item, copies, fills before it
    full = (1 << (room + 1)) - 1
    for k in range(top, -1, -1):
        size, n = int(lengths[k]), int(rest[k]) - (k == top)
        n, chunk = min(n, room // size), 1
        while n > 0:
            take = min(chunk, n)
            seen.append((k, take, reach))
            reach |= (reach << (take * size)) & full
            n, chunk = n - take, chunk * 2
        if reach >> room & 1:
            break
    w = reach.bit_length() - 1
    items = Counter([top])
    for k, take, before in reversed(seen):
        if not before >> w & 1:
            items[k] += take
            w -= take * int(lengths[k])
    return list(items.items())


def _places(plan: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, per sequence, first sequence, first offset), sorted by length and rank."""
    rows, used, sequence = [], Counter(), 0
    for copies, items in plan:
        offset = 0
        for length, a in items:
            rows.append((length, used[length], a, sequence, offset))
            used[length] += copies * a
            offset += a * length
        sequence += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def token_pieces(docs: DataFrame, ws: Workspace, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Pieces of every whole text, written once: a longer document is cut, its first piece takes what whole ones leave.

    nth numbers the pieces of one length within a task (part).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in slices(batches, 1):
            out: list[list] = [[] for _ in range(6)]
            for key, raw in zip(b.column(0).to_pylist(), enc.encode_column(b.column(1))):
                raw += end
                n = len(raw) // 4
                start, piece, size = 0, 0, (n - 1) % capacity + 1
                while start < n:
                    out[0].append(key), out[1].append(piece), out[2].append(start), out[3].append(size)
                    out[4].append(zlib.crc32(raw[4 * start : 4 * (start + size)])), out[5].append(int(seen[size]))
                    seen[size] += 1
                    start, piece, size = start + size, piece + 1, capacity
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:5]), pa.array(np.full(len(out[0]), part, np.int32)), pa.array(out[5], pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return ws.write(docs.select("doc_id", "text").mapInArrow(cut, PIECES), "pieces")


def pack_pieces(pieces: DataFrame, ws: Workspace, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces(length, part, nth, ...): sequences are gapless from offset 0.

    An empty table gives no rows. Equal lengths are interchangeable: the rank of a piece among its
    length (tasks in order, then nth) decides its place.
    """
    counts = ws.write(pieces.groupBy("part", "length").count(), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = _places(solve(histogram, capacity))
    keys = places[:, 0] * (1 << 44) + places[:, 1]
    shared = pieces.sparkSession.sparkContext.broadcast((keys, places))
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("before"))
    if counts.count() <= BROADCAST_ROWS:
        before = F.broadcast(before)
    ranked = pieces.join(before, ["part", "length"])
    names = [c for c in pieces.columns if c not in ("part", "nth", "length")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, places = shared.value
        for b in batches:
            length, rank = (b.column(k).to_numpy() for k in (0, 1))
            row = places[np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1]
            k = rank - row[:, 1]
            extra = [pa.array(row[:, 3] + k // np.maximum(row[:, 2], 1)), pa.array(row[:, 4] + k % np.maximum(row[:, 2], 1) * length)]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], b.column(0), *extra], names=[*names, "length", "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "length long, sequence_id long, offset long"])
    return ranked.select("length", (F.col("before") + F.col("nth")).alias("rank"), *names).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Packs docs(doc_id, text): a row per piece with its place.

    Null and empty texts are the end id alone, so every row has a piece. doc_id is only carried: rows
    with a null or repeated doc_id each have pieces of their own. A text of any length is cut into
    pieces of `capacity` ids, of which the first may be shorter. Pieces of equal length (ties) are
    placed in the order of tasks and rows. An empty table gives no rows; further columns are left out,
    whatever their names.
    """
    ws = Workspace(docs.sparkSession)
    packed = pack_pieces(token_pieces(docs, ws, capacity, end_id, tokenizer), ws, capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents; rows, nulls, ties and an empty table are as pack_documents has them."""
    return pack_documents(read_table(spark, sf_dir, "documents"))
