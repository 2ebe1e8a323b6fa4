"""Token ids in word-aligned blocks (Simple-8b): each 64-bit word holds a selector and 1 to 240 ids.

File format: Parquet files, a row per block. `payload` is little-endian 64-bit words; the top four
bits of a word are its selector, which sets how many ids the word holds and their width. An id too
wide for any selector is an escape: selector 15, the id in the low 60 bits. A block holds whole
documents in doc_id order; `offsets` gives each document's first word in the payload and `counts`
its number of ids, so that a document, or a block, can be decoded alone and all words with one
selector at once. A document starts at a word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import BROADCAST_ROWS, Workspace
from .textblocks import slices
from .tokens import encoder

#: Selector -> (ids in a word, bits of each); 0 and 1 are runs of id 0, 15 is the escape.
LAYOUTS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
BLOCK_IDS = 1 << 16
END_ID = 2


def pack_all(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words for documents of counts ids below 2**60, end to end, and the first word of each document.

    A word takes as many of its document's next ids as fit, or all that are left.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)
    wide = np.frexp(ids.astype(np.float64))[1].astype(np.int8)
    wide[ids == 0] = 0
    select = np.full(n, 15, np.int8)
    # from the narrowest count up, so that the largest count that fits is written last
    reach = {1: wide}
    have = 1
    for s in range(14, -1, -1):
        count, bits = LAYOUTS[s]
        while have < count:  # widest id among the next `have` ids, grown to the counts that occur
            step = min(have, count - have)
            m = reach[have]
            grown = m.copy()
            grown[: n - step] = np.maximum(m[: n - step], m[step:]) if step < n else m[: n - step]
            have += step
            reach = {have: grown}
        np.copyto(select, s, where=reach[have] <= bits)
    takes = np.minimum(np.array([c for c, _ in LAYOUTS])[select], left)
    heads, i, step = [], 0, takes.tolist()
    while i < n:
        heads.append(i)
        i += step[i]
    heads = np.array(heads)
    chosen = select[heads].astype(np.uint64)
    words = chosen << np.uint64(60)
    for s in range(2, 16):
        mine = np.flatnonzero(chosen == s)
        count, bits = LAYOUTS[s]
        for k in range(count if len(mine) else 0):
            at = heads[mine] + k
            ok = k < takes[heads[mine]]
            words[mine[ok]] |= ids[at[ok]].astype(np.uint64) << np.uint64(k * bits)
    return words, np.searchsorted(heads, np.cumsum(counts) - counts)


def pack(ids: np.ndarray) -> np.ndarray:
    """Words for one document."""
    return pack_all(ids, np.array([len(ids)]))[0]


def unpack(words: np.ndarray, counts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ids of documents whose words begin at offsets and that hold counts ids, end to end."""
    if not len(words):
        return np.zeros(0, np.int64)
    select = (words >> np.uint64(60)).astype(np.int64)
    holds = np.array([c for c, _ in LAYOUTS])[select]
    # a document's last word may hold fewer ids than its selector could
    full = np.concatenate([[0], np.cumsum(holds)])
    ends = np.append(offsets[1:], len(words))
    some = ends > offsets
    last = ends[some] - 1
    holds[last] -= (full[ends] - full[offsets] - counts)[some]
    begin = np.concatenate([[0], np.cumsum(holds)])
    out = np.zeros(begin[-1], np.int64)
    for s in np.unique(select):
        count, bits = LAYOUTS[s]
        if not bits:
            continue
        mine = np.flatnonzero(select == s)
        mask = np.uint64((1 << bits) - 1)
        for k in range(count):
            held = mine[holds[mine] > k]
            out[begin[held] + k] = ((words[held] >> np.uint64(k * bits)) & mask).astype(np.int64)
    return out


BLOCKS = "shard int, block int, start long, doc_ids array<long>, counts array<long>, offsets array<long>, payload binary"


def write_token_files(docs: DataFrame, ws: Workspace, name: str = "token-files", tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Tokenizes docs(doc_id, text), appends end_id to each and writes blocks in ascending doc_id order.

    Null and empty texts hold the end id alone. A null doc_id sorts first. Rows with one doc_id are in
    order of their texts' hashes, and equal rows are written as often as they occur. `start` counts
    ids before the block in its shard; shards are ranges of that order, so lower shards come first and
    a doc_id that very many rows share, null for one, spreads over shards. A block holds at least one
    document and otherwise at most BLOCK_IDS ids. An empty table makes no blocks; further columns are ignored.
    """
    fields = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number, start = TaskContext.get().partitionId(), 0, 0
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        ids, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            counts = np.array([len(x) // 4 for x in held])
            words, offsets = pack_all(np.frombuffer(b"".join(held), "<u4"), counts)
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": number, "start": start, "doc_ids": ids, "counts": counts.tolist(), "offsets": offsets.tolist(), "payload": words.astype("<u8").tobytes()}], schema=fields)

        for b in slices(batches, 1):
            for key, raw in zip(b.column(0).to_pylist(), enc.encode_column(b.column(1))):
                if held and size + len(raw) // 4 >= BLOCK_IDS:
                    yield flush()
                    number, start = number + 1, start + size
                    ids, held, size = [], [], 0
                ids.append(key), held.append(raw + end)
                size += len(raw) // 4 + 1
        if held:
            yield flush()

    # texts are dealt into ranges before they are encoded, so that the sample of the exchange encodes nothing
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    order = ["doc_id", "_hash", "_row"]
    return ws.write(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(block, BLOCKS), name)


def read_token_files(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """Decodes the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and if asked for ids (binary, little-endian unsigned 32-bit)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    totals = files.groupBy("shard").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard file
    before = totals.select("shard", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    if totals.count() <= BROADCAST_ROWS:
        before = F.broadcast(before)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                counts = np.array(row["counts"], np.int64)
                ids = unpack(np.frombuffer(row["payload"], "<u8"), counts, np.array(row["offsets"], np.int64)).astype("<u4")
                ends = np.cumsum(counts)
                starts = row["before"] + row["start"] + ends - counts
                parts = [ids[a:z].tobytes() for a, z in zip(ends - counts, ends)]
                out = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(counts), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(out[: 4 + with_ids], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])

    rows = files.join(before, "shard").select("start", "before", "doc_ids", "counts", "offsets", "payload")
    return rows.mapInArrow(decode, schema)


def op8_simple8b(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of every document, from the files."""
    from .common import read_table

    ws = Workspace(spark)
    files = write_token_files(read_table(spark, sf_dir, "documents"), ws)
    return read_token_files(files, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
