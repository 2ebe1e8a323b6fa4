"""Data source `multistream`: pages of concatenated bz2 streams, one partition per group of byte ranges.

Options: path (dump file, local or mounted on every worker), ranges (JSON [[start, end or null], ...]),
per_task (ranges in a partition) or task_bytes. A range that cannot be read gives a row with an error after its pages.
"""

from __future__ import annotations

import bz2
import codecs
import json
import os
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that are read, decompressed or sent on at once; compressed bytes of a task.
PIECE, TASK_BYTES = 1 << 20, 64 << 20
#: How a bz2 stream begins (fixed value).
STREAM = b"BZh"
#: Columns of pages as they are read.
PAGES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("page", pa.string()), ("error", pa.string())])


class Ranges(InputPartition):
    def __init__(self, path: str, ranges: list):
        self.path, self.ranges = path, ranges


def local(path: str) -> str:
    """The path of a file that is mounted on every worker."""
    return path.removeprefix("file://").removeprefix("file:")


def texts(f: BinaryIO, start: int, end: int | None) -> Iterator[str]:
    """The text of a byte range, piece by piece: bz2 streams are decompressed as they are read, no more than PIECE bytes at once.

    Bytes that are no UTF-8 are left out, and so is what follows the last stream and begins none. An empty range has no text.
    """
    f.seek(start)
    left = None if end is None else max(end - start, 0)

    def more() -> bytes:
        nonlocal left
        piece = f.read(PIECE if left is None else min(PIECE, left))
        left = None if left is None else left - len(piece)
        return piece

    decoder, raw, streams = codecs.getincrementaldecoder("utf-8")("ignore"), b"", 0
    while True:
        while len(raw) < len(STREAM) and (piece := more()):
            raw += piece
        if not raw or (streams and not raw.startswith(STREAM)):
            return
        unzip = bz2.BZ2Decompressor()
        while not unzip.eof:
            if unzip.needs_input and not raw and not (raw := more()):
                raise EOFError("the data end within a stream")
            text = unzip.decompress(raw, PIECE)
            raw = b""
            yield decoder.decode(text)
        raw, streams = unzip.unused_data, streams + 1


def pages_in(pieces: Iterator[str]) -> Iterator[str]:
    """Bodies of page elements of a text that comes in pieces; what is held is the page that is open."""
    held: list[str] = []
    inside, tail = False, ""
    for piece in pieces:
        text = tail + piece
        tail = ""
        while True:
            mark = "</page>" if inside else "<page>"
            at = text.find(mark)
            if at < 0:
                keep = len(mark) - 1  # a mark may be cut by the end of the piece
                if inside:
                    held.append(text[: max(len(text) - keep, 0)])
                tail = text[max(len(text) - keep, 0) :]
                break
            if inside:
                held.append(text[:at])
                yield "".join(held)
                held = []
            text, inside = text[at + len(mark) :], not inside


def read_ranges(path: str, ranges: list) -> Iterator[tuple]:
    """(path, start, end, page, error) of byte ranges of a dump. A range that cannot be read to its end gives an error row after the pages before it."""
    for start, end in ranges:
        try:
            with open(path, "rb") as f:
                for page in pages_in(texts(f, start, end)):
                    yield path, start, end, page, None
        except (OSError, ValueError, EOFError) as e:
            yield path, start, end, None, f"{type(e).__name__}: {e}"


def page_batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of read_ranges in batches of about PIECE characters. Spark batches tuples by number, ten thousand pages of any length at once."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), PAGES)], schema=PAGES)

    for row in rows:
        held.append(row)
        size += len(row[3] or "") + len(row[0])
        if size > PIECE:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def by_length(ranges: list, most: int) -> Iterator[list]:
    """Consecutive ranges in groups of about `most` bytes; an open range counts as `most`."""
    group, size = [], 0
    for start, end in ranges:
        length = most if end is None else max(end - start, 0)
        if group and size + length > most:
            yield group
            group, size = [], 0
        group.append((start, end))
        size += length
    if group:
        yield group


class MultistreamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = local(options["path"])
        self.ranges = json.loads(options["ranges"])
        self.per_task = options.get("per_task")
        self.task_bytes = int(options.get("task_bytes", str(TASK_BYTES)))

    def partitions(self) -> list[Ranges]:
        r = self.ranges
        groups = by_length(r, self.task_bytes) if self.per_task is None else (r[i : i + int(self.per_task)] for i in range(0, len(r), int(self.per_task)))
        return [Ranges(self.path, g) for g in groups] or [Ranges(self.path, [])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return page_batches(read_ranges(partition.path, partition.ranges))


class MultistreamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "multistream"

    def schema(self) -> str:
        return "path string, start long, end long, page string, error string"

    def reader(self, schema) -> DataSourceReader:
        return MultistreamReader(self.options)


class IndexReader(DataSourceReader):
    """Lines of compressed indexes; a task streams one file, so a line's number is known and no file is held whole."""

    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])

    def partitions(self) -> list[InputPartition]:
        return [Ranges(p, []) for p in self.paths] or [Ranges("", [])]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        if partition.path:
            with bz2.open(local(partition.path), "rt", encoding="utf-8", errors="ignore", newline="\n") as f:
                for n, line in enumerate(f, 1):
                    if line := line.rstrip("\r\n"):
                        yield partition.path, n, line


class IndexSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "multistream_index"

    def schema(self) -> str:
        return "path string, line_no long, value string"

    def reader(self, schema) -> DataSourceReader:
        return IndexReader(self.options)


def pages_of(ranges: DataFrame) -> DataFrame:
    """path, start, end, page, error of ranges(dump, start, end): each task reads its own ranges, which never visit the driver."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in b.to_pylist())
        return page_batches(found for row in rows for found in read_ranges(local(row["dump"]), [(row["start"], row["end"])]))

    return ranges.select("dump", "start", "end").mapInArrow(read, "path string, start long, end long, page string, error string")


def read_pages(spark: SparkSession, dump: str, ranges: list[tuple[int, int | None]], per_task: int | None = None) -> DataFrame:
    """path, start, end, page, error. The ranges of one dump are metadata of its index; a task has per_task of them, or about TASK_BYTES."""
    spark.dataSource.register(MultistreamSource)
    reader = spark.read.format("multistream").option("ranges", json.dumps([list(r) for r in ranges]))
    return (reader if per_task is None else reader.option("per_task", str(per_task))).load(dump)


def write_dump(pages: DataFrame, folder: str, name: str = "enwiki", stream_pages: int = 100) -> None:
    """Writes pages(pid, title, xml) as multistream dumps with their indexes: a pair of files <name>-<n>.. per task, on a folder that is mounted on every worker.

    A task writes under draft names and renames at the end, so a task that is run again leaves no half file.
    """
    home = local(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        dump, index = f"{home}/{name}-p{part}.xml.bz2", f"{home}/{name}-p-index{part}.txt.bz2"
        draft = f".{uuid.uuid4().hex}"
        os.makedirs(home, exist_ok=True)
        with open(dump + draft, "wb") as out, bz2.open(index + draft, "wt", encoding="utf-8", newline="\n") as lines:
            out.write(bz2.compress(b"<mediawiki>\n"))
            held: list[str] = []

            def flush() -> None:
                if held:
                    out.write(bz2.compress("".join(held).encode()))
                    held.clear()

            parts = (b.slice(at, stream_pages) for b in batches for at in range(0, b.num_rows, stream_pages))  # texts of no more than a stream or two are held
            for b in parts:
                for pid, title, xml in zip(*(c.to_pylist() for c in b.columns)):
                    lines.write(f"{out.tell()}:{pid}:{title}\n")
                    held.append(xml)
                    if len(held) == stream_pages:
                        flush()
            flush()
            out.write(bz2.compress(b"</mediawiki>\n"))
        os.replace(dump + draft, dump)
        os.replace(index + draft, index)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])

    pages.select("pid", "title", "xml").mapInArrow(write, "part int").write.format("noop").mode("overwrite").save()
