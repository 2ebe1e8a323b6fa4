"""Streaming source `multistream_pages`: pages of all dumps of a folder, a number of index lines of each file at a time.

Options: folder (dumps with their indexes, mounted on driver and workers), lines (of each file in a batch), state (a file
where the driver notes what it has planned; the next planner goes on there), task_bytes. Offsets are {index file: lines read}. A batch ends where a byte
range ends. Progress is Spark's: a batch that was planned and not committed is planned again from its logged
offsets, a committed one is not.
"""

from __future__ import annotations

import bz2
import glob
import json
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from .index import INDEX_NAME
from .multistream import TASK_BYTES, Ranges, by_length, local, page_batches, read_ranges


def dumps_of(folder: str) -> dict[str, str]:
    """Index file -> dump file, of the indexes that have one."""
    found = {}
    for path in sorted(glob.glob(f"{folder}/**/*.txt.bz2", recursive=True)):
        if m := re.fullmatch(INDEX_NAME.strip("^$"), os.path.basename(path)):
            dump = os.path.join(os.path.dirname(path), f"{m[1]}{m[2]}.xml.bz2")
            if os.path.isfile(dump):
                found[path] = dump
    return found


class IndexCursor:
    """Reads an index forwards: byte ranges with the number of the line after them."""

    def __init__(self, path: str):
        self.lines = enumerate(bz2.open(path, "rt", encoding="utf-8", errors="ignore", newline="\n"), 1)
        self.at = 0
        self.next: tuple[int, int] | None = None  # the first line of the next range: (line, offset)
        self.over = False

    def _range(self) -> tuple[int, int | None, int] | None:
        """(start, end, last line) of the next range."""
        start = self.next[1] if self.next else None
        last = self.next[0] if self.next else self.at
        for n, line in self.lines:
            parts = line.strip().split(":", 2)
            try:
                offset = int(parts[0]) if len(parts) == 3 else None
            except ValueError:
                offset = None
            if offset is not None and start is not None and offset != start:
                self.next = (n, offset)
                return start, offset, last
            start, last = (offset if start is None else start), n
        self.next, self.over = None, True
        return None if start is None else (start, None, last)

    def take(self, lines: int) -> tuple[list[tuple[int, int | None]], int]:
        """(ranges, lines read) of at least so many lines more, up to the end of a range."""
        found, begun = [], self.at
        while not self.over and self.at - begun < lines:
            if (r := self._range()) is not None:
                found.append(r[:2])
                self.at = r[2]
        return found, self.at

    def skip(self, to: int) -> None:
        while not self.over and self.at < to:
            self.take(to - self.at)


class PageStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.state = local(options["folder"]), local(options["state"])
        self.step, self.task_bytes = int(options.get("lines", "1000000")), int(options.get("task_bytes", str(TASK_BYTES)))
        self.cursors: dict[str, IndexCursor] = {}
        self.ahead: dict[str, tuple[int, int, list]] = {}  # (from, to, ranges) of what was looked up last
        self.planned: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return {}

    def _planned(self) -> dict[str, int]:
        if self.planned is None:
            try:
                with open(self.state) as f:
                    self.planned = json.load(f)
            except FileNotFoundError:
                self.planned = {}
        return self.planned

    def _ranges(self, path: str, start: int, end: int | None) -> tuple[list, int]:
        """(ranges, last line) after line `start`, of `step` lines or up to line `end`."""
        known = self.ahead.get(path)
        if known and known[0] == start and end in (None, known[1]):
            return known[2], known[1]
        cursor = self.cursors.get(path)
        if cursor is None or cursor.at > start:
            cursor = self.cursors[path] = IndexCursor(path)
        cursor.skip(start)
        ranges, at = cursor.take(self.step if end is None else end - start)
        self.ahead[path] = (start, at, ranges)
        return ranges, at

    def latestOffset(self) -> dict:
        planned = self._planned()
        return planned | {path: self._ranges(path, planned.get(path, 0), None)[1] for path in dumps_of(self.folder)}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        of, out = dumps_of(self.folder), []
        for path, last in end.items():
            if last > start.get(path, 0) and path in of:
                out += [Ranges(of[path], g) for g in by_length(self._ranges(path, start.get(path, 0), last)[0], self.task_bytes)]
        self.planned = dict(end)
        draft = f"{self.state}.{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(self.state), exist_ok=True)
        with open(draft, "w") as f:
            json.dump(self.planned, f)
        os.replace(draft, self.state)
        return out

    def read(self, partition: Ranges) -> Iterator[tuple]:
        return read_ranges(partition.path, partition.ranges)


class BatchedReader(PageStreamReader):
    """The same pages in batches of bounded length, as Spark takes them."""

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return page_batches(super().read(partition))


class PageStreamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "multistream_pages"

    def schema(self) -> str:
        return "path string, start long, end long, page string, error string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return BatchedReader(self.options)
