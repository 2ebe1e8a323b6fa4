"""A run of the knowledge service, and what its interface answers: run, stop, search, retrieve, history."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..config import Config
from ..functions.text import joined, source_of, tokens
from ..functions.vectors import RandomEmbedder, embed_with, query_text
from ..operators import history as hs, pages as pg, search as sr, store as st
from ..operators.chunking import chunk_rows
from ..operators.vector_index import VectorIndex
from ..sources import index as ix
from ..sources.dumps import Fetch
from ..sources.multistream import pages_of
from ..sources.refresh import DumpRefresh
from ..streaming import stages
from ..streaming.quarantine import Quarantine


class Knowledge(Protocol):
    """What another kind of source has to offer to be run by Service."""

    name: str

    def pages(self, spark: SparkSession) -> DataFrame: ...

    def fingerprint(self, spark: SparkSession) -> int: ...


class Dumps:
    """Articles of multistream dumps in a folder."""

    name = "wikipedia"

    def __init__(self, config: Config):
        self.config = config

    def _pairs(self, spark: SparkSession) -> list:
        return ix.discover(spark, self.config.content_folder).select("path", "name", "dump").collect()  # a row per index file

    def fingerprint(self, spark: SparkSession) -> int:
        return hs.run_fingerprint([r[k].removeprefix("file:") for r in self._pairs(spark) for k in ("path", "dump")])

    def ranges(self, spark: SparkSession) -> DataFrame:
        """path (of the index), dump, name, line_no, start, end of all dumps."""
        pairs = self._pairs(spark)  # a row per index file
        of = spark.createDataFrame([(r["path"], r["dump"], r["name"]) for r in pairs], "path string, dump string, name string")
        lines = ix.parse_lines(ix.read_index(spark, *[r["path"] for r in pairs]))
        return ix.byte_ranges(lines, by="path").join(F.broadcast(of), "path")

    def pages_of(self, ranges: DataFrame) -> DataFrame:
        """Parsed pages. Ranges that cannot be read give no pages."""
        spark = ranges.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        raw = pages_of(ranges.repartition(parts, "dump", "start")).filter("page is not null")
        if self.config.debug_pages:
            pg.debug_pages(raw, f"{self.config.work_folder}/debug_extracted_pages")
        return pg.parse_pages(raw, source=source_of(F.element_at(F.split("path", "/"), -1)))

    def pages(self, spark: SparkSession) -> DataFrame:
        return self.pages_of(self.ranges(spark))

    # ---- as a stream

    def stream(self, spark: SparkSession, state: str) -> DataFrame:
        """Raw pages of so many index lines of each dump at a time."""
        return stages.page_stream(spark, self.config.content_folder, state, self.config.progress_lines)

    def state_file(self, run_id: int) -> str:
        """Where the driver notes what a run has planned: in the work folder if it is mounted, else beside the dumps."""
        work = self.config.work_folder.removeprefix("file://").removeprefix("file:")
        return f"{self.config.content_folder if '://' in work else work}/planned-{run_id}.json"

    def parsed(self, raw: DataFrame) -> DataFrame:
        """Parsed pages of a batch of the stream."""
        found = raw.filter("page is not null")
        if self.config.debug_pages:
            pg.debug_pages(found, f"{self.config.work_folder}/debug_extracted_pages")
        return pg.parse_pages(found, source=source_of(F.element_at(F.split("path", "/"), -1)))


class StageFailed(RuntimeError):
    """A stage ended with an error; its message has the cause."""


class Service:
    """One run at a time, in stages that resume from their checkpoints."""

    def __init__(self, spark: SparkSession, config: Config, source: Knowledge | None = None, embed: Callable[[Column], Column] | None = None, tokenize: Callable[[Column], Column] = tokens, detokenize: Callable[[Column], Column] = joined):
        self.spark, self.config, self.source = spark, config, source or Dumps(config)
        self.tokenize, self.detokenize = tokenize, detokenize
        dimension, seed = config.dimension, config.seed
        self.embed = embed or embed_with(lambda: RandomEmbedder(dimension, seed), config.batch_size, config.token_budget)
        w = config.work_folder
        self.store, self.history = st.ChunkStore(spark, f"{w}/store"), hs.RunHistory(spark, f"{w}/run_history")
        self.quarantine = Quarantine(spark, f"{w}/quarantine", schemas.PROCESSED_MESSAGE, config.attempts)
        self._lock, self._stop, self._active, self._tag = threading.Lock(), threading.Event(), [], f"loreweave-{uuid.uuid4().hex}"
        self._index: VectorIndex | None = None

    @property
    def running(self) -> bool:
        return self._lock.locked()

    def stop(self) -> None:
        """Ends the run: its streams are stopped and its jobs cancelled. What was not committed is done again by a later run."""
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(self._tag)
        for q in list(self._active):
            q.stop()

    def _failure(self, query) -> None:
        """Raises what a stream has ended with, unless it was stopped."""
        if (e := query.exception()) is not None and not self._stop.is_set():
            raise StageFailed(str(e))

    def _wait(self, query, drained: Callable[[], bool] | None = None) -> int:
        """Rows that a stream has read until it ends; one that does not end by itself is stopped once it is drained."""
        rows: dict[int, int] = {}
        over = False
        try:
            while not over:  # Spark keeps the last progress reports only, so they are looked at again and again
                over = query.awaitTermination(0.5) if query.isActive else True
                rows.update((p["batchId"], p["numInputRows"]) for p in query.recentProgress if p["numInputRows"])
                if not over and drained is not None and drained():
                    query.processAllAvailable()
                    rows.update((p["batchId"], p["numInputRows"]) for p in query.recentProgress if p["numInputRows"])
                    query.stop()
        except Exception:
            if not self._stop.is_set() and query.exception() is None:
                raise
        finally:
            if query in self._active:
                self._active.remove(query)
        self._failure(query)
        return sum(rows.values())

    def _begun(self, query):
        self._active.append(query)
        if self._stop.is_set():
            query.stop()
        return query

    def run(self, run_id: int | None = None) -> int | None:
        """Ingests, processes and stores; returns the run's id, or None when a run is on already."""
        if not self._lock.acquire(blocking=False):
            return None
        self._stop.clear()
        self.spark.sparkContext.addJobTag(self._tag)
        try:
            c, name, log = self.config, self.source.name, self.history.append
            run_id = self.source.fingerprint(self.spark) if run_id is None else run_id
            again = not hs.run_exists(self.history.read(), run_id).isEmpty()
            log(run_id, name, schemas.RUN_CONTINUED if again else schemas.RUN_STARTED)
            try:
                if c.concurrent and c.ingest and c.process and hasattr(self.source, "stream"):
                    self._at_once(run_id)
                else:
                    self._in_turn(run_id)
                if c.store and not c.skip_store and not self._stop.is_set():
                    self.build_index()
            except Exception:
                if not self._stop.is_set():  # a job that was cancelled
                    raise
            self.spark.sparkContext.removeJobTag(self._tag)
            log(run_id, name, schemas.RUN_STOPPED if self._stop.is_set() else schemas.RUN_ENDED)
            return run_id
        finally:
            self.spark.sparkContext.removeJobTag(self._tag)
            self._lock.release()

    # ---- stages

    def _in_turn(self, run_id: int) -> None:
        c, name, log = self.config, self.source.name, self.history.append
        if c.ingest and not self._stop.is_set():
            log(run_id, name, schemas.INGESTION_STARTED)
            n = self._ingest(run_id)
            if not self._stop.is_set():
                log(run_id, name, schemas.INGESTION_COMPLETED, {"count": n, "msg": "articles"})
        if c.process and not self._stop.is_set():
            log(run_id, name, schemas.PROCESSING_STARTED)
            n = self._wait(self._begun(self._process(True)))
            if not self._stop.is_set():
                log(run_id, name, schemas.PROCESSING_COMPLETED, {"count": n, "msg": "messages"})
        if c.store and not c.skip_store and not self._stop.is_set():
            log(run_id, name, schemas.STORING_STARTED)
            n = self._again() + self._wait(self._begun(self._storing(run_id, True)))
            if not self._stop.is_set():
                log(run_id, name, schemas.STORING_COMPLETED, {"count": n, "msg": "messages"})

    def _at_once(self, run_id: int) -> None:
        """All stages together: each ends once the one before has ended and it has nothing left to read."""
        c, name, log = self.config, self.source.name, self.history.append
        w = c.work_folder
        for folder, schema in (("raw", schemas.RAW_MESSAGE), ("processed", schemas.PROCESSED_MESSAGE)):
            self.spark.createDataFrame([], schema).write.mode("append").parquet(f"{w}/{folder}")
        counts: list[int] = []
        log(run_id, name, schemas.INGESTION_STARTED)
        first = self._begun(self._ingesting(run_id, counts))
        log(run_id, name, schemas.PROCESSING_STARTED)
        second = self._begun(self._process(False))
        third = None
        if c.store and not c.skip_store:
            log(run_id, name, schemas.STORING_STARTED)
            self._again()
            third = self._begun(self._storing(run_id, False))
        try:
            self._wait(first, lambda: True)
            if not self._stop.is_set():
                log(run_id, name, schemas.INGESTION_COMPLETED, {"count": sum(counts), "msg": "articles"})
            n = self._wait(second, lambda: True)
            if not self._stop.is_set():
                log(run_id, name, schemas.PROCESSING_COMPLETED, {"count": n, "msg": "messages"})
            if third is not None:
                n = self._wait(third, lambda: True)
                if not self._stop.is_set():
                    log(run_id, name, schemas.STORING_COMPLETED, {"count": n, "msg": "messages"})
        finally:
            for q in (first, second, third):
                if q is not None and q.isActive:
                    q.stop()
            self._active.clear()

    def _take(self, pages: DataFrame) -> int:
        """Articles of parsed pages that the store lacks, cleaned and cut, written to the first stage."""
        c = self.config
        fresh = pg.clean(st.stale(pg.articles(pages), st.complete(self.store.read())))
        return stages.write_raw(chunk_rows(fresh, c.max_tokens, c.overlap, tokenize=self.tokenize, detokenize=self.detokenize), f"{c.work_folder}/raw")

    def _ingesting(self, run_id: int, counts: list[int]):
        """The first stage as a stream; its progress is also noted in a table, per index file."""
        c, w = self.config, self.config.work_folder
        state = self.source.state_file(run_id)
        progress = ix.Progress(self.spark, f"{w}/progress")

        def take(batch: DataFrame, _: int) -> None:
            self.spark.sparkContext.addJobTag(self._tag)  # batches run in a thread of their own
            counts.append(self._take(self.source.parsed(batch)))
            with open(state) as f:
                lines = json.load(f)
            progress.save(run_id, self.spark.createDataFrame(list(lines.items()), "path string, lines long"))

        return stages.ingest_stream(self.source.stream(self.spark, state), take, f"{w}/checkpoint-ingest-{run_id}")

    def _ingest(self, run_id: int) -> int:
        """Articles written to the first stage. A source that is a stream goes on where it was; of another one all pages are looked at."""
        if not hasattr(self.source, "stream"):
            return self._take(self.source.pages(self.spark))
        counts: list[int] = []
        self._wait(self._begun(self._ingesting(run_id, counts)), lambda: True)
        return sum(counts)

    def _process(self, available: bool):
        w = self.config.work_folder
        return stages.process_stream(self.spark, f"{w}/raw", f"{w}/processed", f"{w}/checkpoint-process", self.embed, available=available)

    def _storing(self, run_id: int, available: bool):
        c, w = self.config, self.config.work_folder
        timer = stages.BatchTimer(self.history, run_id, self.source.name, c.average_interval)
        return stages.store_stream(self.spark, f"{w}/processed", self.store, f"{w}/checkpoint-store", c.dimension, available=available, on_batch=timer, quarantine=self.quarantine, embed=self.embed, index=self.index)

    def _again(self) -> int:
        """Messages in quarantine are tried once in a run, and with every batch."""
        return self.quarantine.retry(f"run-{uuid.uuid4().hex}", lambda rows: stages.judged(rows, self.config.dimension, self.embed), stages.accepting(self.store, self.index))

    # ---- search

    INDEX_KEYS = ("pid", "source", "chunk_index", "last_modified_date")
    #: Chunks from which on there is an index; fewer are searched whole.
    INDEXED = 10_000

    def index(self) -> VectorIndex | None:
        """The index, once there is one."""
        if self._index is None:
            self._index = VectorIndex.open(self.spark, f"{self.config.work_folder}/index")
        return self._index

    def build_index(self) -> None:
        """Trains the index on what is stored, if there is none and enough is stored. Later chunks join its lists as they are stored."""
        if self.index() is not None:
            return
        n = sum(r["rows"] for r in self.store.sizes())
        if n >= self.INDEXED:
            rows, c = self.store.read(), self.config
            lists, _ = sr.sized_lists(n, c.lists, c.probes)
            index = VectorIndex.train(rows, f"{c.work_folder}/index", list(self.INDEX_KEYS), lists, spill=c.spill, part=8)
            index.add(rows)
            self._index = index

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """name, content, chunk_index, similarity of the nearest chunks: through the index, or of all chunks while there is none."""
        vector = self.spark.createDataFrame([(query_text(query),)], "q string").select(self.embed(F.col("q"))).first()[0]
        index = self.index()
        if index is None:
            return sr.top_k(self.store.read(), vector, limit, ties=("pid", "source", "chunk_index")).select("name", "content", "chunk_index", "similarity")
        asked = self.spark.createDataFrame([(0, vector)], "query_id int, vector array<float>")
        stored: list[DataFrame] = []

        def valid(candidates: DataFrame) -> DataFrame:
            """Only what is stored now, in its version of now."""
            pids = [r[0] for r in candidates.select("pid").distinct().collect()]  # candidates of one query
            live = self.store.articles(pids)
            stored.append(live)
            a, b = candidates.alias("a"), live.select(*self.INDEX_KEYS).alias("b")
            return a.join(b, sr.all_equal("a", "b", self.INDEX_KEYS), "left_semi")

        probes = max(1, -(-index.lists * self.config.probes // self.config.lists))
        hits = index.search(asked, limit, probes, valid=valid)
        if not stored:
            return self.store.articles([]).select("name", "content", "chunk_index", F.lit(None).cast("double").alias("similarity"))
        a, b = hits.alias("a"), stored[0].alias("b")
        return a.join(b, sr.all_equal("a", "b", self.INDEX_KEYS)).orderBy("rank").select("b.name", "b.content", "b.chunk_index", "a.similarity")

    def search_answer(self, query: str, limit: int = 10) -> dict:
        """The search as its interface answers it: the query and a row for each result."""
        return {"query": query, "results": [r.asDict() for r in self.search(query, limit).collect()]}

    def retrieve_answer(self, title: str, source: str = "enwiki") -> list[dict]:
        """An article's chunks as the interface answers them."""
        return [r.asDict() for r in self.retrieve(title, source).collect()]

    def check_new_dumps(self, feeds: dict[str, tuple[str, str]], fetch: Fetch) -> dict[str, str | None]:
        """By wiki, the date of a dump that was new and is now in the content folder, or None; feeds are (content, index) by wiki."""
        refresh = DumpRefresh(self.history, self.config.content_folder, fetch)
        return {key: refresh.check(key, *urls) for key, urls in feeds.items()}

    def retrieve(self, title: str, source: str = "enwiki") -> DataFrame:
        return self.store.retrieve(title, source)

    def run_history(self) -> DataFrame:
        return hs.newest_first(self.history.read())
