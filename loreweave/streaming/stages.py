"""The three stages as streams over stage folders: articles in, chunks with vectors, store. They may run one after the other or at once."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions.vectors import encode_vector, try_decode_vector
from ..operators import store as st
from ..operators.history import RunHistory
from ..operators.vector_index import VectorIndex
from ..sources.page_stream import PageStreamSource
from .quarantine import Quarantine

log = logging.getLogger(__name__)


def _started(writer, available: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if available else writer.trigger(processingTime="0.5 seconds")).start()


def write_raw(chunks: DataFrame, folder: str) -> int:
    """Stage 1: appends chunk messages to the stage folder; returns the number of articles, counted by their first chunks on the way."""
    seen = Observation()
    rows = chunks.select([F.col(f.name).cast(f.dataType) if f.name in chunks.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.RAW_MESSAGE.fields])
    rows.observe(seen, F.count_if(F.col("chunk_index") == 1).alias("articles")).write.mode("append").parquet(folder)
    return int(seen.get["articles"])


def page_stream(spark: SparkSession, folder: str, state: str, lines: int) -> DataFrame:
    """path, start, end, page, error of all dumps of a folder as a stream, so many index lines of each in a batch."""
    spark.dataSource.register(PageStreamSource)
    return spark.readStream.format("multistream_pages").option("folder", folder).option("state", state).option("lines", str(lines)).load()


def ingest_stream(pages: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Stage 1 as a stream: each batch of raw pages goes to `take`. A batch that was not committed comes again."""
    return _started(pages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint), False)


def process_stream(spark: SparkSession, raw: str, processed: str, checkpoint: str, embed: Callable, files: int = 64, available: bool = True) -> StreamingQuery:
    """Stage 2: embeds each new message once; the checkpoint holds what is done. A text that the model fails on goes on without a vector."""
    stream = spark.readStream.schema(schemas.RAW_MESSAGE).option("maxFilesPerTrigger", files).parquet(raw)
    out = stream.withColumn("embeddings", encode_vector(embed(F.col("content"))))
    return _started(out.writeStream.format("parquet").option("path", processed).option("checkpointLocation", checkpoint), available)


def judged(rows: DataFrame, dimension: int, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Messages with `embedding` and `error`: no vector, one that cannot be decoded or of another dimension, no pid. A message without a vector is embedded here if it can be."""
    decoded = rows.withColumn("_d", try_decode_vector("embeddings"))
    vector = F.col("_d.vector")
    if embed is not None:
        vector = F.coalesce(vector, embed(F.when(F.col("embeddings.kind").isNull(), F.col("content"))))
    checked = decoded.withColumn("embedding", vector)
    error = F.when(F.col("pid").isNull() | F.col("chunk_index").isNull(), F.lit("no pid or chunk_index")).when(F.col("_d.error").isNotNull(), F.col("_d.error")).when(F.col("embedding").isNull(), F.lit("no vector"))
    error = error.when(F.size("embedding") != dimension, F.concat(F.lit("a vector of "), F.size("embedding").cast("string"), F.lit(f" components, not {dimension}")))
    return checked.withColumn("error", error).drop("_d")


def accepting(store: st.ChunkStore, index: Callable[[], VectorIndex | None] | None = None) -> Callable[[DataFrame], None]:
    """What takes good rows into the store and the index. Rows that have waited may have been overtaken by a newer version."""

    def accept(rows: DataFrame) -> None:
        good = rows.filter("not again").select(*st.COLUMNS)
        late = rows.filter("again").select(*st.COLUMNS)
        if not late.isEmpty():
            good = good.unionByName(store.without_older(late))
        store.append(good)
        if index is not None and (found := index()) is not None:
            found.add(good)

    return accept


def store_stream(spark: SparkSession, processed: str, store: st.ChunkStore, checkpoint: str, dimension: int, files: int = 64, available: bool = True, on_batch: Callable[[int, float], None] | None = None, quarantine: Quarantine | None = None, embed: Callable[[Column], Column] | None = None, index: Callable[[], VectorIndex | None] | None = None) -> StreamingQuery:
    """Stage 3: adds each micro-batch to the store and to the index; a batch that is replayed changes nothing.

    An article's chunks may come in several batches and are seen once all are there. Messages that cannot be stored go to the
    quarantine, the others of their batch on; without a quarantine such a message is an error.
    """

    accept = accepting(store, index)

    def put(batch: DataFrame, number: int) -> None:
        began = time.perf_counter()
        if quarantine is not None:
            n = quarantine.run(batch, f"batch-{number}", lambda rows: judged(rows, dimension, embed), accept)
        else:
            rows = judged(batch, dimension, embed).withColumn("again", F.lit(False)).persist()
            bad = rows.filter("error is not null").select("error").first()
            if bad is not None:
                rows.unpersist()
                raise ValueError(bad[0])
            n = rows.count()
            accept(rows)
            rows.unpersist()
        if on_batch:
            on_batch(n, time.perf_counter() - began)

    stream = spark.readStream.schema(schemas.PROCESSED_MESSAGE).option("maxFilesPerTrigger", files).parquet(processed)
    return _started(stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint), available)


class BatchTimer:
    """Writes the mean seconds of each `interval` batches to the history, under the run's own id, and logs each batch's seconds a text."""

    def __init__(self, history: RunHistory, run_id: int, service: str, interval: int):
        self.history, self.run_id, self.service, self.interval, self.seen = history, run_id, service, interval, []

    def __call__(self, rows: int, seconds: float) -> None:
        log.debug("%s: a batch of %d texts took %.6f s, %.6f s a text", self.service, rows, seconds, seconds / max(rows, 1))
        self.seen.append(seconds)
        if len(self.seen) == self.interval:
            self.history.append(self.run_id, self.service, schemas.BATCH_AVERAGE_TIME, {"average_time_per_processing_batch": sum(self.seen) / self.interval})
            self.seen = []
