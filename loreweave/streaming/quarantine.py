"""Messages that fail go aside and are tried again; the rest of their batch goes on.

The ledger is an append-only table with a row for each try of such a message. A message that has failed in `attempts` batches is
a dead letter. A batch that is replayed counts once, as tries are told apart by their batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..shared import exists, remove, scratch

FAILED, DONE = "failed", "done"


class Quarantine:
    LEDGER = "message_id string, batch string, status string, error string, message string, tried_at timestamp"

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, attempts: int = 3):
        self.spark, self.folder, self.schema, self.attempts = spark, folder, schema, attempts

    def ledger(self) -> DataFrame:
        """Every try of every message that has failed at some time."""
        if not exists(self.spark, self.folder):
            return self.spark.createDataFrame([], self.LEDGER)
        return self.spark.read.schema(self.LEDGER).parquet(self.folder)

    def _standing(self) -> DataFrame:
        """A row for each message that still fails."""
        tries = self.ledger().groupBy("message_id").agg(F.max(F.col("status") == DONE).alias("done"), F.count_distinct("batch").alias("failures"), F.max_by("error", "tried_at").alias("error"), F.max_by("batch", "tried_at").alias("batch"), F.any_value("message").alias("message"))
        return tries.filter("not done").drop("done")

    def _messages(self, standing: DataFrame) -> DataFrame:
        return standing.withColumn("_m", F.from_json("message", self.schema)).select("_m.*", *standing.columns)

    def waiting(self) -> DataFrame:
        """Messages that will be tried again, with message_id, failures, error and batch."""
        return self._messages(self._standing().filter(F.col("failures") < self.attempts))

    def dead_letters(self) -> DataFrame:
        """Messages that have failed too often, likewise."""
        return self._messages(self._standing().filter(F.col("failures") >= self.attempts))

    def run(self, batch: DataFrame, batch_id: str, judge: Callable[[DataFrame], DataFrame], accept: Callable[[DataFrame], None]) -> int:
        """Judges a batch together with the messages that wait, gives the good rows to accept and notes the others; returns the number of good rows.

        judge keeps all rows, may add columns, and adds `error` (null: good). accept gets them with `again`, whether they have
        waited, and has to bear rows that it has had before: it comes before the ledger, so nothing is lost in between.
        """
        names = [f.name for f in self.schema.fields]
        new = batch.select(names).withColumn("_text", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))
        new = new.withColumn("_id", F.sha2(F.col("_text").cast("binary"), 256)).withColumn("_again", F.lit(False))
        if exists(self.spark, self.folder):
            again = self.waiting().filter(F.col("batch") != batch_id)
            new = new.unionByName(again.select(*names, F.col("message").alias("_text"), F.col("message_id").alias("_id"), F.lit(True).alias("_again")))
        path = scratch(self.spark, "judged")
        judge(new).write.parquet(path)  # what is costly to judge is judged once
        judged = self.spark.read.parquet(path)
        counts = judged.agg(F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("error").isNotNull() | F.col("_again")).alias("noted")).first()
        if counts["good"]:
            accept(judged.filter("error is null").withColumnRenamed("_again", "again").drop("error", "_text", "_id"))
        if counts["noted"]:
            notes = judged.filter(F.col("error").isNotNull() | F.col("_again")).select(F.col("_id").alias("message_id"), F.lit(batch_id).alias("batch"), F.when(F.col("error").isNull(), DONE).otherwise(FAILED).alias("status"), "error", F.col("_text").alias("message"), F.current_timestamp().alias("tried_at"))
            notes.dropDuplicates(["message_id"]).write.mode("append").parquet(self.folder)
        remove(self.spark, path)
        return int(counts["good"])

    def retry(self, batch_id: str, judge: Callable[[DataFrame], DataFrame], accept: Callable[[DataFrame], None]) -> int:
        """Tries the messages that wait, without a new batch."""
        if not exists(self.spark, self.folder):
            return 0
        return self.run(self.spark.createDataFrame([], self.schema), batch_id, judge, accept)
