"""The corpus pipeline: documents through five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loreweave.llm import common, jaccard_join, mixing, packing, substrings, toxicity

#: Near-duplicate documents: sets of five-word shingles that are 80 % alike.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; its labels are those of the table.

    Null and empty texts, and all texts where nothing tells toxic ones apart, are not rejected. Repeated rows share their fate.
    """
    model = toxicity.fit(docs, common.read_table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).filter("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest doc_id stays, of equal ids one row.

    Rows are told apart by a number of their own, so rows with a null or repeated doc_id are compared by their texts
    like any others; a null doc_id comes last. Rows without words are in no group and stay.
    """
    ws = common.Workspace(spark)
    rows = ws.write(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    linked = jaccard_join.link_documents(rows.select(F.col("_row").alias("doc_id"), "text"), NEAR_WORDS, NEAR_PERCENT)
    groups = linked.select(F.col("doc_id").alias("_row"), "component_id").join(rows.select("_row", "doc_id"), "_row")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("m")).select(F.col("m._row").alias("_row"))
    return rows.join(first, "_row", "left_semi").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside repeated windows go; so do documents that had words and have none left.

    A text of which nothing goes stays as it is, also a null or blank one. Equal texts repeat each other, so both lose their windows.
    """
    kept = substrings.remove_repeats(docs).filter("n_removed < n_words or n_words = 0")
    return kept.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))).withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts hold what the mix takes of them; documents of which it takes nothing go, and with them null and blank texts."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document in a sequence of at most 1024. A null text is empty and has its end token; repeated rows are packed each for itself."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("substrings", drop_repeated_passages), ("mixing", mix), ("packing", pack)]
#: Learning and tokenizing have no SQL form; tests/llm holds all stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and read again, and the one before it goes. An empty table passes through."""
    ws = common.Workspace(spark)  # the last table goes when the driver program ends
    docs = common.read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.write(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            ws.drop(f"stage-{k - 1}")
    return docs
