"""Chunks of articles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import chunks, joined, tokens


def chunk_rows(df: DataFrame, size: int, overlap: int = 10, text: str = "content", tokenize: Callable[[Column], Column] = tokens, detokenize: Callable[[Column], Column] = joined) -> DataFrame:
    """A row per chunk with chunk_index (from 1) and chunk_count; the text column holds the chunk."""
    cut = df.withColumn("_chunks", chunks(F.col(text), size, overlap, tokenize, detokenize)).withColumn("chunk_count", F.size("_chunks"))
    out = cut.select("*", F.posexplode("_chunks").alias("_pos", "_chunk"))
    return out.withColumn(text, F.col("_chunk")).withColumn("chunk_index", F.col("_pos") + 1).drop("_chunks", "_pos", "_chunk")
