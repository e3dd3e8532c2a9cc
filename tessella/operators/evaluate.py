"""Scores of chunking strategies and of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import vector as vec
from tessella.session import lagged


def adjacent_distance(rows: DataFrame, group: str, order: str, embedding: str) -> DataFrame:
    """(group, segments, score): the mean of 1 - cosine of neighbours; 0 with fewer than two segments."""
    pair = lagged(rows.select(group, order, embedding), [group], order, embedding, "__before")
    return pair.groupBy(group).agg(F.count("*").alias("segments"), F.coalesce(F.avg(F.when(F.col("__before").isNotNull(), 1 - vec.cosine("__before", embedding))), F.lit(0.0)).alias("score"))


def weighted_report(report: DataFrame) -> DataFrame:
    """(strategy, score, time, chunks, files) from (strategy, chunk_count, score, time_sec): scores weigh by chunks, 0 without any."""
    n = F.col("chunk_count")
    return report.groupBy("strategy").agg(
        F.coalesce(F.try_divide(F.sum(F.col("score") * n), F.sum(n).cast("double")), F.lit(0.0)).alias("avg_score"), F.avg("time_sec").alias("avg_time"), F.sum(n).alias("total_chunks"), F.count("*").alias("files")
    )


def chunk_stats(chunks: DataFrame, keys: list[str], content: str) -> DataFrame:
    """(keys, chunk_count, avg_chunk_len)"""
    return chunks.groupBy(*keys).agg(F.count("*").alias("chunk_count"), F.avg(F.length(content)).alias("avg_chunk_len"))


def table_counts(units: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, tables, texts): units that are tables, and those with a text that is not blank."""
    text = F.trim(F.regexp_replace(F.coalesce("table_text", F.lit("")), r"(?U)\s+", " ")) != ""
    return units.groupBy(doc).agg(F.count_if(F.col("type") == "table").alias("tables"), F.count_if((F.col("type") == "table") & text).alias("texts"))
