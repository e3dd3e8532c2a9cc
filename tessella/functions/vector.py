"""Vectors and scores as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions.text import col


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column | str) -> Column:
    """v / (|v| + 1e-12)"""
    n = norm(a)
    return F.transform(col(a), lambda x: x.cast("double") / (n + F.lit(1e-12)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine with zero lengths read as 1e-10."""
    na, nb = (F.when(norm(x) == 0, F.lit(1e-10)).otherwise(norm(x)) for x in (a, b))
    return dot(a, b) / (na * nb)


def minmax(score: Column | str, lo: Column, hi: Column, strict: bool) -> Column:
    """strict: 0 for all if the range is below 1e-12; else divide by the range + 1e-12."""
    s = col(score)
    return F.when(hi - lo < F.lit(1e-12), F.lit(0.0)).otherwise((s - lo) / (hi - lo)) if strict else (s - lo) / (hi - lo + F.lit(1e-12))


def with_minmax(df: DataFrame, keys: list[str], score: str, out: str, strict: bool) -> DataFrame:
    """`out`: the score scaled within the keys. Extremes come from an aggregation (combined before the shuffle) that is joined
    back, so a hot key is never gathered by a window; the joined side has one row per key."""
    ends = df.groupBy(*keys).agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    return df.join(ends, keys).withColumn(out, minmax(score, F.col("__lo"), F.col("__hi"), strict)).drop("__lo", "__hi")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str) -> DataFrame:
    """The first k rows of each key with their rank; Spark cuts to k in every task before it shuffles."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= k)
