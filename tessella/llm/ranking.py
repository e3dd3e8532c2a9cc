"""One ranking from several differently-scaled scores (problem 3).

Scores become percentiles (standings) among the scored items of their group and modality, so that ranges and
distributions do not count. Every item has one standing per modality; a missing or null score stands
last (0). Leximin: each item's own vector is sorted ascending and vectors are compared
lexicographically, the greatest first, so that a weak score cannot be masked by strong ones.
`order="average"` compares the mean standing first and uses the leximin vector for ties.

Ranks come from one sort of each (group, modality). Where one has more than `hot_rows` rows, its rows are counted by score
first, the distinct scores are divided at approximate quantiles into buckets, each bucket is summed up by itself and
shifted by the counts of the better buckets, and the ranks are joined back over salts. So no task holds an unbounded group, nor all
rows of one score, and the ranks are the same exact ones. Ties share their middle rank.

Defined results: NaN scores count as null; repeated rows of (group, modality, item) count once, with
the greatest score; rows with null group or item are dropped; an empty table gives no rows; remaining
ties in the ranking are broken by the item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.session import broadcast_if_small, salted_join

HOT_ROWS, BUCKETS = 100_000, 256


def _sorted_ranks(df: DataFrame, group: list[str], score: str, out: str) -> DataFrame:
    """`df` with the middle rank `out` and the size `__size` of the group: one shuffle and one sort."""
    by_score = W.partitionBy(*group).orderBy(F.col(score).desc())
    ties = F.count("*").over(by_score.rangeBetween(W.currentRow, W.currentRow))
    return df.withColumns({out: F.rank().over(by_score) + (ties - 1) / 2, "__size": F.count("*").over(W.partitionBy(*group))})


def _bucket_ranks(df: DataFrame, group: list[str], score: str, out: str, buckets: int) -> DataFrame:
    """The same for large groups: over the distinct scores of each group, in buckets."""
    counts = df.groupBy(*group, score).agg(F.count("*").alias("__ties"))
    cuts = counts.groupBy(*group).agg(F.percentile_approx(score, [i / buckets for i in range(1, buckets)], 10 * buckets).alias("__cuts"))
    placed = counts.join(broadcast_if_small(cuts), group).withColumn("__bucket", F.size(F.filter("__cuts", lambda c: c >= F.col(score)))).drop("__cuts")
    better = lambda w: F.coalesce(F.sum("__ties").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = placed.withColumn("__inside", better(W.partitionBy(*group, "__bucket").orderBy(F.col(score).desc())))
    totals = placed.groupBy(*group, "__bucket").agg(F.sum("__ties").alias("__ties"))  # at most `buckets` rows a group
    before = totals.select(*group, "__bucket", better(W.partitionBy(*group).orderBy("__bucket")).alias("__before"), F.sum("__ties").over(W.partitionBy(*group)).alias("__size"))
    ranks = inside.join(broadcast_if_small(before), [*group, "__bucket"])
    ranks = ranks.select(*group, score, (F.col("__before") + F.col("__inside") + (F.col("__ties") + 1) / 2).alias(out), "__size")
    return salted_join(df, ranks, [*group, score], F.col("__i"))


def split_rank(df: DataFrame, group: list[str], score: str, out: str, sizes: DataFrame, hot_rows: int = HOT_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """`df` (with an item column `__i`) with `out`, the middle rank (1 is best) of the non-null `score`, descending, within `group`, and
    `__size`, the rows of the group. sizes: (group, n), at least the rows of each group."""
    hot = sizes.filter(F.col("n") > hot_rows).select(*group)
    if hot.isEmpty():
        return _sorted_ranks(df, group, score, out)
    hot = broadcast_if_small(hot)  # at most rows / hot_rows groups
    large = df.join(hot, group, "left_semi").select(df.columns)
    return _sorted_ranks(df.join(hot, group, "left_anti").select(df.columns), group, score, out).unionByName(_bucket_ranks(large, group, score, out, buckets).select(*df.columns, out, "__size"))


def standings(df: DataFrame, group: str, item: str, modality: str, score: str, modalities: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per (group, item): a standing in [0, 1) per modality `s_<modality>`, their mean, and the ascending vector."""
    kept = df.filter(F.col(modality).isin(modalities) & F.col(group).isNotNull() & F.col(item).isNotNull())
    rows = kept.select(F.col(group).alias("__g"), F.col(item).alias("__i"), F.col(modality).alias("__m"), F.when(~F.isnan(score), F.col(score)).alias("__s"))
    one = rows.groupBy("__g", "__i", "__m").agg(F.max("__s").alias("__s"))
    sizes = rows.groupBy("__g", "__m").agg(F.count("__s").alias("n"))  # with repeats, so at least the rows to rank
    ranked = split_rank(one.filter(F.col("__s").isNotNull()), ["__g", "__m"], "__s", "__r", sizes, hot_rows)
    standing = ranked.select("__g", "__i", "__m", (1 - (F.col("__r") - 0.5) / F.col("__size")).alias("__s"))
    # items without any score stand last everywhere; a null standing keeps them
    unscored = one.filter(F.col("__s").isNull()).select("__g", "__i", "__m", "__s")
    wide = standing.unionByName(unscored).groupBy("__g", "__i").agg(*(F.max(F.when(F.col("__m") == m, F.col("__s"))).alias(f"r{k}") for k, m in enumerate(modalities)))
    stand = [F.coalesce(f"r{k}", F.lit(0.0)) for k in range(len(modalities))]
    mean = reduce(Column.__add__, stand) / len(modalities)
    return wide.select(
        F.col("__g").alias(group), F.col("__i").alias(item),
        *(s.alias(f"s_{m}") for s, m in zip(stand, modalities)),
        mean.alias("mean_standing"), F.array_sort(F.array(*stand)).alias("leximin"),
    )


def rank_candidates(df: DataFrame, group: str, item: str, modality: str, score: str, modalities: list[str], top: int, order: str = "leximin", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The first `top` items of each group with their position (1-based), standings and vector.

    The cut to `top` happens in every task before the shuffle (WindowGroupLimit), so a hot group is safe.
    """
    s = standings(df, group, item, modality, score, modalities, hot_rows)
    vector = [F.round(F.col("leximin")[k], 9).desc() for k in range(len(modalities))]
    first = [F.round("mean_standing", 9).desc()] if order == "average" else []
    w = W.partitionBy(group).orderBy(*first, *vector, F.col(item))
    return s.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= top)
