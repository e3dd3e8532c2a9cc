"""Dense and sparse indexes as plain tables, with one logical sub-index per `index_dir`.

The sparse index is three tables: tokens of each row (whose postings are made for the terms that are asked), term statistics
and index statistics; the dense one is a column of unit vectors. Row numbers are explicit columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.functions import vector as vec
from tessella.session import broadcast_if_small, cut, kept

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Rows of a sub-index that one group of a search holds; larger sub-indexes are searched in parts.
PART_ROWS = 8192


def tokenized(rows: DataFrame, index: str, rid: str, text: str, *more: str) -> DataFrame:
    """(idx, rid, tokens, dl): texts as tokens, which the statistics, document frequencies and postings are made from."""
    tokens = rows.select(F.col(index).alias("idx"), F.col(rid).alias("rid"), tx.bm25_tokens(text).alias("tokens"), *more)
    return tokens.withColumn("dl", F.size("tokens"))


def postings(tokens: DataFrame) -> DataFrame:
    """(idx, rid, term, tf, dl) of every row with tokens; a row's counts are combined in its task."""
    each = tokens.select("idx", "rid", "dl", F.explode("tokens").alias("term"))
    return each.groupBy("idx", "rid", "dl", "term").agg(F.count("*").alias("tf")).select("idx", "rid", "term", "tf", "dl")


def index_stats(tokens: DataFrame, *more: str) -> DataFrame:
    """(idx, n, avgdl): rows (with or without tokens) and their mean number of tokens."""
    return tokens.groupBy("idx", *more).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def frequencies(tokens: DataFrame) -> DataFrame:
    """(idx, term, df, length): the rows that have the term, without making postings: each row's distinct tokens are combined before
    the shuffle. Where term is null, all rows of the sub-index (with or without tokens) and their tokens."""
    each = tokens.select("idx", "dl", F.explode(F.array_append(F.array_distinct("tokens"), F.lit(None).cast("string"))).alias("term"))
    return each.groupBy("idx", "term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("length"))


def term_stats(df: DataFrame, stats: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """(idx, term, df, idf): ln(n - df + 0.5) - ln(df + 0.5), negative ones raised to epsilon times the mean over the index's terms.

    df and stats are materialised tables."""
    raw = df.join(broadcast_if_small(stats.select("idx", "n"), True), "idx").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("idx").agg(F.avg("raw").alias("mean"))
    return raw.join(broadcast_if_small(mean), "idx").select("idx", "term", "df", F.when(F.col("raw") < 0, F.col("mean") * epsilon).otherwise(F.col("raw")).alias("idf"))


def terms_of_whole(tokens: DataFrame, *more: str, epsilon: float = EPSILON) -> DataFrame:
    """The same as `term_stats`, of rows (idx, tokens) of which each sub-index is whole and in one piece in a task; with the columns
    `more`, which are the same for all rows of a sub-index. Null is no sub-index here."""
    kinds = {f.name: f.dataType.simpleString() for f in tokens.schema}

    def count(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        idx, tokens = table.column("idx").combine_chunks(), table.column("tokens").combine_chunks()
        first = np.flatnonzero(np.r_[True, pc.not_equal(idx.slice(1), idx.slice(0, len(idx) - 1)).to_numpy(zero_copy_only=False)])
        n = np.diff(np.r_[first, len(idx)])
        coded = tokens.flatten().dictionary_encode()
        words = len(coded.dictionary)
        if not words:
            return
        row = np.repeat(np.arange(len(idx)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
        place = np.sort(row * words + coded.indices.to_numpy())
        place = place[np.r_[True, place[1:] != place[:-1]]]  # each row's distinct tokens
        own = np.sort(np.repeat(np.arange(len(first)), n)[place // words] * words + place % words)
        at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        df, index, term = np.diff(np.r_[at, len(own)]), own[at] // words, own[at] % words
        raw = np.log(n[index] - df + 0.5) - np.log(df + 0.5)
        mean = np.bincount(index, raw, len(first)) / np.maximum(1, np.bincount(index, minlength=len(first)))
        idf = np.where(raw < 0, mean[index] * epsilon, raw)
        for lo in range(0, len(df), 100_000):
            a = slice(lo, lo + 100_000)
            named = [table.column(c).combine_chunks().take(first[index[a]]) for c in more]
            yield pa.RecordBatch.from_arrays([idx.take(first[index[a]]), coded.dictionary.take(term[a]), pa.array(df[a]), pa.array(idf[a]), *named], names=["idx", "term", "df", "idf", *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in (b.slice(lo, 2000) for b in batches for lo in range(0, b.num_rows, 2000)):
            idx = batch.column("idx")
            new = 1 + np.flatnonzero(pc.not_equal(idx.slice(1), idx.slice(0, len(idx) - 1)).to_numpy(zero_copy_only=False))
            last = int(new[-1]) if len(new) else 0  # the sub-index of the last rows may go on
            if held and (last or held[-1].column("idx")[-1] != idx[0]):
                if last:
                    held.append(batch.slice(0, last))
                yield from count(held)
                held = []
            elif last:
                yield from count([batch.slice(0, last)])
            held.append(batch.slice(last))
        if held:
            yield from count(held)

    rows = tokens.filter("idx IS NOT NULL").select("idx", "tokens", *more)
    return rows.mapInArrow(run, ", ".join([f"idx {kinds['idx']}, term string, df bigint, idf double", *(f"{c} {kinds[c]}" for c in more)]))


@dataclass
class SparseIndex:
    """The sparse index: tokens (idx, rid, tokens, dl), terms (idx, term, df, idf), stats (idx, n, avgdl)."""

    tokens: DataFrame
    terms: DataFrame
    stats: DataFrame

    @classmethod
    def build(cls, rows: DataFrame, index: str, rid: str, text: str) -> SparseIndex:
        """Texts are tokenised once for all statistics, which are kept in the shared folder, and again by what reads `tokens`:
        kept tokens would take several times the disk of the texts."""
        tokens = tokenized(rows, index, rid, text)
        counts = kept(frequencies(tokens), "terms")
        stats = cut(counts.filter("term IS NULL").select("idx", F.col("df").alias("n"), (F.col("length") / F.col("df")).alias("avgdl")))
        return cls(tokens, term_stats(counts.filter("term IS NOT NULL").select("idx", "term", "df"), stats), stats)

    def write(self, path: str, facts: DataFrame) -> None:
        """Three folders, partitioned by kind and year (of `facts`: idx, doc_type, year), so that routing prunes folders."""
        facts = broadcast_if_small(facts)
        for name in ("tokens", "terms", "stats"):
            write_index(getattr(self, name).join(facts, "idx", "left"), f"{path}/{name}")

    @classmethod
    def store(cls, rows: DataFrame, index: str, rid: str, text: str, facts: DataFrame, path: str) -> None:
        """What `build` and `write` would write, made from texts in the order of kind, year and sub-index: a sub-index is whole in a
        task, so that texts are all that is shuffled, neither tokens nor terms. An index with a sub-index that is
        too large for this is built and written."""
        texts = rows.select(F.col(index).alias("idx"), F.col(rid).alias("rid"), F.col(text).alias("text"))
        size = texts.groupBy("idx").count().agg(F.max("count").alias("most")).first()
        if (size.most or 0) > PART_ROWS:
            return cls.build(rows, index, rid, text).write(path, facts)
        place = ["doc_type", "year", "idx"]
        ordered = texts.join(broadcast_if_small(facts), "idx", "left").repartitionByRange(*place)
        write_parts(tokenized(ordered.sortWithinPartitions(*place, "rid"), "idx", "rid", "text", "doc_type", "year"), f"{path}/tokens")
        tokens = rows.sparkSession.read.parquet(f"{path}/tokens")
        write_index(index_stats(tokens, "doc_type", "year"), f"{path}/stats")
        whole = tokenized(ordered.sortWithinPartitions(*place), "idx", "rid", "text", "doc_type", "year")
        write_parts(terms_of_whole(whole, "doc_type", "year"), f"{path}/terms")

    @classmethod
    def read(cls, spark: SparkSession, path: str, routed: Column | None = None) -> SparseIndex:
        """The stored index, or of it the folders of some kinds and years: a condition over doc_type and year."""
        read = [spark.read.parquet(f"{path}/{name}") for name in ("tokens", "terms", "stats")]
        return cls(*((t if routed is None else t.filter(routed)).drop("doc_type", "year") for t in read))


def dense_index(rows: DataFrame, embedding: str) -> DataFrame:
    """`rows` with unit vectors in `unit`."""
    return rows.withColumn("unit", vec.l2_normalize(embedding))


def pending(rows: DataFrame, done: list[DataFrame], key: str) -> DataFrame:
    """Rows whose key is not in every table of finished keys (a file is done when all its indexes are)."""
    finished = None
    for d in done:
        keys = d.select(key).distinct()
        finished = keys if finished is None else finished.join(keys, key, "left_semi")
    return rows if finished is None else rows.join(finished, key, "left_anti")


def resume(rows: DataFrame, earlier: DataFrame, key: list[str], old: str, new: str, out: str) -> DataFrame:
    """`rows` with `out`: the earlier value at the same key unless it is blank, else the new one."""
    return rows.join(earlier.select(*key, F.col(old).alias("__old")), key, "left").withColumn(out, F.coalesce(tx.non_blank("__old"), F.col(new))).drop("__old")


def write_index(df: DataFrame, path: str) -> None:
    """An index table, partitioned by kind and year so that routing prunes folders; the kinds and years written replace those that were there."""
    # adaptive execution gathers a small kind and year into one file and splits a large one
    write_parts(df.hint("rebalance", "doc_type", "year"), path)


def write_parts(df: DataFrame, path: str) -> None:
    """As `write_index`, of rows whose tasks hold few kinds and years each."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("doc_type", "year").parquet(path)
