"""Session helpers: table access, lineage cuts and joins that stay safe on hot keys."""

from __future__ import annotations

import os
import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows of one key from which on it is worked on in parts.
HOT_ROWS = 100_000
#: Rows and bytes up to which a side may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a directory that holds one parquet file (or folder) per table."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir; only where none is set (local tests) use a local one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tessella-checkpoint-")
    sc.setCheckpointDir(shared)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written tables in the folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder in columns, which takes a small part of a checkpoint's disk."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, ready: bool = False, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df`, with a broadcast hint only if it has at most `most` rows and `most_bytes` bytes (as JSON).

    A frame that is not `ready` (materialised already) is kept in the shared folder, so that measuring computes nothing twice."""
    kept = df if ready else cut(df)
    size = F.sum(F.octet_length(F.to_json(F.struct(*kept.columns))))
    n = kept.limit(most + 1).agg(F.count("*").alias("rows"), size.alias("bytes")).first()
    return F.broadcast(kept) if n.rows <= most and (n.bytes or 0) <= most_bytes else kept


def once_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once (of repeated rows any one). Only keys are shuffled: rows of keys that come once stay where they are, those of
    the others go through an aggregation that combines before its shuffle. Rows with a null key are all kept."""
    again = broadcast_if_small(df.groupBy(*keys).count().filter("count > 1").select(*keys))
    return df.join(again, keys, "left_anti").select(df.columns).unionByName(df.join(again, keys, "left_semi").select(df.columns).dropDuplicates(keys))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], by: Column, salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join whose left side may have hot keys: `right` (one row per key) is repeated `salts` times,
    the left rows of a key are spread over the salts by the hash of `by`. No row is lost or repeated."""
    lhs = left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    rhs = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return lhs.join(rhs, [*keys, "__salt"], how).drop("__salt")


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where its files give less than half as many tasks, for work that costs much more than a shuffle.

    df: read, filtered and united only (asking for the partitions of a frame with a shuffle would run it)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame | None:
    """The keys with more than `hot_rows` rows (at most rows / hot_rows), or None if there are none."""
    hot = cut(df.groupBy(*keys).count().filter(F.col("count") > hot_rows).select(*keys))
    return None if hot.isEmpty() else broadcast_if_small(hot, True)


def _in_parts(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """`df` sorted over range partitions by keys and order, with the partition's number `__part`; kept in the shared folder."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *keys, *order).withColumn("__part", F.spark_partition_id()))


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """`df` with its 1-based row number within the keys. Keys with more than `hot_rows` rows are numbered over range
    partitions, each shifted by the rows of the key before it, so that no task sorts a whole hot key; the numbers are the same."""
    number = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        return df.withColumn(out, number)
    cool = df.join(hot, keys, "left_anti").select(df.columns).withColumn(out, number)
    parts = _in_parts(df.join(hot, keys, "left_semi").select(df.columns), keys, order)
    before = F.sum("count").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    shift = parts.groupBy(*keys, "__part").count().select(*keys, "__part", F.coalesce(before, F.lit(0)).alias("__shift"))
    placed = parts.withColumn(out, F.row_number().over(W.partitionBy(*keys, "__part").orderBy(*order))).join(shift, [*keys, "__part"])
    return cool.unionByName(placed.withColumn(out, (F.col(out) + F.col("__shift")).cast("int")).select(*df.columns, out))


def lagged(df: DataFrame, keys: list[str], order: str, value: str, out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """`df` with the `value` of the row before within the keys; hot keys go by range partitions as in `row_numbers`."""
    before = F.lag(value)
    hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        return df.withColumn(out, before.over(W.partitionBy(*keys).orderBy(order)))
    cool = df.join(hot, keys, "left_anti").select(df.columns).withColumn(out, before.over(W.partitionBy(*keys).orderBy(order)))
    parts = _in_parts(df.join(hot, keys, "left_semi").select(df.columns), keys, [F.col(order)])
    ends = parts.groupBy(*keys, "__part").agg(F.max_by(value, order).alias("__last"))  # one row for each part of a key
    carried = ends.select(*keys, "__part", F.lag("__last").over(W.partitionBy(*keys).orderBy("__part")).alias("__carry"))
    w = W.partitionBy(*keys, "__part").orderBy(order)
    inside = parts.withColumns({out: before.over(w), "__first": F.row_number().over(w) == 1})
    joined = inside.join(carried, [*keys, "__part"]).withColumn(out, F.when(F.col("__first"), F.col("__carry")).otherwise(F.col(out)))
    return cool.unionByName(joined.select(*df.columns, out))
