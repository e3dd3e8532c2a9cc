"""Incremental ingest as a stream: new OCR units are chunked as they arrive.

Under `out` lie the units, partitioned by batch and by a bucket of the document, and the chunks, partitioned by batch. A document whose units
arrive in several batches is chunked again from all of them; `current` gives the chunks of each document's latest batch.
A batch writes only its own partitions, over what an earlier try of it left, so that a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators import chunking
from tessella.session import cut

#: Folders of a batch's units; a batch reads only the buckets that its documents lie in.
BUCKETS = 64
KEY = ["doc_id", "unit_no"]


def unit_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New parquet files of OCR units under a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists; a folder that cannot be read is an error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of every document, as its latest batch made them."""
    chunks = spark.read.parquet(f"{out}/chunks")
    latest = chunks.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return chunks.join(latest, ["doc_id", "batch"], "left_semi").drop("batch")


def ingest(stream: DataFrame, out: str, checkpoint: str, mode: str = "rows", after: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Chunks of every document with new units in `out`. Units that are there already are repeats and change nothing."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
        rows = chunking.latest_by_key(batch, KEY, "loaded_at").withColumn("bucket", bucket)
        if exists(spark, f"{out}/units"):
            named = rows.select("bucket", "doc_id").distinct()
            before = spark.read.parquet(f"{out}/units").filter(F.col("batch") < number).join(named, ["bucket", "doc_id"], "left_semi").select(rows.columns)
            rows = rows.join(before.select("bucket", *KEY), ["bucket", *KEY], "left_anti").select(rows.columns)
            rows = cut(rows)
            every = rows.unionByName(before.join(rows.select("bucket", "doc_id").distinct(), ["bucket", "doc_id"], "left_semi").select(rows.columns))
        else:
            every = rows = cut(rows)
        chunks = chunking.assemble(every.drop("bucket"), mode)
        for name, df, parts in (("chunks", after(chunks) if after else chunks, ["batch"]), ("units", rows, ["batch", "bucket"])):
            made = df.withColumn("batch", F.lit(number).cast("long"))
            made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{out}/{name}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
