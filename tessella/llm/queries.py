"""Queries of the training-data problems."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import leakage, markup, packing, ranking, reading, sitelines, splitting
from tessella.session import cut, once_each, spread, table

MODALITIES = ["faiss", "bm25", "rerank"]
#: The vocabulary that the queries count tokens with; TESSELLA_TOKENIZER names another one.
TOKENIZER = os.environ.get("TESSELLA_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _marked(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "content_list").filter("table_body IS NOT NULL").select(F.lit("content_list").alias("src"), F.col("unit_id").alias("item_id"), F.col("table_body").alias("body"))
    index = table(spark, d, "meta").select(F.lit("meta").alias("src"), F.col("id").alias("item_id"), F.col("raw_content").alias("body"))
    return spread(units.unionByName(index))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    clean = markup.clean_markup(_marked(spark, d), ["src", "item_id"], "body", only_marked=True)
    return clean.select("src", "item_id", F.explode("syntaxes").alias("syntax")).distinct()


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_markup(once_each(_marked(spark, d), ["src", "item_id"]), ["src", "item_id"], "body")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_candidates(table(spark, d, "hits"), "query_id", "id", "modal", "score_raw", MODALITIES, 5, "average").select("query_id", "id")


def p3_leximin(spark: SparkSession, d: str) -> DataFrame:
    r = ranking.rank_candidates(table(spark, d, "hits"), "query_id", "id", "modal", "score_raw", MODALITIES, 10)
    return r.select("query_id", "id", "position", *(F.round(F.col("leximin")[k], 6).alias(f"v{k + 1}") for k in range(3)))


def _site(spark: SparkSession, d: str, order: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """chunks, the documents of each source, the occurrences of frequent lines (kept in the shared folder, as the sequences grow from them)."""
    chunks = table(spark, d, "chunks")
    docs = chunks.filter(F.col("source").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("source").alias("s"), F.xxhash64("doc_id").alias("d"))
    texts = spread(chunks.filter("type = 'text'").select("id", "doc_id", "source", "ord", "content"))
    lines = cut(sitelines.line_table(texts, "id", "doc_id", "source", "content", order))
    return chunks, docs, cut(sitelines.occurrences(lines, cut(sitelines.frequent_lines(lines, docs))))


def _repeated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """chunks, and the occurrences of all frequent runs of lines."""
    chunks, docs, at = _site(spark, d)
    return chunks, sitelines.of_sequences(at, sitelines.prefix_span(at, docs, max_gap=1))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _repeated(spark, d)[1].select(F.col("k").alias("id"), "line_no").distinct()


def p4_sequences(spark: SparkSession, d: str) -> DataFrame:
    _, docs, at = _site(spark, d, "ord")
    return sitelines.prefix_span(at, docs).select(F.col("s").alias("source"), F.size("pattern").alias("length"), "pattern", "support")


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    chunks, at = _repeated(spark, d)
    texts = once_each(chunks.filter("type = 'text'").select("id", "doc_id", "source", "content"), ["id"])
    return sitelines.remove_lines(texts, "id", "content", at).drop("content")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("src"), F.col("id").alias("item_id"), F.col("content").alias("body"))
    units = table(spark, d, "content_list").select(F.lit("content_list").alias("src"), F.col("unit_id").alias("item_id"), F.col("text").alias("body"))
    return spread(chunks.unionByName(units))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    cut = splitting.split_oversized(_texts(spark, d), ["src", "item_id"], "body", only_oversized=True)
    return cut.filter("piece_no = 1").select("src", "item_id").distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(once_each(_texts(spark, d), ["src", "item_id"]), ["src", "item_id"], "body")


def p5_checks(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each text must hold: at most 500 characters, 50 shared with the piece before, and together the text."""
    p = p5_pieces(spark, d).groupBy("src", "item_id").agg(F.max("pieces").alias("pieces"), F.array_sort(F.collect_list(F.struct("piece_no", "start", "end", "piece"))).alias("p"))
    n = F.size("p")
    fits = F.forall("p", lambda x: (F.length(x["piece"]) <= 500) & (F.length(x["piece"]) == x["end"] - x["start"]))
    shares = F.forall(F.sequence(F.lit(0), n - 1), lambda k: F.when(k == 0, F.col("p")[0]["start"] == 0).otherwise(F.col("p")[k]["start"] == F.col("p")[F.greatest(k - 1, F.lit(0))]["end"] - 50))
    whole = F.array_join(F.transform("p", lambda x, k: F.when(k == 0, x["piece"]).otherwise(F.substring(x["piece"], F.lit(51), F.length(x["piece"])))), "")
    return p.select("src", "item_id", (n == F.col("pieces")).alias("complete"), fits.alias("fits"), shares.alias("shares"), F.length(whole).alias("n"), F.md5(whole).alias("hash"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_counts(_documents(spark, d), "doc_id", "text", TOKENIZER), "doc_id")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    used = p6_containers(spark, d).filter("tokens > 0").groupBy("container").agg(F.sum("tokens").alias("used"), F.count("*").alias("items"))
    return used.groupBy((packing.CAPACITY - F.col("used")).alias("unused")).agg(F.count("*").alias("containers"), F.sum("items").alias("items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(_documents(spark, d), "doc_id", "text", table(spark, d, "eval_items"), "item_id", ["question", "answer"])


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    near = leakage.find_near(_documents(spark, d), "doc_id", "text", table(spark, d, "eval_items"), "item_id", ["question", "answer"])
    return near.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


def p8_grades(spark: SparkSession, d: str) -> DataFrame:
    return reading.grade_documents(_documents(spark, d), table(spark, d, "reading_labels"), "doc_id", "text", "grade")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_grades(spark, d).filter("grade >= 4").select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}
