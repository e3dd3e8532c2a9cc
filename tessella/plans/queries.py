"""Registry of the core queries. Each reads whole tables; searches take the rows whose id is divisible by 100 as queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tessella.functions import domain as dm
from tessella.functions import text as tx
from tessella.functions import vector as vec
from tessella.operators import chunking, evaluate, providers, registry, retrieval, tables, units
from tessella.operators import index as ix
from tessella.session import cut, shared_folder, spread, table
from tessella.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CURRENT_YEAR = 2024


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(QUERIES)


# inputs


def once(df: DataFrame, key: str, version: str, cols: tuple[str, ...]) -> DataFrame:
    """Each key once, the latest delivery. Only the columns asked for are read and shuffled."""
    return chunking.latest_by_key(df.select(*dict.fromkeys([key, *cols, version])), [key], version)


def content_list(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return once(table(spark, d, "content_list"), "unit_id", "loaded_at", cols)


def chunks(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return once(table(spark, d, "chunks"), "id", "loaded_at", cols)


def meta(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return once(table(spark, d, "meta"), "id", "loaded_at", cols)


#: What chunk assembly and the evaluation read of a unit.
UNIT = ("doc_id", "unit_no", "type", "page_idx", "page", "text", "content", "items", "table_body", "table_text")
EVAL_UNIT = ("doc_id", "unit_no", "type", "text", "content", "items", "table_text", "text_level")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as rows of the sub-index of their source; without one they belong to no sub-index."""
    return spread(table(spark, d, "documents").select("doc_id", "source", "text").filter("source IS NOT NULL"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, n, body): the lines of documents with white space normalised."""
    split = F.posexplode(F.split(F.regexp_replace(F.col("text"), "\r\n?", "\n"), "\n", -1)).alias("n", "line")
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", split).select("doc_id", "n", tx.normalize_space("line").alias("body"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Queries of the text searches: titles of the documents whose id is divisible by 100."""
    return table(spark, d, "documents").filter("doc_id % 100 = 0 AND title IS NOT NULL").select(F.col("doc_id").alias("query_id"), F.col("title").alias("q"))


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Candidates once each, with the root of their sub-index cut off; null scores are left out, as an index returns none."""
    key = ["query_id", "modal", "index_dir", "rid"]
    one = chunking.latest_by_key(table(spark, d, "hits").drop("score_norm"), key, "run_at")
    return one.filter("score_raw IS NOT NULL")


def two_modes(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).filter("modal IN ('faiss', 'bm25')")


# scalar functions


@query
def normalize_space(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.length(tx.normalize_space("text")).alias("n"), F.md5(tx.normalize_space("text")).alias("hash"))


@query
def bm25_tokenize(spark: SparkSession, d: str) -> DataFrame:
    tokens = tx.bm25_tokens("text")
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.size(tokens).alias("n"), F.md5(F.array_join(tokens, " ")).alias("hash"))


@query
def strip_html(spark: SparkSession, d: str) -> DataFrame:
    return meta(spark, d, "raw_content").select("id", tx.strip_html("raw_content").alias("plain"))


@query
def merged_cell_flag(spark: SparkSession, d: str) -> DataFrame:
    return content_list(spark, d, "table_body").filter("table_body IS NOT NULL").select("unit_id", tx.has_merged_cells("table_body").alias("merged"))


@query
def content_fallback(spark: SparkSession, d: str) -> DataFrame:
    return meta(spark, d, "embed_text", "raw_content").select("id", F.length(tx.content_of("embed_text", "raw_content")).alias("n"))


@query
def unit_text(spark: SparkSession, d: str) -> DataFrame:
    u = content_list(spark, d, "type", "page_idx", "page", "text", "content", "items").filter(F.col("type").isin(*chunking.KINDS) & (F.col("type") != "table"))
    return u.select("unit_id", tx.page_number("page_idx", "page").alias("page_no"), chunking.unit_text().alias("body"))


@query
def unit_text_evaluation(spark: SparkSession, d: str) -> DataFrame:
    u = content_list(spark, d, *EVAL_UNIT).filter(F.col("type").isin(*chunking.KINDS))
    return u.select("unit_id", chunking.eval_unit_text().alias("body")).filter("body <> ''")


@query
def title_year_quarter(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "doc_registry").select("doc_id").distinct()
    t = one.select("doc_id", dm.title_meta("doc_id").alias("t"))
    return t.select("doc_id", "t.doc_type", "t.year", "t.quarter", "t.source_date", "t.year_source", F.array_join("t.years_mentioned", ",").alias("years_mentioned"), "t.is_multi_year")


@query
def doc_type_rules(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "doc_registry").select(F.col("doc_id").alias("body")).unionByName(table(spark, d, "queries").select(F.col("query_text").alias("body"))).distinct()
    return texts.select("body", dm.classify("body").alias("c")).select("body", "c.doc_type", F.round("c.confidence", 6).alias("confidence"))


@query
def query_years(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "queries").select("query_id", dm.query_period("query_text", CURRENT_YEAR).alias("p"))
    return p.select("query_id", F.array_join("p.years", ",").alias("years"), F.array_join("p.quarters", ",").alias("quarters"), "p.is_range", "p.n_recent", "p.has_relative")


@query
def relative_years(spark: SparkSession, d: str) -> DataFrame:
    """The period of questions made from orders: 近N年, ranges and 去年, in the year of the order."""
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("近"), (F.col("o_orderkey") % 22).cast("string"), F.lit("年"), F.year("o_orderdate") - 12, F.lit("至"), F.year("o_orderdate"), F.lit("年第三季度与去年")).alias("q"))
    p = o.select("o_orderkey", dm.query_period("q", CURRENT_YEAR).alias("p"))
    return p.select("o_orderkey", F.array_join("p.years", ",").alias("years"), F.array_join("p.quarters", ",").alias("quarters"))


@query
def angle_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").select("query_id", tx.angle_parts(F.concat(F.lit("改写：< “"), "query_text", F.lit("” > 与 <b>"))).alias("part"))


@query
def truncate_context(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "content").select("id", tx.truncate("content", 40).alias("short"))


@query
def prune_none(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").select("query_id", F.to_json(F.struct("doc_type", F.lit(None).cast("int").alias("year"), "query_id")).alias("json"))


# tables and chunks


@query
def textify_simple_table(spark: SparkSession, d: str) -> DataFrame:
    """HTML of nations as text: the header names the columns, blank cells are left out."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    html = F.concat(F.lit("<table><tr><th>国家</th><th></th><th>区域</th></tr><tr>"), cell("n_name"), cell(F.col("n_nationkey").cast("string")), cell(F.when(F.col("n_nationkey") % 5 == 0, " ").otherwise(F.col("r_name"))), F.lit("</tr></table>"))
    return tables.textify(n.select("n_nationkey", html.alias("html")), "html", "body").drop("html")


@query
def textify_no_header(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit("<table><tr><td>"), "r_name", F.lit("</td></tr><tr><td>"), F.col("r_regionkey").cast("string"), F.lit(".</td></tr></table>"))
    return tables.textify(table(spark, d, "region").select("r_regionkey", html.alias("html")), "html", "body").drop("html")


@query
def textify_tables(spark: SparkSession, d: str) -> DataFrame:
    t = content_list(spark, d, "table_body").filter("table_body IS NOT NULL")
    return tables.textify(t, "table_body", "body").select("unit_id", "body")


@query
def textify_resumed(spark: SparkSession, d: str) -> DataFrame:
    t = content_list(spark, d, "table_body", "table_text").filter("table_body IS NOT NULL")
    done = tables.textify(t, "table_body", "body", earlier=F.col("table_text"))
    return done.select("unit_id", tx.non_blank("table_text").isNotNull().alias("reused"), F.md5("body").alias("hash"))


@query
def chunk_pack_500(spark: SparkSession, d: str) -> DataFrame:
    kept = lines(spark, d).filter("body <> ''")
    docs = chunking.by_document(kept, "doc_id", "n", ["body"]).withColumn("bodies", F.transform("units", lambda u: u["body"]))
    slices = chunking.slicer(chunking.greedy_slices, most=500)(F.transform("bodies", F.length))
    cut = docs.withColumn("slices", slices).select("doc_id", F.posexplode(F.transform("slices", lambda s: chunking.slice_text(F.col("bodies"), s))).alias("k", "content"))
    return cut.select("doc_id", (F.col("k") + 1).alias("no"), F.length("content").alias("n"), F.md5("content").alias("hash"))


@query
def chunks_rows(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.assemble(content_list(spark, d, *UNIT), "rows")
    return c.select("id", "doc_id", "type", "page", "content", "ord", F.col("tbl.id").alias("table_id"), "tbl.seq", "tbl.row_index", "tbl.digest")


@query
def chunks_html(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.assemble(content_list(spark, d, *UNIT), "html")
    return c.select("id", "doc_id", "type", "page", "content", "ord", F.col("tbl.id").alias("table_id"), "tbl.seq", "tbl.part", "tbl.parts")


@query
def tables_index(spark: SparkSession, d: str) -> DataFrame:
    return chunking.tables_index(content_list(spark, d, "doc_id", "unit_no", "type", "page_idx", "page", "table_body", "table_text"), "rows").select("id", "doc_id", "page", "seq", "digest")


@query
def interleave_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of units between tables: how many units and characters each has."""
    u = content_list(spark, d, "doc_id", "unit_no", "type").filter(F.col("type").isin(*chunking.KINDS))
    seq = u.withColumn("island", F.sum((F.col("type") == "table").cast("int")).over(W.partitionBy("doc_id").orderBy("unit_no")))
    return seq.filter("type <> 'table'").groupBy("doc_id", "island").agg(F.count("*").alias("units"), F.min("unit_no").alias("first"), F.max("unit_no").alias("last"))


@query
def chunk_length_overlap(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.strategy_chunks(lines(spark, d), "doc_id", "n", "body", "length", 800, 200)
    return c.select("id", F.length("content").alias("n"), F.md5("content").alias("hash"))


def _eval_units(spark: SparkSession, d: str) -> DataFrame:
    u = content_list(spark, d, *EVAL_UNIT).filter(F.col("type").isin(*chunking.KINDS))
    return u.select("doc_id", "unit_no", chunking.eval_unit_text().alias("body"), F.col("text_level").isNotNull().alias("brk"))


@query
def chunk_level(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.strategy_chunks(_eval_units(spark, d), "doc_id", "unit_no", "body", "level", 800, breaks="brk")
    return c.select("id", F.length("content").alias("n"), F.md5("content").alias("hash"))


def _embedded(df: DataFrame, text: str) -> DataFrame:
    """`df` with the vectors of the offline embedder in `v`."""
    return providers.embed(df, text, "v", providers.HashedEmbedder(16), 1000)


@query
def chunk_semantic(spark: SparkSession, d: str) -> DataFrame:
    u = _embedded(_eval_units(spark, d).filter("body <> ''"), "body")
    c = chunking.strategy_chunks(chunking.semantic_breaks(u, "doc_id", "unit_no", "v"), "doc_id", "unit_no", "body", "semantic", 800, breaks="split_here")
    return c.select("id", F.length("content").alias("n"), F.md5("content").alias("hash"))


@query
def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    """The three strategies as one dimension: chunk statistics and adjacent distances, weighted by chunks."""
    u = _embedded(_eval_units(spark, d).filter("body <> ''"), "body")
    split = chunking.semantic_breaks(u, "doc_id", "unit_no", "v")
    made = {"length": chunking.strategy_chunks(u, "doc_id", "unit_no", "body", "length", 800, 200), "level": chunking.strategy_chunks(u, "doc_id", "unit_no", "body", "level", 800, breaks="brk"), "semantic": chunking.strategy_chunks(split, "doc_id", "unit_no", "body", "semantic", 800, breaks="split_here")}
    every = None
    for name, c in made.items():
        c = c.withColumn("strategy", F.lit(name))
        every = c if every is None else every.unionByName(c)
    every = _embedded(every.withColumn("g", F.struct("strategy", "doc_id")), "content")
    score = evaluate.adjacent_distance(every, "g", "no", "v").select("g.strategy", F.col("segments").alias("chunk_count"), "score", F.lit(0.0).alias("time_sec"))
    r = evaluate.weighted_report(score)
    return r.select("strategy", F.round("avg_score", 6).alias("avg_score"), "avg_time", "total_chunks", "files")


@query
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    s = evaluate.chunk_stats(chunks(spark, d, "source", "type", "content"), ["source", "type"], "content")
    return s.select("source", "type", "chunk_count", F.round("avg_chunk_len", 6).alias("avg_chunk_len"))


@query
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.table_counts(content_list(spark, d, "doc_id", "type", "table_text"))


# indexes and search


@query
def bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    return ix.postings(ix.tokenized(documents(spark, d), "source", "doc_id", "text"))


def _sparse(spark: SparkSession, d: str) -> ix.SparseIndex:
    return ix.SparseIndex.build(documents(spark, d), "source", "doc_id", "text")


@query
def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    t = _sparse(spark, d).terms
    return t.select("idx", "term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_topk_per_index(spark: SparkSession, d: str) -> DataFrame:
    top = retrieval.bm25_top_k(asked(spark, d), _sparse(spark, d), 5)
    return top.select("query_id", "idx", "rid", F.round("score", 6).alias("score"), "rank")


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = ix.dense_index(table(spark, d, "embeddings"), "embedding")
    v = e.select(F.col("label").alias("idx"), F.col("vec_id").alias("rid"), F.col("unit").alias("v"))
    return e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("unit").alias("q")), v


@query
def dense_topk_per_index(spark: SparkSession, d: str) -> DataFrame:
    top = retrieval.dense_top_k(*_vectors(spark, d), 5)
    return top.select("query_id", "idx", "rid", F.round("score", 6).alias("score"), "rank")


@query
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = ix.dense_index(table(spark, d, "embeddings"), "embedding")
    return e.select("vec_id", F.round(F.col("unit")[0], 6).alias("x0"), F.round(F.col("unit")[63], 6).alias("x63"), F.round(vec.norm("unit"), 6).alias("length"))


@query
def minmax_strict(spark: SparkSession, d: str) -> DataFrame:
    m = vec.with_minmax(two_modes(spark, d), ["query_id", "modal"], "score_raw", "norm", True)
    return m.select("query_id", "modal", "index_dir", "rid", F.round("norm", 6).alias("norm"))


@query
def minmax_smooth(spark: SparkSession, d: str) -> DataFrame:
    m = vec.with_minmax(two_modes(spark, d), ["query_id", "modal"], "score_raw", "norm", False)
    return m.select("query_id", "modal", "index_dir", "rid", F.round("norm", 6).alias("norm"))


def _blended(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.blend(vec.with_minmax(two_modes(spark, d), ["query_id", "modal"], "score_raw", "norm", True), 0.5, "norm")


@query
def blend_linear(spark: SparkSession, d: str) -> DataFrame:
    return _blended(spark, d).select("query_id", "modal", "index_dir", "rid", F.round("score_blend", 6).alias("score_blend"))


@query
def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    r = retrieval.rrf(two_modes(spark, d), 0.5, ["index_dir", "rid"])
    return r.select("query_id", "index_dir", "rid", "faiss_rank", "bm25_rank", F.round("score_rrf", 9).alias("score_rrf"))


@query
def rrf_cross_modal(spark: SparkSession, d: str) -> DataFrame:
    r = retrieval.rrf(two_modes(spark, d), 0.5, ["id"])
    return r.select("query_id", "id", "faiss_rank", "bm25_rank", F.round("score_rrf", 9).alias("score_rrf"))


def _with_table(df: DataFrame) -> DataFrame:
    """Candidates with a table of their own: every third row of a document belongs to its table."""
    return df.withColumn("table_id", F.when(F.col("rid") % 3 == 0, F.concat(F.regexp_replace("index_dir", "^[^/]*/", ""), F.lit("::t1"))))


@query
def dedup_pretopk(spark: SparkSession, d: str) -> DataFrame:
    p = retrieval.prune(_with_table(_blended(spark, d)), "score_blend", 30)
    return p.select("query_id", "modal", "id", "pre_rank")


@query
def post_filter_page(spark: SparkSession, d: str) -> DataFrame:
    """Pages are filtered after scaling and ranking, so ranks keep their gaps."""
    ranked = retrieval.modal_rank(two_modes(spark, d))
    pages = meta(spark, d, "page").select("id", "page")
    return retrieval.page_filter(ranked.join(pages, "id"), 2, 3).select("query_id", "modal", "id", "page", "rank")


@query
def post_filter_type_and_page(spark: SparkSession, d: str) -> DataFrame:
    ranked = retrieval.modal_rank(two_modes(spark, d))
    facts = meta(spark, d, "page", "type", "doc_id").select("id", "page", "type", "doc_id")
    return retrieval.candidate_filter(ranked.join(facts, "id"), kind="text", first=2).select("query_id", "modal", "id", "page", "rank")


def _for_rerank(spark: SparkSession, d: str) -> DataFrame:
    p = retrieval.prune(_with_table(_blended(spark, d)), "score_blend", 30)
    placed = p.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("pre_rank")) - 1)
    texts = meta(spark, d, "raw_content", "embed_text", "page", "type", "doc_id", "ord").select("id", tx.content_of("raw_content", "embed_text").alias("content"), "page", "type", "doc_id", "ord")
    return placed.join(texts, "id").join(table(spark, d, "queries").select("query_id", "query_text"), "query_id")


@query
def rerank_fallback(spark: SparkSession, d: str) -> DataFrame:
    r = retrieval.rerank(_for_rerank(spark, d), None, 10)
    return r.select("query_id", "id", "rerank_rank", "rerank_score")


@query
def rerank_lexical(spark: SparkSession, d: str) -> DataFrame:
    docs = _for_rerank(spark, d)
    given = retrieval.lexical_scores(docs, "query_text", "content").select("query_id", "position", "rerank_score")
    r = retrieval.rerank(docs, given, 10)
    return r.select("query_id", "id", "rerank_rank", F.round("rerank_score", 6).alias("rerank_score"))


def _chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "source", "doc_id", "ord", "tbl", "content").select("id", F.col("source").alias("index_dir"), "doc_id", "ord", F.col("tbl.id").alias("table_id"), F.col("tbl.row_index").alias("row_index"), "content")


def _restored(spark: SparkSession, d: str, radius: int) -> DataFrame:
    """Context of the chunks whose hash is divisible by 100."""
    rows = _chunk_rows(spark, d)
    hit = rows.filter(F.conv(F.right(F.md5("id"), F.lit(6)), 16, 10).cast("long") % 100 == 0).withColumnRenamed("id", "hit_id")
    return retrieval.restore_context(hit, rows, radius)


@query
def restore_table(spark: SparkSession, d: str) -> DataFrame:
    return _restored(spark, d, 0).select("hit_id", F.length("restored").alias("n"), F.md5("restored").alias("hash"))


@query
def restore_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _restored(spark, d, 1).select("hit_id", F.length("restored").alias("n"), F.md5("restored").alias("hash"))


@query
def answer_context(spark: SparkSession, d: str) -> DataFrame:
    r = retrieval.rerank(_for_rerank(spark, d), None, 10)
    c = retrieval.answer_context(r.select("query_id", F.col("rerank_rank").alias("rank"), "doc_id", "page", "type", "content", F.col("table_id").isNotNull().alias("is_table")), 100, 120, 1500, 100)
    return c.select("query_id", F.length("context").alias("n"), F.md5("context").alias("hash"))


SYSTEM, PER_CHUNK, ROOM = "你是上市公司公告的问答助手。", 120, 1500


def _material(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The questions and their ten best results, as an answer takes them."""
    r = retrieval.rerank(_for_rerank(spark, d), None, 10)
    files = meta(spark, d, "source_file").select("id", "source_file")
    ready = r.join(files, "id").select("query_id", F.col("rerank_rank").alias("rank"), "id", "modal", "doc_id", "page", "type", "ord", "content", "index_dir", "source_file", F.col("table_id").isNotNull().alias("is_table"))
    return table(spark, d, "queries").select("query_id", F.col("query_text").alias("q")), ready


@query
def answer_messages(spark: SparkSession, d: str) -> DataFrame:
    m = retrieval.answer_messages(*_material(spark, d), SYSTEM, PER_CHUNK, ROOM, 100)
    content = lambda k: F.col("messages")[k]["content"]
    return m.select("query_id", content(0).alias("system"), F.length(content(1)).alias("n"), F.md5(content(1)).alias("hash"))


@query
def answer_sources(spark: SparkSession, d: str) -> DataFrame:
    a = retrieval.answer_sources(_material(spark, d)[1], PER_CHUNK)
    return a.select("query_id", "ref", "id", "modal", "doc_id", "page", "type", "ord", F.md5("content").alias("hash"), "index_dir", "source_file")


def echo(chats: list[list[tuple[str, str]]]) -> list[str | None]:
    """A deterministic chat model: the length and the last characters of what it is asked, in angle brackets."""
    return [f"答：< “{len(c[-1][1])} {c[-1][1][-12:].strip()}” >" for c in chats]


@query
def answer_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Candidates to answers with a model that repeats the question behind its material."""
    questions, ready = _material(spark, d)
    prompt = ("问：", "\n", "\n再问：")
    m = retrieval.answer_messages(questions, ready, SYSTEM, PER_CHUNK, ROOM, 100, prompt)
    return providers.chat(m, "messages", "answer", echo).select("query_id", "answer")


@query
def multi_query_routes(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "queries").select("query_id", F.col("query_text").alias("q"))
    return retrieval.expand_questions(q, echo, ("换词：", "换概念："), "设想：").select("query_id", "route", "name", "q")


@query
def embedding_usage(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by type of unit where the provider reports none."""
    u = content_list(spark, d, *EVAL_UNIT).select("type", chunking.eval_unit_text().alias("body"))
    used = providers.embed_counting(u, "body", "v", "tokens", lambda texts: ([[0.0]] * len(texts), None), 100)
    return used.groupBy("type").agg(F.sum("tokens").alias("tokens"), F.count("v").alias("embedded"))


@query
def multi_route_merge(spark: SparkSession, d: str) -> DataFrame:
    """The three modalities as routes of one query, merged in their order."""
    route = F.when(F.col("modal") == "faiss", 0).when(F.col("modal") == "bm25", 1).otherwise(2)
    ranked = retrieval.modal_rank(hits(spark, d)).withColumn("route", route)
    return retrieval.merge_routes(ranked).select("query_id", "id", "route", "rank", "position")


@query
def adjacent_distance(spark: SparkSession, d: str) -> DataFrame:
    a = evaluate.adjacent_distance(table(spark, d, "embeddings"), "label", "vec_id", "embedding")
    return a.select("label", "segments", F.round("score", 6).alias("score"))


@query
def weighted_report(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("strategy"), (F.col("user_id") % 7).alias("chunk_count"), F.col("value").alias("score"), (F.col("event_id") % 10).cast("double").alias("time_sec"))
    r = evaluate.weighted_report(e)
    return r.select("strategy", F.round("avg_score", 6).alias("avg_score"), F.round("avg_time", 6).alias("avg_time"), "total_chunks", "files")


@query
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("calls"), F.sum(F.greatest(F.lit(1), F.floor(F.length("props") / 2))).alias("tokens"))


# registries and routing


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "doc_registry"), "doc_id", "loaded_at", ("doc_type", "year", "quarter", "source_date")).select("doc_id", "doc_type", "year", "quarter", "source_date")


@query
def registry_docs(spark: SparkSession, d: str) -> DataFrame:
    return registry.document_registry(registry.first_rows(meta(spark, d, "index_dir", "rid", "doc_id", "doc_meta")))


@query
def registry_type_year(spark: SparkSession, d: str) -> DataFrame:
    r = registry.by_type_year(_docs(spark, d))
    return r.select("doc_type", "year_key", "documents", F.md5(F.array_join("doc_ids", ";")).alias("hash"))


@query
def doc_registry_enrich(spark: SparkSession, d: str) -> DataFrame:
    first = registry.document_registry(registry.first_rows(meta(spark, d, "index_dir", "rid", "doc_id", "doc_meta")))
    return registry.enrich(first, _docs(spark, d))


def _indexes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _docs(spark, d)
    return registry.index_registry(docs, "faiss", "faiss_ctrl"), registry.index_registry(docs.filter("year IS NULL OR year % 2 = 0"), "bm25", "bm25_ctrl")


def _route(name: str, doc_type: str | None, years: list[int], override: str | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return registry.route(*_indexes(spark, d), doc_type, years, override)

    run.__name__ = name
    query(run)


_route("route_type_and_year", "report", [2021])
_route("route_type_unknown_year", "notice", [2090])
_route("route_year_only", None, [2020, 2021])
_route("route_type_only", "report", [])
_route("route_nothing", None, [])
_route("route_both", "report", [], "both")


def _routed(spark: SparkSession, d: str) -> DataFrame:
    """All questions routed in one job, by their own kind or one that overrides it."""
    override = F.when(F.contains("query_text", F.lit("公告")), "notice").when(F.contains("query_text", F.lit("年")) & F.col("doc_type").isNull(), "both")
    q = table(spark, d, "queries").select("query_id", "doc_type", dm.query_period("query_text", CURRENT_YEAR)["years"].alias("years"), override.alias("override"))
    return registry.route_batch(q, *_indexes(spark, d))


@query
def route_batch(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d)


@query
def route_decisions(spark: SparkSession, d: str) -> DataFrame:
    return registry.decisions(_routed(spark, d))


def _built(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The registries of the dense index (meta) and of the sparse index (chunks, one sub-index for each document)."""
    sparse = chunks(spark, d, "doc_id", "ord", "meta").select(F.col("doc_id").alias("index_dir"), F.col("ord").alias("rid"), "doc_id", F.col("meta").alias("doc_meta"))
    return registry.build(meta(spark, d, "index_dir", "rid", "doc_id", "doc_meta"), sparse, "faiss_ctrl", "bm25_ctrl")


@query
def registry_build(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d)[0].select("doc_id", "doc_type", "year", "quarter", "source_date")


@query
def registry_build_index(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d)[1].groupBy("kind", "doc_type", "year_key").agg(F.count("*").alias("dirs"), F.min("index_dir").alias("first_dir"))


@query
def stored_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The sparse index of meta is written by kind and year; a search reads the folders of one kind and year only."""
    given = table(spark, d, "meta").select("id", "index_dir", "rid", "embed_text", F.struct("doc_meta.doc_type", "doc_meta.year").alias("doc_meta"), "loaded_at")
    rows = chunking.latest_of_repeated(given, "id", "loaded_at")
    folder = shared_folder(spark, "index")
    facts = rows.groupBy(F.col("index_dir").alias("idx")).agg(F.max("doc_meta.doc_type").alias("doc_type"), F.max("doc_meta.year").alias("year"))
    ix.SparseIndex.store(rows, "index_dir", "rid", "embed_text", cut(facts), folder)
    stored = ix.SparseIndex.read(spark, folder, (F.col("doc_type") == "report") & (F.col("year") == 2021))
    top = retrieval.bm25_top_k(table(spark, d, "queries").select("query_id", F.col("query_text").alias("q")), stored, 3, 20)
    return top.select("query_id", "idx", "rid", F.round("score", 6).alias("score"), "rank")


@query
def lines_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as JSON lines and read again; null fields are left out of the files."""
    folder = shared_folder(spark, "lines")
    c = chunks(spark, d, "doc_id", "type", "page", "content", "ord", "meta")
    files.write_lines(c.select("id", "doc_id", "type", "page", "content", F.col("ord").alias("order"), "meta"), folder)
    back = files.read_lines(spark, folder, files.CHUNK)
    return back.select("id", "doc_id", "type", "page", F.md5("content").alias("hash"), "order", F.col("meta.year").alias("year"), F.array_join("meta.years_mentioned", ",").alias("years"))


@query
def report_append(spark: SparkSession, d: str) -> DataFrame:
    """A report that grows with each run: two runs of the chunk statistics, with their run ids."""
    folder = shared_folder(spark, "report")
    for run in (1, 2):
        files.write_lines(chunk_stats(spark, d).withColumn("run", F.lit(run)), folder, "append")
    schema = "source string, type string, chunk_count long, avg_chunk_len double, run int"
    return files.read_lines(spark, folder, T._parse_datatype_string(schema))


@query
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d)


@query
def incremental_pending(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are not in both of two finished sets."""
    docs = table(spark, d, "documents").select("doc_id")
    return ix.pending(docs, [docs.filter("doc_id % 4 = 0"), docs.filter("doc_id % 10 < 5")], "doc_id")


@query
def resume_reuse(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "title")
    old = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("title")).when(F.col("doc_id") % 3 == 1, F.lit("  ")).alias("old"))
    return ix.resume(docs.withColumn("new", F.lit("new")), old, ["doc_id"], "old", "new", "body").select("doc_id", "body")


def _recorded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    units_read = table(spark, d, "content_list").select("unit_id", "doc_id", "unit_no", "type", "text", "content", "table_text")
    return spread(units_read), spread(table(spark, d, "meta").select("index_dir", "rid", "id", "embed_text", "raw_content")), table(spark, d, "unit_measures")


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return units.common_values(*_recorded(spark, d))


@query
def p2_recovered(spark: SparkSession, d: str) -> DataFrame:
    return units.recovered_units(*_recorded(spark, d))
