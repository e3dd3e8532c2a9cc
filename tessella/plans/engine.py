"""The engine: ingest of OCR documents into chunks and indexes, and search in one job for a batch of questions.

    e = Engine(spark, embedder=..., reranker=None)
    chunks = e.chunk(units, "rows")
    dense, rows = e.index(chunks)
    results = e.search(questions, rows, alpha=0.5)
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import domain as dm
from tessella.functions import text as tx
from tessella.functions import vector as vec
from tessella.operators import chunking, intent, providers, registry, retrieval
from tessella.operators import index as ix
from tessella.session import cut


@dataclass
class Parameters:
    """Defaults of the command line; `routed` has those of the routed search."""

    alpha: float = 0.5
    pre_top_k: int = 30
    dense_per_index: int = 50
    sparse_per_index: int = 50
    rerank_top_k: int = 30
    radius: int = 1
    #: Candidates of a question and modality over all sub-indexes; None keeps every sub-index's best, as a search of few does.
    most: int | None = 1000

    @classmethod
    def routed(cls) -> Parameters:
        return cls(dense_per_index=10, rerank_top_k=10)


class Engine:
    def __init__(self, spark: SparkSession, embedder: providers.Embedder | None = None, current_year: int = 2024):
        self.spark, self.embedder, self.current_year = spark, embedder or providers.HashedEmbedder(), current_year

    def chunk(self, units: DataFrame, mode: str = "rows", most: int = 500) -> DataFrame:
        """Chunks of OCR units with the filing's metadata from its name."""
        return chunking.assemble(units, mode, most).withColumn("doc_meta", dm.title_meta("doc_id"))

    def index(self, chunks: DataFrame, done: DataFrame | None = None, strip: bool = True) -> DataFrame:
        """Index rows, one logical sub-index per document: index_dir, rid, embed_text, raw_content, unit, kind and year.

        done: (index_dir) of documents that are indexed already and are skipped."""
        rows = chunks.withColumn("index_dir", F.col("doc_id"))
        if done is not None:
            rows = ix.pending(rows, [done], "index_dir")
        rows = rows.withColumns({"rid": F.col("ord") - 1, "raw_content": F.col("content"), "embed_text": tx.strip_html("content") if strip else F.col("content"), "doc_type": F.col("doc_meta.doc_type"), "year": F.col("doc_meta.year")})
        return ix.dense_index(providers.embed(rows, "embed_text", "embedding", self.embedder), "embedding").drop("embedding", "content")

    def candidates(self, questions: DataFrame, rows: DataFrame, p: Parameters, dense: bool = True, sparse: bool = True, sparse_index: ix.SparseIndex | None = None) -> DataFrame:
        """The union of both searches, with scores scaled per query and modality. sparse_index: a stored one of the same rows."""
        parts = []
        if dense:
            q = providers.embed(questions, "q", "v", self.embedder).filter("v IS NOT NULL").select("query_id", vec.l2_normalize("v").alias("q"))
            parts.append(retrieval.dense_top_k(q, rows.select(F.col("index_dir").alias("idx"), "rid", F.col("unit").alias("v")), p.dense_per_index, most=p.most).withColumn("modal", F.lit("faiss")))
        if sparse:
            parts.append(retrieval.bm25_top_k(questions, sparse_index or ix.SparseIndex.build(rows, "index_dir", "rid", "embed_text"), p.sparse_per_index, p.most).withColumn("modal", F.lit("bm25")))
        if not parts:
            raise ValueError("one of the searches must run")
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        both = cut(both.withColumnsRenamed({"idx": "index_dir", "score": "score_raw"}).drop("rank"))  # k rows per query and sub-index, read twice
        scaled = vec.with_minmax(both, ["query_id", "modal"], "score_raw", "score_norm", True)
        facts = rows.select("index_dir", "rid", "id", "doc_id", "page", "type", "ord", F.col("tbl.id").alias("table_id"), tx.content_of("raw_content", "embed_text").alias("content"))
        return scaled.join(facts, ["index_dir", "rid"])

    def search(self, questions: DataFrame, rows: DataFrame, p: Parameters | None = None, pages: tuple[int, int] | None = None, fuse: str = "blend", reranker: Callable[[DataFrame], DataFrame] | None = None, dense: bool = True, sparse: bool = True) -> DataFrame:
        """Results of a batch of questions (query_id, q): rank, scores and restored content.

        pages: bounds that are applied after scaling; fuse: blend or rrf; reranker: from (query_id, position, q, content)
        to (query_id, position, rerank_score), or None to keep the order."""
        p = p or Parameters()
        found = self.candidates(questions, rows, p, dense, sparse)
        if pages:
            found = retrieval.page_filter(found, *pages)
        if fuse == "blend":
            found = retrieval.blend(found, p.alpha, "score_norm", "score_fused")
        elif fuse == "rrf":
            ranked = retrieval.modal_rank(found)
            weight = F.when(F.col("modal") == "faiss", F.lit(1 - p.alpha)).otherwise(F.lit(p.alpha))
            found = ranked.withColumn("score_fused", weight / (retrieval.RRF + F.col("rank"))).drop("rank")
        else:
            raise ValueError("fuse is blend or rrf")
        pruned = cut(retrieval.prune(found, "score_fused", p.pre_top_k))  # at most pre_top_k rows per query
        order = retrieval.W.partitionBy("query_id").orderBy("pre_rank")
        placed = pruned.withColumn("position", F.row_number().over(order) - 1).join(questions, "query_id")
        best = cut(retrieval.rerank(placed, reranker(placed) if reranker else None, p.rerank_top_k))
        hits = best.withColumn("hit_id", F.struct("query_id", "index_dir", "rid"))
        chunks = rows.select("index_dir", "doc_id", "ord", F.col("tbl.id").alias("table_id"), F.col("tbl.row_index").alias("row_index"), tx.content_of("raw_content", "embed_text").alias("content"))
        return retrieval.restore_context(hits, chunks, p.radius).drop("hit_id")

    def route_and_search(self, question: str, rows: DataFrame, override: str | None = None, model: Callable[[str], str | None] | None = None, p: Parameters | None = None, **how) -> tuple[DataFrame, intent.Intent, intent.Trace]:
        """One question: intent, routing to sub-indexes by kind and year, search with rank fusion."""
        what, trace = intent.analyse(self.spark, question, self.current_year, model)
        stage = trace.begin("route")
        docs = rows.select("doc_id", "doc_type", "year").distinct()
        reg = docs.select(F.lit("both").alias("kind"), "doc_id", "doc_type", registry.year_key().alias("year_key"), F.col("doc_id").alias("index_dir"))
        chosen = registry.route(reg, reg, what.doc_type, what.years, override).select("index_dir").distinct()
        trace.end(stage)
        routed = rows.join(chosen, "index_dir", "left_semi")
        q = self.spark.createDataFrame([(0, question)], "query_id long, q string")
        return self.search(q, routed, p or Parameters.routed(), fuse="rrf", **how), what, trace

    def answer(self, questions: DataFrame, rows: DataFrame, model: providers.ChatModel, system: str = "", per_chunk: int = 1000, p: Parameters | None = None, **how) -> tuple[DataFrame, DataFrame]:
        """Search and answer in one job: (query_id, q, answer) and the sources that the answers may quote, as `answer_sources` gives them."""
        found = self.search(questions, rows, p, **how)
        sources = rows.select("index_dir", "rid", (F.col("source_file") if "source_file" in rows.columns else F.lit(None).cast("string")).alias("source_file"))
        ready = cut(found.select("query_id", F.col("rerank_rank").alias("rank"), "id", "modal", "index_dir", "rid", "doc_id", "page", "type", "ord", F.col("restored").alias("content"), F.col("table_id").isNotNull().alias("is_table")).join(sources, ["index_dir", "rid"]))
        messages = retrieval.answer_messages(questions, ready, system, per_chunk)
        told = providers.chat(messages, "messages", "answer", model).select("query_id", "answer")
        return questions.select("query_id", "q").join(told, "query_id"), retrieval.answer_sources(ready, per_chunk)

    def expand_and_search(self, questions: DataFrame, rows: DataFrame, model: providers.ChatModel, p: Parameters | None = None, **how) -> DataFrame:
        """Each question, its phrasings and a hypothetical passage, searched in one job and merged."""
        return self.multi_route(cut(retrieval.expand_questions(questions, model).select("query_id", "route", "q")), rows, p, **how)

    def route_questions(self, questions: DataFrame, rows: DataFrame) -> DataFrame:
        """`registry.route_batch` for questions (query_id, q), with intents by rules."""
        known = intent.intents(questions, "q", self.current_year).withColumn("override", F.lit(None).cast("string"))
        docs = rows.select("doc_id", "doc_type", "year").distinct()
        reg = docs.select("doc_type", registry.year_key().alias("year_key"), F.col("doc_id").alias("index_dir"))
        return registry.route_batch(known, reg, reg)

    def multi_route(self, routes: DataFrame, rows: DataFrame, p: Parameters | None = None, **how) -> DataFrame:
        """Several phrasings of each question in one job: routes (query_id, route, q) to merged results, the first route of an id."""
        q = routes.select(F.xxhash64("query_id", "route").alias("query_id"), "q")
        names = routes.select(F.xxhash64("query_id", "route").alias("__key"), F.col("query_id").alias("__query"), "route")
        found = self.search(q, rows, p, **how).withColumnRenamed("query_id", "__key").join(names, "__key")
        ready = found.drop("q", "position").withColumnsRenamed({"__query": "query_id", "rerank_rank": "rank"})
        return retrieval.merge_routes(ready.drop("__key"))
