"""Registries of documents and indexes, and routing of questions to sub-indexes.

The registry is relational: doc_registry(doc_id, doc_type, year, quarter, source_date) and
index_registry(kind, doc_id, doc_type, year_key, index_dir, ordinal). Routing is a filter over it that a few scalars drive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import domain as dm
from tessella.session import broadcast_if_small, cut

UNKNOWN = "unknown"


def first_rows(meta: DataFrame) -> DataFrame:
    """The first row of every index_dir: the document-level metadata of the sub-index."""
    return meta.groupBy("index_dir").agg(F.min_by(F.struct("doc_id", "doc_meta"), "rid").alias("__r")).select("index_dir", F.coalesce(F.col("__r.doc_id"), "index_dir").alias("doc_id"), F.col("__r.doc_meta").alias("doc_meta"))


def document_registry(first: DataFrame, root: str = "") -> DataFrame:
    """(doc_id, doc_type, year, quarter, source_date): from the metadata, what is missing from the name and the folder."""
    from_name = dm.title_meta("doc_id")
    return first.select(
        "doc_id",
        F.coalesce("doc_meta.doc_type", dm.doc_type_of_root(F.lit(root))).alias("doc_type"),
        F.coalesce("doc_meta.year", from_name["year"]).alias("year"),
        F.coalesce("doc_meta.quarter", from_name["quarter"]).alias("quarter"),
        F.col("doc_meta.source_date").alias("source_date"),
    )


def enrich(second: DataFrame, known: DataFrame) -> DataFrame:
    """The sparse pass takes year, quarter, date and kind of the dense pass where that has them."""
    k = known.select("doc_id", *(F.col(c).alias(f"__{c}") for c in ("doc_type", "year", "quarter", "source_date")))
    return second.join(k, "doc_id", "left").select("doc_id", *(F.coalesce(f"__{c}", c).alias(c) for c in ("doc_type", "year", "quarter", "source_date")))


def year_key(year: str = "year") -> Column:
    return F.coalesce(F.col(year).cast("string"), F.lit(UNKNOWN))


def by_type_year(docs: DataFrame) -> DataFrame:
    """(doc_type, year_key, doc_ids): the sorted distinct documents of each kind and year; documents without a kind are left out.

    A view for people; routing reads the rows themselves. Distinct is taken before the lists are gathered."""
    one = docs.filter(F.col("doc_type").isNotNull()).select("doc_type", year_key().alias("year_key"), "doc_id").distinct()
    return one.groupBy("doc_type", "year_key").agg(F.count("*").alias("documents"), F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))


def index_registry(docs: DataFrame, kind: str, folder: str) -> DataFrame:
    """(kind, doc_id, doc_type, year_key, index_dir) with one sub-index for every document."""
    return docs.select(F.lit(kind).alias("kind"), "doc_id", "doc_type", year_key().alias("year_key"), F.concat(F.lit(folder + "/"), "doc_id").alias("index_dir"))


def _few(df: DataFrame, c: str, most: int = 10_000) -> set[str]:
    """The distinct values of a column that has few; more than `most` are refused (`route_batch` has no such bound)."""
    values = {r[0] for r in df.select(c).distinct().limit(most + 1).collect()}
    if len(values) > most:
        raise ValueError(f"a registry has at most {most} values of {c}")
    return values


def _present(reg: DataFrame, doc_type: str | None) -> set[str]:
    """The year keys of a kind (or of all kinds)."""
    rows = reg if doc_type is None else reg.filter(F.col("doc_type") == doc_type)
    return _few(rows.filter(F.col("doc_type").isNotNull()), "year_key")


def _kinds(reg: DataFrame) -> set[str]:
    return _few(reg.filter(F.col("doc_type").isNotNull()), "doc_type")


def dense_filter(reg: DataFrame, doc_type: str | None, years: list[int]) -> Column:
    """Sub-indexes of the dense search: kind and known years; if the years are not known, all; without a kind, all kinds of the years."""
    has_type = doc_type is not None and doc_type in _kinds(reg)
    present = _present(reg, doc_type if has_type else None)
    valid = [str(y) for y in years if str(y) in present]
    named = F.col("doc_type").isNotNull()
    if not valid:
        return named
    of_years = F.col("year_key").isin(valid)
    return named & of_years & (F.col("doc_type") == doc_type) if has_type else named & of_years


def sparse_filter(reg: DataFrame, doc_type: str | None, years: list[int]) -> Column:
    """Sub-indexes of the sparse search for one kind: those of the years; if there are none, those of the unknown year."""
    if doc_type is None or doc_type not in _kinds(reg):
        return F.lit(False)
    present = _present(reg, doc_type)
    valid = [str(y) for y in years if str(y) in present]
    return (F.col("doc_type") == doc_type) & F.col("year_key").isin(valid or [UNKNOWN])


def route(dense: DataFrame, sparse: DataFrame, doc_type: str | None, years: list[int], override: str | None = None, prefer_year: bool = True) -> DataFrame:
    """(kind, index_dir) to search. override: report, notice or both; nothing found at all means every sub-index."""
    if override in ("report", "notice"):
        doc_type = override
    elif override == "both":
        doc_type = None
    by_years = prefer_year and bool(years)
    d = dense.filter(dense_filter(dense, doc_type, years)) if by_years else dense.limit(0)
    if doc_type is not None:
        s = sparse.filter(sparse_filter(sparse, doc_type, years))
    elif by_years or override == "both":
        s = sparse.filter(sparse_filter(sparse, "report", years) | sparse_filter(sparse, "notice", years))
    else:
        s = sparse.limit(0)
    if d.isEmpty() and s.isEmpty():
        d, s = dense, sparse
    return d.select("kind", "index_dir").unionByName(s.select("kind", "index_dir")).distinct()


def build(dense_meta: DataFrame, sparse_meta: DataFrame, dense_root: str, sparse_root: str) -> tuple[DataFrame, DataFrame]:
    """The document registry and the index registry from the rows of the dense and of the sparse indexes.

    The dense pass comes first; a document that the sparse pass finds too keeps what is known of it, others are added."""
    dense, sparse = (document_registry(first_rows(m), root) for m, root in ((dense_meta, dense_root), (sparse_meta, sparse_root)))
    later = enrich(sparse, dense)
    docs = later.unionByName(dense.join(later.select("doc_id"), "doc_id", "left_anti"))
    return docs, index_registry(dense, "faiss", dense_root).unionByName(index_registry(later, "bm25", sparse_root))


#: What a question is routed to: the buckets of some kinds and years, all sub-indexes with a kind, or all.
BUCKETS, NAMED, EVERYTHING = "buckets", "named", "all"


def _buckets(reg: DataFrame) -> DataFrame:
    """(doc_type, year_key) that the registry has; few, and combined before the shuffle."""
    return reg.filter(F.col("doc_type").isNotNull()).select("doc_type", "year_key").distinct()


def route_batch(questions: DataFrame, dense: DataFrame, sparse: DataFrame, prefer_year: bool = True) -> DataFrame:
    """(query_id, kind, scope, doc_type, year_key): what each question is to be searched in, for all questions in one job.

    questions: query_id, doc_type, years (array), override (report, notice, both or null). The rules are those of `route`. Buckets
    stay buckets (of the partitions of the stored index), and `named` and `all` are one row each, so that the result does not
    grow with the sub-indexes; `routed_dirs` lists these."""
    kind = F.when(F.col("override").isin("report", "notice"), F.col("override")).when(F.col("override") == "both", None).otherwise(F.col("doc_type"))
    q = questions.select("query_id", kind.alias("kind"), F.coalesce(F.transform("years", lambda y: y.cast("string")), F.array().cast("array<string>")).alias("years"), (F.col("override") == "both").alias("both"))
    q = cut(q.withColumn("by_years", F.lit(prefer_year) & (F.size("years") > 0)))
    db, sb = cut(_buckets(dense)), cut(_buckets(sparse))
    year = q.select("query_id", "kind", "by_years", F.explode(F.array_distinct("years")).alias("year_key"))

    # dense: the buckets of the kind, or of all kinds if it is not known; without any, all that have a kind
    known = broadcast_if_small(db.select(F.col("doc_type").alias("kind"), F.lit(True).alias("known")).distinct())
    asked = year.filter("by_years").join(known, "kind", "left")
    d = asked.join(broadcast_if_small(db, True), "year_key").filter(F.col("known").isNull() | (F.col("doc_type") == F.col("kind"))).select("query_id", "doc_type", "year_key").distinct()
    d = cut(d)
    none = q.filter("by_years").select("query_id").join(d.select("query_id").distinct(), "query_id", "left_anti")
    # (a registry without any kind has no named sub-index)
    none = none.limit(0) if db.isEmpty() else none
    dense_rows = d.select("query_id", F.lit("faiss").alias("kind"), F.lit(BUCKETS).alias("scope"), "doc_type", "year_key")
    dense_rows = dense_rows.unionByName(none.select("query_id", F.lit("faiss").alias("kind"), F.lit(NAMED).alias("scope"), F.lit(None).cast("string").alias("doc_type"), F.lit(None).cast("string").alias("year_key")))

    # sparse: for each kind the buckets of the years, else that of the unknown year
    kinds = F.when(F.col("kind").isNotNull(), F.array("kind")).when(F.col("by_years") | F.coalesce("both", F.lit(False)), F.array(F.lit("report"), F.lit("notice"))).otherwise(F.array().cast("array<string>"))
    each = q.select("query_id", F.explode(kinds).alias("doc_type"), F.array_distinct("years").alias("years"))
    of_year = each.select("query_id", "doc_type", F.explode("years").alias("year_key")).join(broadcast_if_small(sb, True), ["doc_type", "year_key"])
    rest = each.select("query_id", "doc_type").join(of_year.select("query_id", "doc_type"), ["query_id", "doc_type"], "left_anti")
    unknown = rest.join(broadcast_if_small(sb.filter(F.col("year_key") == UNKNOWN)), "doc_type")
    s = of_year.select("query_id", "doc_type", "year_key").unionByName(unknown.select("query_id", "doc_type", "year_key")).distinct()
    rows = cut(dense_rows.unionByName(s.select("query_id", F.lit("bm25").alias("kind"), F.lit(BUCKETS).alias("scope"), "doc_type", "year_key")))

    lost = q.select("query_id").join(rows.select("query_id").distinct(), "query_id", "left_anti")
    both = F.explode(F.array(F.lit("faiss"), F.lit("bm25")))
    return rows.unionByName(lost.select("query_id", both.alias("kind"), F.lit(EVERYTHING).alias("scope"), F.lit(None).cast("string").alias("doc_type"), F.lit(None).cast("string").alias("year_key")))


def decisions(routed: DataFrame) -> DataFrame:
    """(query_id, strategy, buckets, fallback) of `route_batch`: year_buckets if the question has buckets, else global."""
    n = F.count_if(F.col("scope") == BUCKETS)
    return routed.groupBy("query_id").agg(F.when(n > 0, "year_buckets").otherwise("global").alias("strategy"), n.alias("buckets"), (F.count_if(F.col("scope") != BUCKETS) > 0).alias("fallback"))


def routed_dirs(routed: DataFrame, reg: DataFrame, kind: str) -> DataFrame:
    """(query_id, index_dir) of the questions that are routed to buckets: an equality join; what goes to all needs no list."""
    mine = routed.filter((F.col("kind") == kind) & (F.col("scope") == BUCKETS)).select("query_id", "doc_type", "year_key")
    return mine.join(reg.select("doc_type", "year_key", "index_dir"), ["doc_type", "year_key"]).select("query_id", "index_dir").distinct()
