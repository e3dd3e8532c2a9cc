"""Search over the indexes: dense and BM25 top-k per sub-index, fusion, dedup, rerank, context.

All operators carry `query_id`, so one job serves a whole batch of queries. Candidates have
query_id, modal, index_dir, rid, id and a score; ties go by modal (faiss first), index_dir and rid, on scores
rounded to 9 decimals. Null ids count as one id when duplicates are removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions import text as tx
from tessella.functions import vector as vec
from tessella.operators import index as ix
from tessella.operators import providers
from tessella.session import broadcast_if_small, cut, row_numbers

RRF = 60


def desc(score: str) -> Column:
    return F.round(score, 9).desc()


def ties() -> list[Column]:
    return [F.when(F.col("modal") == "faiss", 0).when(F.col("modal") == "bm25", 1).otherwise(2), F.col("index_dir"), F.col("rid")]


def blocks_of(queries: DataFrame, key: str, block: int) -> Iterator[list[Row]]:
    """A stated batch of queries, at most about `block` rows at a time."""
    n = queries.count()
    parts = -(-n // block)
    for b in range(parts):
        rows = queries.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == b).collect()
        if rows:
            yield rows


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, block: int = 2048, most: int | None = None) -> DataFrame:
    """(query_id, idx, rid, score, rank): the exact k greatest inner products per sub-index.

    most: only the `most` best rows of a query over all sub-indexes, and the least of its per-index best, which scaling needs: so
    that results do not grow with the number of sub-indexes. (If a sub-index with more than k rows is spread over tasks, the least one may
    be a row of it that is not among its k best.)

    queries: (query_id, q), held against all vectors in blocks; every task multiplies its rows with the block as
    matrices and passes on only its own k best for each (query, sub-index). vectors: (idx, rid, v)."""
    kinds = {f.name: f.dataType.simpleString() for f in [*vectors.schema, *queries.schema]}
    schema = f"query_id {kinds['query_id']}, idx {kinds['idx']}, rid {kinds['rid']}, score double"
    out = None
    for rows in blocks_of(queries.select("query_id", "q").filter("q IS NOT NULL"), "query_id", block):
        ids, matrix = np.array([r.query_id for r in rows]), np.array([r.q for r in rows], dtype=np.float64)

        def run(batches: Iterator[pd.DataFrame], ids=ids, matrix=matrix) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                v = np.stack(pdf["v"].to_numpy()).astype(np.float64) if len(pdf) else np.empty((0, matrix.shape[1]))
                found = []
                for idx, at in pdf.groupby("idx", sort=False).indices.items():
                    rid = pdf["rid"].to_numpy()[at]
                    at = at[np.argsort(rid, kind="stable")]
                    rid = pdf["rid"].to_numpy()[at]
                    for lo in range(0, len(ids), 128):
                        score = v[at] @ matrix[lo : lo + 128].T
                        best = np.argsort(-np.round(score, 9), axis=0, kind="stable")[:k]
                        n = score.shape[1]
                        part = pd.DataFrame({"query_id": np.tile(ids[lo : lo + n], len(best)), "idx": idx, "rid": rid[best.ravel()], "score": np.take_along_axis(score, best, 0).ravel()})
                        if most is None:
                            yield part
                        else:
                            found.append(part)
                            if len(found) == 64:
                                found = [_best_and_least(pd.concat(found), most)]
                if found:
                    yield _best_and_least(pd.concat(found), most)

        part = vectors.select("idx", "rid", "v").filter("v IS NOT NULL").mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], schema)
    top = vec.top_k(out, ["query_id", "idx"], [desc("score"), F.col("rid")], k, "rank")
    return top if most is None else best_and_least(top, most)


def _best_and_least(part: pd.DataFrame, most: int) -> pd.DataFrame:
    part = part.assign(r=part["score"].round(9)).sort_values(["query_id", "r", "idx", "rid"], ascending=[True, False, True, True], kind="stable")
    at = part.groupby("query_id").cumcount()
    return part[(at < most) | (at == part.groupby("query_id")["query_id"].transform("size") - 1)].drop(columns="r")


def best_and_least(df: DataFrame, most: int) -> DataFrame:
    """The `most` best rows of each query, and the one with the least score."""
    best = vec.top_k(df, ["query_id"], [desc("score"), F.col("idx"), F.col("rid")], most, "__n").drop("__n")
    least = vec.top_k(df, ["query_id"], [F.round("score", 9), F.col("idx").desc(), F.col("rid").desc()], 1, "__n").drop("__n")
    return best.unionByName(least).distinct()


#: Cells of a block of scores.
CELLS = 2_000_000
#: Rows whose scores are sorted before the rest of a group has to exceed the k-th best.
FIRST_ROWS = 64


def _encoder(vocabulary: list[str], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tokens become `t`: pairs (number of a term that is asked for, its count in the row) of 32 bits."""
    words = pa.array(vocabulary, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = max(1, len(words))
        step = max(1, min(1000, CELLS // wide))
        for batch in batches:
            out = []
            for lo in range(0, batch.num_rows, step):
                column = batch.column("tokens").slice(lo, step)
                number = pc.index_in(column.flatten(), value_set=words.cast(column.type.value_type)).fill_null(-1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(column)), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))
                count = np.bincount(row[number >= 0] * wide + number[number >= 0])
                at = np.flatnonzero(count)
                pairs = np.stack([at % wide, count[at]], axis=1).astype(np.uint32)
                out += [x.tobytes() for x in np.split(pairs, np.searchsorted(at, np.arange(1, len(column)) * wide))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema if f.name != "t"), pa.array(out, pa.binary())], names=schema.names)

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows from one head to the row before the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        lo = 0
        for at in np.flatnonzero(batch.column("head").to_numpy(zero_copy_only=False)):
            held += [batch.slice(lo, at - lo)] if at > lo else []
            if held:
                yield pa.Table.from_batches(held)
            held, lo = [], at
        held += [batch.slice(lo)] if batch.num_rows > lo else []
    if held:
        yield pa.Table.from_batches(held)


def _firsts(group: np.ndarray, n: int) -> np.ndarray:
    """Of sorted group numbers, whether a place is among the first n of its group."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, int)
    return np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)])) < n


def _best_rows(term: np.ndarray, doc: np.ndarray, weight: np.ndarray, m: int, words: int, slots: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each bag of terms, the k best of m rows: scores in units of 1e-9, scores, positions (m where there are fewer rows).

    term, doc, weight: the entries of the rows, by row. slots, lengths: the bags' terms and their number, the longest bag first."""
    bags = len(lengths)
    b9, best, at = np.full((bags, k), -np.inf), np.zeros((bags, k)), np.full((bags, k), m)
    lo = 0
    while lo < m:
        hi = min(m, lo + (max(FIRST_ROWS, CELLS // max(1, bags)) if lo else FIRST_ROWS))
        a, b = np.searchsorted(doc, (lo, hi))
        n = hi - lo
        w = np.zeros((words, n))
        w[term[a:b], doc[a:b] - lo] = weight[a:b]
        score = np.zeros((bags, n))
        step = max(256, 65536 // n)
        for c in range(0, bags, step):
            own = lengths[c : c + step]
            for j in range(own[0]):
                r = int(np.searchsorted(-own, -j))  # bags of more than j terms
                score[c : c + r] += w.take(slots[c : c + r, j], axis=0)
        s9 = np.rint(score * 1e9)
        if not lo:
            first = np.argsort(-s9, axis=1, kind="stable")[:, :k]
            own = slice(0, first.shape[1])
            b9[:, own], best[:, own], at[:, own] = np.take_along_axis(s9, first, 1), np.take_along_axis(score, first, 1), first
            lo = hi
            continue
        row, col = np.nonzero(s9 > b9[:, -1:])  # rows come by rid, so that a later one has to be better
        if len(row):
            hit = row[np.r_[True, row[1:] != row[:-1]]]
            bag, v9 = np.r_[np.repeat(hit, k), row], np.r_[b9[hit].ravel(), s9[row, col]]
            v, place = np.r_[best[hit].ravel(), score[row, col]], np.r_[at[hit].ravel(), lo + col]
            order = np.lexsort((place, -v9, bag))
            keep = order[_firsts(bag[order], k)]
            b9[hit], best[hit], at[hit] = (x[keep].reshape(-1, k) for x in (v9, v, place))
        lo = hi
    return b9, best, at


class _Pool:
    """The `most` best rows of each bag among the sub-indexes of a task, and the last one; sub-indexes come in order."""

    def __init__(self, bags: int, most: int):
        self.most, self.limit, self.rows = most, max(200_000, 2 * bags * most), 0
        self.over, self.least = np.full(bags, -np.inf), np.full(bags, np.inf)
        self.last = [np.zeros(bags), np.zeros(bags, int), np.zeros(bags, int)]  # score, position, rank
        self.kept: list[tuple[np.ndarray, ...]] = []
        self.size, self.idx, self.rid = 0, [], []

    def add(self, b9: np.ndarray, best: np.ndarray, at: np.ndarray, idx: pa.Array, rid: pa.Array) -> None:
        n = min(b9.shape[1], len(rid))
        b9, best, at = b9[:, :n], best[:, :n], at[:, :n] + self.rows
        row, col = np.nonzero(b9 > self.over[:, None])
        self.kept.append((row, b9[row, col], best[row, col], at[row, col], col + 1))
        self.size += len(row)
        lower = b9[:, -1] <= self.least
        self.least[lower] = b9[lower, -1]
        for x, y in zip(self.last, (best[:, -1], at[:, -1], np.full(len(at), n))):
            x[lower] = y[lower]
        self.rows += len(rid)
        self.idx.append(idx)
        self.rid.append(rid)
        if self.size > self.limit:
            self.reduce()

    def reduce(self) -> None:
        bag, v9, v, at, rank = map(np.concatenate, zip(*self.kept))
        order = np.lexsort((at, -v9, bag))
        keep = order[_firsts(bag[order], self.most)]
        self.kept, self.size = [tuple(x[keep] for x in (bag, v9, v, at, rank))], len(keep)
        full = keep[np.flatnonzero(_firsts(bag[keep][::-1], 1)[::-1])]  # the last of each bag
        full = full[np.bincount(bag[keep], minlength=len(self.over))[bag[full]] == self.most]
        self.over[bag[full]] = v9[full]

    def result(self) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray, np.ndarray]:
        """bag, idx, rid, score, rank"""
        self.reduce()
        bag, _, v, at, rank = self.kept[0]
        score, place, n = self.last
        other = np.flatnonzero(~np.isin(np.arange(len(place)) * self.rows + place, bag * self.rows + at))
        at = np.r_[at, place[other]]
        return np.r_[bag, other], pa.concat_arrays(self.idx).take(at), pa.concat_arrays(self.rid).take(at), np.r_[v, score[other]], np.r_[rank, n[other]]


def _searcher(numbers: np.ndarray, slots: np.ndarray, lengths: np.ndarray, words: int, k: int, most: int | None, k1: float, b: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["no", "idx", "rid", "score", "rank", "whole"]

    def rows(bag: np.ndarray, idx: pa.Array, rid: pa.Array, score: np.ndarray, rank: np.ndarray, whole: bool) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(numbers[bag]), idx, rid, pa.array(score), pa.array(rank.astype(np.int32)), pa.array(np.full(len(bag), whole))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = None if most is None else _Pool(len(numbers), most)
        for group in _groups(batches):
            first, docs = group.slice(0, 1).to_pylist()[0], group.slice(1)
            if not docs.num_rows:
                continue
            idf = np.zeros(words)
            idf[first["ids"] or []] = first["idfs"] or []
            t = docs.column("t").combine_chunks()
            term, count = np.frombuffer(b"".join(t.to_pylist()), np.uint32).reshape(-1, 2).T.astype(np.int64)
            doc = np.repeat(np.arange(len(t)), pc.binary_length(t).to_numpy(zero_copy_only=False) // 8)
            dl = docs.column("dl").to_numpy()[doc]
            weight = idf[term] * count * (k1 + 1) / (count + k1 * (1 - b + b * dl / (first["avgdl"] or 1)))
            b9, best, at = _best_rows(term, doc, weight, len(t), words, slots, lengths, k)
            idx, rid = docs.column("idx").combine_chunks(), docs.column("rid").combine_chunks()
            if pool and first["whole"]:
                pool.add(b9, best, at, idx, rid)
            else:
                bag, rank = np.nonzero(at < len(t))
                yield from rows(bag, idx.take(at[bag, rank]), rid.take(at[bag, rank]), best[bag, rank], rank + 1, first["whole"])
        if pool and pool.rows:
            yield from rows(*pool.result(), True)

    return run


def bm25_top_k(queries: DataFrame, index: ix.SparseIndex, k: int, most: int | None = None, k1: float = ix.K1, b: float = ix.B, block: int = 16384, part_rows: int = ix.PART_ROWS) -> DataFrame:
    """(query_id, idx, rid, score, rank): the k best rows per sub-index; rows without a match score 0, the least rid first.

    most: only the `most` best rows of a query over all sub-indexes, and the last one.

    Queries of the same terms (repeated terms count repeatedly) are one bag. The rows of a sub-index, or of a part of a large
    one, are held in one task against the bags, in blocks: scores of pairs of query and row are neither shuffled nor stored,
    only the k best (with most: the best of the task's sub-indexes) leave the task."""
    spark = index.tokens.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema, *index.tokens.schema]}
    terms = F.flatten(F.collect_list(tx.bm25_tokens("q")))
    asked = cut(queries.groupBy("query_id").agg(F.array_join(F.array_sort(terms), " ").alias("bag")))
    bags = cut(asked.select("bag").distinct().withColumn("no", F.monotonically_increasing_id()))
    parts = F.ceil(F.col("n") / part_rows).cast("int")
    stats = broadcast_if_small(index.stats.filter("idx IS NOT NULL").select("idx", "avgdl", parts.alias("parts")), True)
    docs = index.tokens.join(stats, "idx").select("idx", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int").alias("part"), "rid", "dl", "tokens")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    found = None
    for rows in blocks_of(bags, "no", block):
        rows.sort(key=lambda r: -len(r.bag.split()))
        split = [r.bag.split() for r in rows]
        vocabulary = sorted({t for bag in split for t in bag})
        number = {t: i for i, t in enumerate(vocabulary)}
        lengths = np.array([len(x) for x in split])
        slots = np.zeros((len(rows), max(1, lengths[0])), np.int32)
        for i, bag in enumerate(split):
            slots[i, : len(bag)] = [number[t] for t in bag]
        coded = docs.mapInArrow(_encoder(vocabulary, pa.schema([(c, pa.null()) for c in ("idx", "part", "rid", "dl", "t")])), f"idx {kinds['idx']}, part int, rid {kinds['rid']}, dl int, t binary")
        words = spark.createDataFrame(list(number.items()), "term string, id int")
        given = index.terms.join(F.broadcast(words), "term").groupBy("idx").agg(F.collect_list(F.struct("id", "idf")).alias("w"))
        heads = stats.join(given, "idx", "left").select("idx", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("head"), "avgdl", (F.col("parts") == 1).alias("whole"), F.col("w.id").alias("ids"), F.col("w.idf").alias("idfs"))
        both = coded.withColumn("head", F.lit(False)).unionByName(heads, allowMissingColumns=True)
        groups = both.repartition(tasks, "idx", "part").sortWithinPartitions("idx", "part", F.desc("head"), "rid")
        search = _searcher(np.array([r.no for r in rows]), slots, lengths, len(vocabulary), k, most, k1, b)
        part = groups.mapInArrow(search, f"no bigint, idx {kinds['idx']}, rid {kinds['rid']}, score double, rank int, whole boolean")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"query_id {kinds['query_id']}, idx {kinds['idx']}, rid {kinds['rid']}, score double, rank int")
    if most is None:
        top = vec.top_k(found, ["no", "idx"], [desc("score"), F.col("rid")], k, "rank")
    else:
        # parts of a large sub-index gave k rows each, and none is left out before its k best are known
        placed = F.row_number().over(W.partitionBy("no", "idx").orderBy(desc("score"), "rid"))
        known = found.withColumn("rank", F.when(F.col("whole"), F.col("rank")).otherwise(placed)).filter(F.col("rank") <= k)
        of = W.partitionBy("no")
        first, last = F.row_number().over(of.orderBy(desc("score"), "idx", "rid")), F.row_number().over(of.orderBy(F.round("score", 9), F.desc("idx"), F.desc("rid")))
        top = known.withColumns({"__first": first, "__last": last}).filter((F.col("__first") <= most) | (F.col("__last") == 1))
    by = broadcast_if_small(asked.join(bags, "bag").select("query_id", "no"))
    return top.join(by, "no").select("query_id", "idx", "rid", "score", "rank")


def page_filter(df: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """Rows whose page is null or within the bounds. Applied after top-k and scaling."""
    return candidate_filter(df, first=first, last=last)


def candidate_filter(df: DataFrame, doc_id: str | None = None, kind: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of the document and type asked for (a null one is another), whose page is null or within the bounds.

    Applied after top-k and scaling, so that scores and ranks keep their gaps; what is not asked for (None or empty) does not filter."""
    keep = [F.coalesce(F.col(c), F.lit("")) == v for c, v in (("doc_id", doc_id), ("type", kind)) if v]
    keep += [F.col("page").isNull() | (F.col("page") >= first)] if first is not None else []
    keep += [F.col("page").isNull() | (F.col("page") <= last)] if last is not None else []
    for condition in keep:
        df = df.filter(condition)
    return df


def blend(df: DataFrame, alpha: float, norm: str = "score_norm", out: str = "score_blend") -> DataFrame:
    """Dense scores weigh 1 - alpha, sparse ones alpha; a chunk found by both stays two candidates."""
    return df.withColumn(out, F.when(F.col("modal") == "faiss", F.lit(1 - alpha) * F.col(norm)).otherwise(F.lit(alpha) * F.col(norm)))


def modal_rank(df: DataFrame, score: str = "score_raw", out: str = "rank") -> DataFrame:
    """The 1-based rank within (query, modality)."""
    return row_numbers(df, ["query_id", "modal"], [desc(score), F.col("index_dir"), F.col("rid")], out)


def rrf(df: DataFrame, alpha: float, key: list[str], score: str = "score_raw", c: int = RRF) -> DataFrame:
    """(query_id, key, faiss_rank, bm25_rank, score_rrf): (1 - alpha) / (c + dense rank) + alpha / (c + sparse rank).

    With key index_dir and rid the two modalities never meet, as their indexes lie in different folders; with key id they do."""
    ranked = modal_rank(df.filter(F.col("modal").isin("faiss", "bm25")), score)
    both = ranked.groupBy("query_id", *key).agg(*(F.min(F.when(F.col("modal") == m, F.col("rank"))).alias(f"{m}_rank") for m in ("faiss", "bm25")))
    part = lambda w, r: F.coalesce(F.lit(w) / (c + F.col(r)), F.lit(0.0))
    return both.withColumn("score_rrf", part(1 - alpha, "faiss_rank") + part(alpha, "bm25_rank"))


def dedup(df: DataFrame, keys: list[str], order: list[Column], null_is_key: bool) -> DataFrame:
    """The first row of each key in the order; rows with a null key are all kept unless null_is_key."""
    # a row without a key is a group of its own, so that they are not gathered
    own = [] if null_is_key else [F.when(F.col(keys[-1]).isNull(), F.col(c)) for c in ("modal", "index_dir", "rid")]
    named = df.withColumns({f"__own{i}": c for i, c in enumerate(own)})
    first = vec.top_k(named, ["query_id", *keys, *(f"__own{i}" for i in range(len(own)))], order, 1, "__n")
    return first.select(df.columns)


def prune(df: DataFrame, score: str, pre_top_k: int, table_id: str = "table_id") -> DataFrame:
    """First row of each table, then the pre_top_k best, then the first row of each id, in this order (so fewer may remain)."""
    order = [desc(score), *ties()]
    one = dedup(df, [table_id], order, False)
    return dedup(vec.top_k(one, ["query_id"], order, pre_top_k, "pre_rank"), ["id"], [F.col("pre_rank")], True)


def rerank(df: DataFrame, given: DataFrame | None, top_n: int, position: str = "position") -> DataFrame:
    """The top_n documents of each query by a reranker's scores (query_id, position, rerank_score; 0-based positions).

    Items without a usable score are left out; if a query has none at all, the order stays with scores n, n - 1, ..."""
    if given is None:
        given = df.select("query_id", position).limit(0).withColumn("rerank_score", F.lit(None).cast("double"))
    usable = given.filter(F.col("rerank_score").isNotNull() & F.col(position).isNotNull()).select("query_id", position, "rerank_score")
    n = df.groupBy("query_id").agg(F.count("*").alias("__n"))
    scored = usable.select("query_id").distinct().withColumn("__some", F.lit(True))
    all_ = df.join(usable, ["query_id", position], "left").join(n, "query_id").join(scored, "query_id", "left")
    score = F.when(F.col("__some"), F.col("rerank_score")).otherwise((F.col("__n") - F.col(position)).cast("double"))
    ready = all_.withColumn("rerank_score", score).filter(F.col("rerank_score").isNotNull()).drop("__n", "__some")
    return vec.top_k(ready, ["query_id"], [desc("rerank_score"), F.col(position)], top_n, "rerank_rank")


def lexical_scores(docs: DataFrame, query: str, text: str) -> DataFrame:
    """A deterministic reranker: the share of the query's distinct tokens that a text has."""
    q, d = F.array_distinct(tx.bm25_tokens(query)), F.array_distinct(tx.bm25_tokens(text))
    return docs.withColumn("rerank_score", F.coalesce(F.size(F.array_intersect(q, d)) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0)))


def restore_context(hits: DataFrame, chunks: DataFrame, radius: int = 1) -> DataFrame:
    """`hits` with `restored`: a hit in a table gets all rows of its table, then up to `radius` neighbours on each side.

    hits: (hit_id, index_dir, doc_id, ord, table_id, content); chunks: (index_dir, doc_id, ord, table_id, row_index, content).
    Neighbours are found by equality on the at most 2 * radius positions wanted, not by a range join; an absent
    neighbour is skipped, an empty one is kept. Hits without a position stay as they are; a radius of 0 gives the base only."""
    rows = chunks.filter(F.col("table_id").isNotNull()).select("index_dir", "table_id", F.coalesce("row_index", F.lit(999999)).alias("r"), F.coalesce("ord", F.lit(999999)).alias("o"), "ord", F.col("content").alias("c"))
    wanted = hits.filter(F.col("ord").isNotNull() & F.col("table_id").isNotNull()).select("index_dir", "table_id").distinct()
    tables = rows.join(wanted, ["index_dir", "table_id"], "left_semi").groupBy("index_dir", "table_id").agg(
        F.array_sort(F.collect_list(F.struct("r", "o", "c"))).alias("__rows"), F.min("ord").alias("__lo"), F.max("ord").alias("__hi")
    )
    text = F.array_join(F.filter(F.transform("__rows", lambda x: x["c"]), lambda c: c != ""), "\n")
    base = hits.join(tables, ["index_dir", "table_id"], "left").withColumn("__base", F.when(F.col("__rows").isNotNull(), text).otherwise(F.coalesce("content", F.lit(""))))
    base = base.withColumn("__lo", F.coalesce("__lo", "ord")).withColumn("__hi", F.coalesce("__hi", "ord")).drop("__rows")
    if radius <= 0:
        return base.withColumnRenamed("__base", "restored").drop("__lo", "__hi")
    steps = F.array(*[F.lit(i) for i in range(-radius, radius + 1) if i])
    target = base.filter(F.col("ord").isNotNull()).select("hit_id", "index_dir", "doc_id", F.explode(F.transform(steps, lambda i: F.struct(i.alias("step"), F.when(i < 0, F.col("__lo") + i).otherwise(F.col("__hi") + i).alias("ord")))).alias("t")).select("hit_id", "index_dir", "doc_id", "t.step", "t.ord")
    found = target.join(chunks.select("index_dir", "doc_id", "ord", F.coalesce("content", F.lit("")).alias("c")), ["index_dir", "doc_id", "ord"])
    around = found.groupBy("hit_id").agg(F.array_sort(F.collect_list(F.struct("step", "c"))).alias("__near"))
    side = lambda before: F.transform(F.filter("__near", lambda x: x["step"] < 0 if before else x["step"] > 0), lambda x: x["c"])
    parts = F.concat(side(True), F.array("__base"), side(False))
    return base.join(around, "hit_id", "left").withColumn("restored", F.when(F.col("__near").isNull(), F.col("__base")).otherwise(F.array_join(parts, "\n\n"))).drop("__near", "__base", "__lo", "__hi")


#: Fixed value: the notice behind a context that was cut.
CUT_NOTICE = "\n\n[内容已截断，部分材料因长度限制未包含...]"
#: The prompt of an answer: before the question, between question and material, behind the material.
ANSWER_PROMPT = ("请只依据所附材料用中文回答，并在引用处注明材料编号，如 [1]。\n问题：", "\n\n材料：\n", "\n\n材料不足以回答时请直接说明；回答力求简短，要点可以分条。\n")


def answer_context(results: DataFrame, fixed_length: int | DataFrame, per_chunk: int, most: int = 120_000, margin: int = 1000) -> DataFrame:
    """(query_id, context): `[i] doc= page= type=` blocks of a query's results in rank order, cut to what the prompt leaves.

    fixed_length: of the rest of the prompt, for all queries or as (query_id, fixed_length).

    results: (query_id, rank, doc_id, page, type, content, is_table); contents of whole tables are not cut each."""
    content = F.when(F.col("is_table"), F.col("content")).otherwise(tx.truncate("content", per_chunk))
    block = F.concat(F.lit("["), "rank", F.lit("] doc="), F.coalesce("doc_id", F.lit("")), F.lit(" page="), F.coalesce(F.col("page").cast("string"), F.lit("None")), F.lit(" type="), F.coalesce("type", F.lit("")))
    lines = results.select("query_id", "rank", F.concat(F.trim(block), F.lit("\n"), F.coalesce(content, F.lit(""))).alias("line"))
    joined = lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n\n").alias("context"))
    if isinstance(fixed_length, DataFrame):
        joined = joined.join(fixed_length.select("query_id", F.col("fixed_length").alias("__fixed")), "query_id")
    else:
        joined = joined.withColumn("__fixed", F.lit(fixed_length))
    room = F.greatest(F.lit(0), F.lit(most - margin) - F.col("__fixed"))
    short = F.concat(F.left(F.col("context"), F.greatest(F.lit(0), room - 100)), F.lit(CUT_NOTICE))
    return joined.withColumn("context", F.when(F.length("context") > room, short).otherwise(F.col("context"))).drop("__fixed")


def answer_sources(results: DataFrame, per_chunk: int) -> DataFrame:
    """The material as it is quoted: query_id, ref, id, modal, doc_id, page, type (`table_full` for whole tables), ord, content, index_dir, source_file."""
    content = F.when(F.col("is_table"), F.col("content")).otherwise(tx.truncate("content", per_chunk))
    kind = F.when(F.col("is_table"), F.lit("table_full")).otherwise(F.coalesce("type", F.lit("")))
    return results.select("query_id", F.col("rank").alias("ref"), "id", F.coalesce("modal", F.lit("unknown")).alias("modal"), F.coalesce("doc_id", F.lit("")).alias("doc_id"), "page", kind.alias("type"), "ord", F.coalesce(content, F.lit("")).alias("content"), "index_dir", "source_file")


def answer_messages(questions: DataFrame, results: DataFrame, system: str, per_chunk: int, most: int = 120_000, margin: int = 1000, prompt: tuple[str, str, str] = ANSWER_PROMPT) -> DataFrame:
    """(query_id, messages): the system's and the user's message for every question (query_id, q); one without results gets no material."""
    start, between, end = prompt
    text = F.coalesce("q", F.lit(""))
    fixed = questions.select("query_id", (F.length(text) + sum(map(len, (system, *prompt)))).alias("fixed_length"))
    context = answer_context(results, fixed, per_chunk, most, margin)
    user = F.concat(F.lit(start), text, F.lit(between), F.coalesce("context", F.lit("")), F.lit(end))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return questions.select("query_id", "q").join(context, "query_id", "left").select("query_id", F.array(message("system", F.lit(system)), message("user", user)).alias("messages"))


#: Prompts for other phrasings of a question and for a passage that might answer it; a phrasing comes back as `<...>`.
REPHRASE = (
    "把下面的问题改写成一条检索语句，用同义的财务术语替换关键词，意思不变，只输出 <改写后的语句>：\n",
    "把下面的问题改写成一条检索语句，换用上位或下位的相关概念，意图不变，只输出 <改写后的语句>：\n",
    "换一种说法复述下面的问题，意图不变，只输出 <改写后的语句>：\n",
)
HYPOTHESIS = "请设想一段能够回答下面问题的报道文字，内容连贯充实，直接给出正文：\n"


def expand_questions(questions: DataFrame, model: providers.ChatModel, rephrase: tuple[str, ...] = REPHRASE, hypothesis: str | None = HYPOTHESIS) -> DataFrame:
    """(query_id, route, name, q): each question (query_id, q) as route 0, its phrasings as routes 1, 2, ... and the hypothetical
    passage as the last; what the model does not give or gives in another form is left out."""
    asks = [(0, "orig", None), *((k, f"mq_{k}", p) for k, p in enumerate(rephrase, 1)), *([(len(rephrase) + 1, "hyde", hypothesis)] if hypothesis else [])]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("route"), F.lit(n).alias("name"), F.lit(p).cast("string").alias("prompt")) for k, n, p in asks]))
    routes = questions.select("query_id", "q", each.alias("r")).select("query_id", "q", "r.*")
    message = F.array(F.struct(F.lit("user").alias("role"), F.concat("prompt", F.coalesce("q", F.lit(""))).alias("content")))
    told = providers.chat(routes.filter(F.col("prompt").isNotNull()).withColumn("messages", message), "messages", "told", providers.chat_or_none(model))
    passage = F.when(F.col("name") == "hyde", tx.non_blank("told")).otherwise(tx.non_blank(tx.angle_parts("told")))
    made = told.select("query_id", "route", "name", F.trim(passage).alias("q")).filter(F.col("q").isNotNull())
    return routes.filter(F.col("prompt").isNull()).select("query_id", "route", "name", "q").unionByName(made)


def merge_routes(results: DataFrame) -> DataFrame:
    """Results of several routes of one query, the first route (and rank) of each id; (query_id, route, rank, id)."""
    order = [F.col("route"), F.col("rank")]
    kept = dedup(results, ["id"], order, True)
    return row_numbers(kept, ["query_id"], [*order, F.col("id")], "position")
