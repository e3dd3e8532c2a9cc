"""Chunking: packing units into chunks, document assembly, and the strategies of the chunking evaluation.

Packing is a running decision along a document that no window function can express. Only the lengths
(and flags) of the units cross to Python, as small arrays, and only slices of unit numbers come back;
the texts stay in the JVM and are joined there. A document's units are the natural group.

Defined results: null or blank units are skipped; documents without units give no chunks; extra columns
are not carried; repeated rows of a (document, position) must be removed before (`latest_by_key`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tessella.functions import text as tx
from tessella.functions import vector as vec
from tessella.session import broadcast_if_small

#: A slice of units (start, n); of a unit that is cut, the characters from `begin` on, `length` of them.
Slice = tuple[int, int, int, int]
SLICES = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "n", "begin", "length")]))


def hard_split(i: int, length: int, most: int) -> list[Slice]:
    return [(i, 1, b, min(most, length - b)) for b in range(0, length, most)]


def greedy_slices(lengths: list[int], most: int) -> list[Slice]:
    """Units are joined by a line feed as long as the chunk keeps to `most`; a longer unit is a chunk of its own."""
    out: list[Slice] = []
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if n > most:
            if size:
                out.append((start, i - start, 0, 0))
            out.append((i, 1, 0, 0))
            start, size = i + 1, 0
        elif size and size + 1 + n > most:
            out.append((start, i - start, 0, 0))
            start, size = i, n
        else:
            size += n + (1 if size else 0)
    if size:
        out.append((start, len(lengths) - start, 0, 0))
    return out


def strategy_slices(lengths: list[int], most: int, overlap: int | None = None, breaks: list[bool] | None = None, twice: bool = False) -> list[Slice]:
    """The three evaluated strategies: line feeds do not count; a longer unit is cut hard.

    overlap: a new chunk starts with the fewest last units that reach it (at least one); breaks: a chunk ends before such
    a unit; twice: oversize parts come once more in front, as one known implementation gives them."""
    out: list[Slice] = []
    start, size, i = 0, 0, 0
    for i, n in enumerate(lengths):
        held = i > start
        if n > most:
            if held:
                out.append((start, i - start, 0, 0))
            out += hard_split(i, n, most)
            start, size = i + 1, 0
        elif size + n > most or (breaks is not None and breaks[i] and held):
            if held:
                out.append((start, i - start, 0, 0))
            size = 0
            back = i
            while overlap is not None and back > start:
                back -= 1
                size += lengths[back]
                if size >= overlap:
                    break
            start, size = back, size + n
        else:
            size += n
    if start < len(lengths):
        out.append((start, len(lengths) - start, 0, 0))
    if twice:
        out = [s for j, n in enumerate(lengths) if n > most for s in hard_split(j, n, most)] + out
    return out


def slicer(fold: Callable[..., list[Slice]], **fixed: object) -> Callable[..., Column]:
    """The fold as an Arrow function from arrays (lengths and, if given, breaks) to slices."""

    @F.pandas_udf(SLICES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lengths in batches:
            yield pd.Series([fold([int(n) for n in x], **fixed) for x in lengths])

    @F.pandas_udf(SLICES)
    def run_breaks(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lengths, breaks in batches:
            yield pd.Series([fold([int(n) for n in x], breaks=[bool(v) for v in b], **fixed) for x, b in zip(lengths, breaks)])

    return lambda lengths, breaks=None: run(lengths) if breaks is None else run_breaks(lengths, breaks)


def slice_text(units: Column, s: Column) -> Column:
    """The text of a slice of an array of texts."""
    return F.when(s["length"] > 0, F.substring(units[s["start"]], s["begin"] + 1, s["length"])).otherwise(F.array_join(F.slice(units, s["start"] + 1, s["n"]), "\n"))


def by_document(units: DataFrame, doc: str, order: str, fields: list[str]) -> DataFrame:
    """(doc, units): the units of each document in order, as structs."""
    return units.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("units"))


def latest_by_key(df: DataFrame, key: list[str], version: str) -> DataFrame:
    """One row per key, that with the greatest version (last write wins); combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(version).isNotNull(), version)).alias("__row")).select(*key, "__row.*").select(*df.columns)


def latest_of_repeated(df: DataFrame, key: str, version: str) -> DataFrame:
    """The same rows as `latest_by_key`, where few keys are repeated: only keys and the rows of repeated ones are shuffled."""
    again = broadcast_if_small(df.groupBy(key).count().filter(F.col("count") > 1).select(key).filter(F.col(key).isNotNull()))
    several = df.join(again, key, "left_semi").select(df.columns).unionByName(df.filter(F.col(key).isNull()))
    return df.filter(F.col(key).isNotNull()).join(again, key, "left_anti").select(df.columns).unionByName(latest_by_key(several, [key], version))


def unit_text() -> Column:
    """The text of an OCR unit: the items of a list joined by `；`, else the first of text and content that is not blank."""
    items = F.array_join(F.filter(F.transform("items", tx.normalize_space), lambda x: x != ""), "；")
    plain = tx.normalize_space(F.coalesce(tx.non_blank("text"), tx.non_blank("content"), F.lit("")))
    return F.when(F.col("type") == "list", F.coalesce(F.nullif(items, F.lit("")), plain)).otherwise(plain)


def eval_unit_text() -> Column:
    """The text of a unit in the chunking evaluation: items joined by `；`, else text, table_text or content (the first not empty)."""
    items = F.coalesce(F.array_join(F.transform("items", tx.normalize_space), "；"), F.lit(""))
    first = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("text", "table_text", "content")), F.lit(""))
    return F.when(F.col("type") == "list", items).otherwise(tx.normalize_space(first))


KINDS = ("text", "table", "list", "equation")


def assemble(units: DataFrame, mode: str, most: int = 500, table_most: int = 4000, doc: str = "doc_id", order: str = "unit_no") -> DataFrame:
    """The chunks of OCR documents: runs of other units between tables are packed, tables give a chunk for each
    row of their text (mode `rows`) or their HTML, in two parts if it is longer than `table_most` (mode `html`).

    Gives id, doc_id, type, page, content, ord (1-based through the document) and tbl (id, seq, page, digest, row_index, part, parts)."""
    if mode not in ("rows", "html"):
        raise ValueError("mode is rows or html")
    kept = units.filter(F.col("type").isin(*KINDS)).withColumn("page", tx.page_number("page_idx", "page"))
    w = W.partitionBy(doc).orderBy(order)
    is_table = F.col("type") == "table"
    source = "table_text" if mode == "rows" else "table_body"
    placed = kept.withColumn("seq", F.sum(is_table.cast("int")).over(w)).withColumn("body", F.when(is_table, F.coalesce(F.col(source), F.lit(""))).otherwise(unit_text()))

    # runs of units between tables (gaps and islands): the island is the number of tables before
    runs = placed.filter(~is_table & (F.col("body") != "")).groupBy(doc, "seq").agg(F.array_sort(F.collect_list(F.struct(order, "page", "body"))).alias("units"))
    fold = slicer(greedy_slices, most=most)
    packed = runs.withColumn("slices", fold(F.transform("units", lambda u: F.length(u["body"])))).select(doc, "seq", "units", F.posexplode("slices").alias("k", "s"))
    part = F.slice("units", F.col("s.start") + 1, F.col("s.n"))
    page = F.try_element_at(F.filter(F.transform(part, lambda u: u["page"]), lambda p: p.isNotNull()), F.lit(1))
    text = packed.select(doc, (F.col("seq") * 2 + 1).alias("place"), F.col("k").alias("sub"), F.lit("text").alias("type"), page.alias("page"), F.array_join(F.transform(part, lambda u: u["body"]), "\n").alias("content"), F.lit(True).alias("counted"), F.lit(None).cast("int").alias("seq"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("int").alias("row_index"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("int").alias("parts"))

    tables = placed.filter(is_table).withColumn("digest", tx.digest("body"))
    common = [doc, (F.col("seq") * 2).alias("place")]
    if mode == "rows":
        lines = F.filter(F.transform(F.split("body", "\n"), tx.normalize_space), lambda x: x != "")
        rows = tables.select(*common, F.posexplode(lines).alias("sub", "content"), "page", "seq", "digest")
        cut = rows.select(doc, "place", "sub", F.lit("table_row").alias("type"), "page", "content", F.lit(False).alias("counted"), "seq", "digest", (F.col("sub") + 1).alias("row_index"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("int").alias("parts"))
    else:
        size = F.length("body")
        half = F.floor(size / 2).cast("int")
        bodies = F.when(tx.normalize_space("body") == "", F.array().cast("array<string>")).when(size <= table_most, F.array("body")).otherwise(F.array(F.substring(F.col("body"), F.lit(1), half), F.substring(F.col("body"), half + 1, size)))
        rows = tables.select(*common, F.posexplode(bodies).alias("sub", "content"), "page", "seq", "digest", F.when(size <= table_most, 1).otherwise(2).alias("parts"))
        cut = rows.select(doc, "place", "sub", F.lit("table").alias("type"), "page", "content", F.lit(True).alias("counted"), "seq", "digest", F.lit(None).cast("int").alias("row_index"), (F.col("sub") + 1).alias("part"), "parts")

    through = W.partitionBy(doc).orderBy("place", "sub")
    every = text.unionByName(cut).withColumn("ord", F.row_number().over(through)).withColumn("idx", F.sum(F.col("counted").cast("int")).over(through))
    at = F.when(F.col("page").isNotNull(), F.concat(F.lit("#p"), "page")).otherwise("")
    name = F.when(F.col("type") == "table_row", F.concat(F.lit("#t"), "seq", F.lit("#r"), "row_index")).otherwise(F.concat(F.lit("#c"), "idx"))
    table_id = F.concat(F.col(doc), F.when(F.col("page").isNotNull(), F.concat(F.lit("::p"), "page")).otherwise(""), F.lit("::t"), "seq")
    tbl = F.when(F.col("seq").isNotNull(), F.struct(table_id.alias("id"), "seq", "page", "digest", "row_index", "part", "parts"))
    return every.select(F.concat(F.col(doc), at, name).alias("id"), F.col(doc).alias("doc_id"), "type", "page", "content", "ord", tbl.alias("tbl"))


def tables_index(units: DataFrame, mode: str, doc: str = "doc_id", order: str = "unit_no") -> DataFrame:
    """One row per table: id, doc_id, page, seq, table_text, table_body, digest of the text (rows) or the HTML (html)."""
    w = W.partitionBy(doc).orderBy(order)
    t = units.filter(F.col("type") == "table").withColumn("page", tx.page_number("page_idx", "page")).withColumn("seq", F.row_number().over(w))
    at = F.when(F.col("page").isNotNull(), F.concat(F.lit("::p"), "page")).otherwise("")
    body = F.coalesce(F.col("table_text" if mode == "rows" else "table_body"), F.lit(""))
    return t.select(F.concat(F.col(doc), at, F.lit("::t"), "seq").alias("id"), F.col(doc).alias("doc_id"), "page", "seq", "table_text", "table_body", tx.digest(body).alias("digest"))


#: Chunking strategies by name: from (most, overlap, twice) to a function of the arrays of lengths and of breaks that gives slices.
STRATEGIES: dict[str, Callable[[int, int, bool], Callable[[Column, Column], Column]]] = {}


def strategy(name: str) -> Callable:
    """Registers a strategy under a name."""

    def add(build: Callable) -> Callable:
        STRATEGIES[name] = build
        return build

    return add


@strategy("length")
def _by_length(most: int, overlap: int, twice: bool) -> Callable[[Column, Column], Column]:
    run = slicer(strategy_slices, most=most, overlap=overlap)
    return lambda lengths, breaks: run(lengths)


@strategy("level")
@strategy("semantic")
def _by_breaks(most: int, overlap: int, twice: bool) -> Callable[[Column, Column], Column]:
    return slicer(strategy_slices, most=most, twice=twice)


def strategy_chunks(units: DataFrame, doc: str, order: str, text: str, strategy: str, most: int = 800, overlap: int = 100, breaks: str | None = None, twice: bool = False, failed: str | None = None) -> DataFrame:
    """(doc, no, id, content) of a strategy of `STRATEGIES`: `length` (with overlap), `level` and `semantic` (a chunk ends before units where
    `breaks` is true), or a registered one.

    failed: a column that is true where a unit's embedding failed; a document with such a unit is chunked by length."""
    if strategy not in STRATEGIES:
        raise ValueError(f"the strategy is one of {', '.join(STRATEGIES)}")
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c else F.lit(False)
    kept = units.filter(F.col(text) != "").select(doc, order, F.col(text).alias("body"), flag(breaks).alias("brk"), flag(failed).alias("bad"))
    docs = by_document(kept, doc, order, ["body", "brk", "bad"]).withColumn("bodies", F.transform("units", lambda u: u["body"]))
    lengths, ends = F.transform("bodies", F.length), F.transform("units", lambda u: u["brk"])
    slices = STRATEGIES[strategy](most, overlap, twice)(lengths, ends)
    if failed:
        slices = F.when(F.exists("units", lambda u: u["bad"]), STRATEGIES["length"](most, overlap, twice)(lengths, ends)).otherwise(slices)
    cut = docs.withColumn("slices", slices).select(doc, F.posexplode(F.transform("slices", lambda s: slice_text(F.col("bodies"), s))).alias("no", "content"))
    return cut.select(doc, "no", F.concat(F.col(doc).cast("string"), F.lit("_"), "no").alias("id"), "content")


def semantic_breaks(units: DataFrame, doc: str, order: str, embedding: str, threshold: float = 0.6) -> DataFrame:
    """`units` with `split_here`: the cosine to the unit before in the document is below the threshold (zero vectors never split)."""
    before = F.lag(embedding).over(W.partitionBy(doc).orderBy(order))
    known = (vec.norm(before) > 0) & (vec.norm(embedding) > 0)
    return units.withColumn("split_here", F.coalesce(known & (vec.dot(before, embedding) / (vec.norm(before) * vec.norm(embedding)) < threshold), F.lit(False)))
