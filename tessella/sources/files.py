"""Reading and writing of the stages' files: OCR JSON documents, JSON lines, index tables, reports.

Defined results: unparsable documents and lines are left out (`rejects` gives them); empty folders give
empty tables where a schema is known; extra keys are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import text as tx

DOC_META = T.StructType(
    [T.StructField("source_path", T.StringType()), T.StructField("doc_type", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("quarter", T.StringType()), T.StructField("source_date", T.StringType()), T.StructField("year_source", T.StringType()), T.StructField("years_mentioned", T.ArrayType(T.IntegerType())), T.StructField("is_multi_year", T.BooleanType())]
)
TABLE = T.StructType([T.StructField("id", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("page", T.IntegerType()), T.StructField("digest", T.StringType()), T.StructField("row_index", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("parts", T.IntegerType())])
CHUNK = T.StructType([T.StructField("id", T.StringType()), T.StructField("doc_id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("order", T.IntegerType()), T.StructField("table", TABLE), T.StructField("meta", DOC_META)])
UNIT = T.StructType([T.StructField("unit_no", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("type", "page_idx", "page", "text", "content")), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("table_body", T.StringType()), T.StructField("table_text", T.StringType()), T.StructField("text_level", T.IntegerType())])
KINDS = ("text", "table", "list", "equation")


def read_documents(spark: SparkSession, path: str, suffix: str = "_content_list.json", limit: int = 0) -> DataFrame:
    """(path, doc_id, json) of every file under the folder (or the file itself) with the suffix; limit: of the first ones by path only (0 is all)."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").option("wholetext", True).text(path)
    named = raw.select(F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))").alias("path"), F.col("value").alias("json"))
    if limit > 0:
        named = named.orderBy("path").limit(limit)
    return named.select("path", tx.doc_id_of("path").alias("doc_id"), "json")


def _string(v: Any) -> str | None:
    return None if v is None or isinstance(v, (dict, list)) else v if isinstance(v, str) else str(v)


def walk(node: Any, nested: bool, found: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Nodes of an accepted type in pre-order, also inside accepted nodes (nested) or only in lists (not nested)."""
    stack = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, dict):
            if n.get("type") in KINDS:
                found.append(n)
            if nested:
                stack += [v for v in reversed(list(n.values())) if isinstance(v, (dict, list))]
        elif isinstance(n, list):
            stack += reversed(n)
    return found


def _item(i: Any) -> str | None:
    """The text of a list item: itself, or the first of its fields that is not blank."""
    if isinstance(i, str):
        return i
    fields = [i.get(k) for k in ("text", "content", "value", "raw")] if isinstance(i, dict) else []
    return next((x for x in fields if isinstance(x, str) and x.strip()), None)


def unit_of(n: dict[str, Any], no: int) -> dict[str, Any]:
    """The fields of a node; the first of text, content, value and raw that is not blank becomes the text."""
    texts = [_string(n.get(k)) for k in ("text", "content", "value", "raw")]
    items = n.get("items")
    level = n.get("text_level")
    return {
        "unit_no": no, "type": n.get("type"), "page_idx": _string(n.get("page_idx")), "page": _string(n.get("page")),
        "text": next((t for t in texts if t and t.strip()), None), "content": _string(n.get("content")),
        "items": [t for t in map(_item, items) if t] if isinstance(items, list) else None,
        "table_body": _string(n.get("table_body")), "table_text": _string(n.get("table_text")), "text_level": level if isinstance(level, int) else None if level is None else 0,
    }


def units(documents: DataFrame, nested: bool = True) -> DataFrame:
    """(doc_id, unit fields) of OCR documents. Trees of any depth are walked in key order, which a SQL variant does not keep, so in Python."""
    import json

    import pandas as pd

    names = UNIT.fieldNames()

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["json"]):
                try:
                    tree = json.loads(text)
                except (TypeError, ValueError):
                    continue
                rows += [{"doc_id": doc, **unit_of(n, k)} for k, n in enumerate(walk(tree, nested, []), 1)]
            out = pd.DataFrame(rows, columns=["doc_id", *names])
            for c in ("unit_no", "text_level"):
                out[c] = out[c].astype("Int32")
            yield out

    return documents.select("doc_id", "json").mapInPandas(run, T.StructType([T.StructField("doc_id", T.StringType()), *UNIT.fields]))


def rejects(documents: DataFrame) -> DataFrame:
    """Documents whose JSON cannot be parsed."""
    return documents.filter(F.col("json").isNull() | F.expr("try_parse_json(json)").isNull()).select("path", "doc_id")


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of all .jsonl files (also .json parts of `write_lines`) under a folder; blank and unparsable lines are left out."""
    read = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jsonl,json}").option("mode", "DROPMALFORMED")
    return read.json(path)


def read_lines_in_order(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """`read_lines` with `path` and `block`, by which records sort as the files lie: by path, then by the part of the file."""
    rows = read_lines(spark, path, schema)
    return rows.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")).orderBy("path", "block")


def line_counts(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(path, lines): lines of each file that are not blank."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    full = tx.normalize_space("value") != ""
    return raw.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count_if(full).alias("lines"))


def index_dirs(spark: SparkSession, root: str, markers: tuple[str, ...]) -> DataFrame:
    """(index_dir): folders under the root that hold a file of each of the names."""
    glob = "{" + ",".join(markers) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path")
    parts = files.select(F.regexp_extract("path", r"^(.*)/([^/]*)$", 1).alias("index_dir"), F.regexp_extract("path", r"^(.*)/([^/]*)$", 2).alias("name")).distinct()
    return parts.groupBy("index_dir").count().filter(F.col("count") == len(set(markers))).select("index_dir").orderBy("index_dir")


def read_sheet(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """(path, row, cells): the rows of a worksheet of every .xlsx file under the path, cells as text (null where blank). Sheets are small
    (questions and answers of a benchmark), so a file is read by one task."""
    import pandas as pd

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        for pdf in batches:
            rows = [(p, n, cells) for p, data in zip(pdf["path"], pdf["content"]) for n, cells in sheet_rows(data, sheet)]
            yield pd.DataFrame(rows, columns=["path", "row", "cells"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, row int, cells array<string>")


def sheet_rows(data: bytes, sheet: int = 1) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells) of a worksheet of an Office Open XML workbook: shared, inline and plain values."""
    import io
    import zipfile
    from xml.etree import ElementTree

    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{space}t"))
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        shared = [text(i) for i in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{space}si")] if "xl/sharedStrings.xml" in names else []
        for n, row in enumerate(ElementTree.fromstring(book.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{space}row"), 1):
            cells: list[str | None] = []
            for c in row.iter(f"{space}c"):
                letters = "".join(x for x in c.get("r", "") if x.isalpha())
                column = 0
                for x in letters:
                    column = column * 26 + ord(x) - 64
                while column and len(cells) < column - 1:
                    cells.append(None)
                value = c.find(f"{space}v")
                raw = value.text if value is not None else None
                cells.append(text(c) if c.get("t") == "inlineStr" else shared[int(raw)] if c.get("t") == "s" and raw else raw)
            yield int(row.get("r", n)), cells


def records(sheet: DataFrame) -> DataFrame:
    """(path, row, record): the rows below the first one of each file as maps from its cells to theirs."""
    head = sheet.filter("row = 1").select("path", F.col("cells").alias("names"))
    value = lambda n, i: F.struct(n.alias("k"), F.try_element_at(F.col("cells"), i + 1).alias("v"))
    pairs = F.filter(F.transform("names", value), lambda p: p["k"].isNotNull())
    return sheet.filter("row > 1").join(head, "path").select("path", "row", F.map_from_entries(pairs).alias("record"))


def write_candidates(df: DataFrame, path: str, score: str, most: int = 30) -> None:
    """Appends the best `most` candidates of each query to a log of JSON lines."""
    from tessella.functions import vector as vec

    vec.top_k(df, ["query_id"], [F.col(score).desc(), F.col("index_dir"), F.col("rid")], most, "place").write.mode("append").json(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table (a registry, an index), or an empty one with the schema if the folder is missing or holds no readable file."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines in UTF-8; null fields are left out. `append` makes a report that grows, with a run id of the caller."""
    df.write.mode(mode).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row as text."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def file_sizes(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, length) of files, from their listing alone."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length")


def to_upload(files: DataFrame, log: DataFrame, most: int = 10 * 1024 * 1024) -> DataFrame:
    """Files below the size limit that the log (path) does not hold."""
    return files.filter(F.col("length") < most).join(log.select("path").distinct(), "path", "left_anti")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a log as a set (path)."""
    return spark.read.text(path).select(F.trim("value").alias("path")).filter("path <> ''").distinct()
