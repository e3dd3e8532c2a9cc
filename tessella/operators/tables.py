"""HTML tables as text: grid with spans, header row, one sentence a row.

The tokenizer is Python's (a browser-like scan of tags cannot be a SQL expression); the rest is JVM side.
Defined results: null or empty HTML and HTML without a table give an empty text; bad spans count as 1.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import text as tx
from tessella.operators import providers

#: A span beyond this is read as this: such a row does not fit into a worker's memory. The standard of HTML ends at 65,534.
MAX_SPAN = 1_000_000


class _Grid(HTMLParser):
    """Rows of cells of the first table; a column span repeats the text, a row span carries it down."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.row: list[str] | None = None
        self.cell: list[str] | None = None
        self.spans = (1, 1)
        self.down: dict[int, tuple[int, str]] = {}
        self.inside, self.done = False, False

    def carried(self) -> None:
        while self.row is not None and len(self.row) in self.down:
            at = len(self.row)
            left, text = self.down.pop(at)
            self.row.append(text)
            if left > 1:
                self.down[at] = (left - 1, text)

    @staticmethod
    def span(attrs: dict[str, str | None], name: str) -> int:
        try:
            return min(MAX_SPAN, max(1, int(attrs.get(name) or 1)))
        except ValueError:
            return 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.done:
            return
        if tag == "table":
            self.inside = True
        elif self.inside and tag == "tr":
            self.end_row()
            self.row = []
            self.carried()
        elif self.inside and tag in ("td", "th"):
            self.end_cell()
            if self.row is None:
                self.row = []
            self.carried()
            a = dict(attrs)
            self.cell, self.spans = [], (self.span(a, "colspan"), self.span(a, "rowspan"))
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def end_cell(self) -> None:
        if self.cell is None or self.row is None:
            return
        text = " ".join("".join(self.cell).split())
        across, down = self.spans
        for _ in range(across):
            if down > 1:
                self.down[len(self.row)] = (down - 1, text)
            self.row.append(text)
        self.cell = None

    def end_row(self) -> None:
        self.end_cell()
        if self.row is not None:
            self.carried()
            self.rows.append(self.row)
        self.row = None

    def handle_endtag(self, tag: str) -> None:
        if self.done:
            return
        if tag in ("td", "th"):
            self.end_cell()
        elif tag == "tr":
            self.end_row()
        elif tag == "table" and self.inside:
            self.end_row()
            self.done = True

    def handle_data(self, data: str) -> None:
        if self.cell is not None and not self.done:
            self.cell.append(data)


def grid(html: str | None) -> list[list[str]]:
    """The cells of the first table, all rows of the same width."""
    p = _Grid()
    p.feed(html or "")
    p.close()
    if p.inside and not p.done:
        p.end_row()
    width = max((len(r) for r in p.rows), default=0)
    return [r + [""] * (width - len(r)) for r in p.rows if width]


def _grid_or_error(html: str | None) -> tuple[list[list[str]] | None, str | None]:
    try:
        return grid(html), None
    except Exception as e:  # noqa: BLE001 - whatever a malformed table may raise
        return None, str(e) or type(e).__name__


@F.pandas_udf(T.StructType([T.StructField("cells", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("error", T.StringType())]))
def table_grid(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_grid_or_error(h) for h in html], columns=["cells", "error"], index=html.index)


def grid_text(cells: Column) -> Column:
    """Sentences `column: value，...。` (fixed values: the signs and `列`) of the rows below the header, the first row with two cells that are not blank; columns
    without a name are 列1, 列2, ...; without a header all rows are data. Rows without a value give no line."""
    filled = lambda row: F.size(F.filter(row, lambda x: F.trim(x) != ""))
    header = F.array_position(F.transform(cells, lambda r: filled(r) >= 2), True).cast("int")
    width = F.size(F.coalesce(cells[0], F.array().cast("array<string>")))
    numbered = F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda j: F.concat(F.lit("列"), j.cast("string")))
    names = F.when(header > 0, F.zip_with(F.element_at(cells, F.greatest(header, F.lit(1))), numbered, lambda a, b: F.when(F.trim(a) != "", a).otherwise(b))).otherwise(numbered)
    data = F.slice(cells, header + 1, F.greatest(F.size(cells) - header, F.lit(0)))

    def sentence(row: Column) -> Column:
        parts = F.filter(F.zip_with(names, row, lambda n, v: F.when(F.trim(v) != "", F.concat(n, F.lit(": "), v))), lambda x: x.isNotNull())
        joined = F.array_join(parts, "，")
        return F.when(joined == "", None).when(joined.rlike(r"[。.]$"), joined).otherwise(F.concat(joined, F.lit("。")))

    return F.when(F.size(cells) < 1, F.lit("")).otherwise(F.array_join(F.transform(data, sentence), "\n"))


#: The prompt of a provider that writes a table as text; `{html}` is the table.
PROMPT = "请把下面的 HTML 表格逐行写成文字，每行一句，保留全部数值和单位，不要补充任何内容：\n{html}"


def textify_by(df: DataFrame, html: str, out: str, provider: providers.Generator, always: bool = False, earlier: Column | None = None, prompt: str = PROMPT) -> DataFrame:
    """`textify` with a provider's texts: for tables with merged cells, or for all that have no earlier text (always).

    Only these tables are sent; where the provider gives nothing or fails, the table is read without it."""
    wanted = F.lit(True) if always else tx.has_merged_cells(html)
    if earlier is not None:
        wanted = wanted & tx.non_blank(earlier).isNull()
    before, after = prompt.split("{html}")
    asked = df.withColumn("__prompt", F.when(wanted & tx.non_blank(html).isNotNull(), F.concat(F.lit(before), F.col(html), F.lit(after))))
    told = providers.generate(asked, "__prompt", "__told", providers.or_none(provider))
    if always and earlier is None:
        earlier = F.lit(None).cast("string")
    return textify(told, html, out, F.col("__told"), earlier).drop("__prompt", "__told")


def textify(df: DataFrame, html: str, out: str, other: Column | None = None, earlier: Column | None = None) -> DataFrame:
    """`df` with `out`: the text of an HTML table.

    other: the text of a provider for tables with merged cells, taken if it is not blank; earlier: a text of a former run,
    which comes first (then the provider's is taken for all tables). A table that cannot be read gives `(表格文本化失败: reason)` (a fixed value)."""
    gridded = df.withColumn("__grid", table_grid(F.coalesce(F.col(html), F.lit(""))))
    failed = F.concat(F.lit("(表格文本化失败: "), F.col("__grid.error"), F.lit(")"))
    plain = F.coalesce(failed, grid_text(F.col("__grid.cells")))
    if earlier is not None:
        text = F.coalesce(tx.non_blank(earlier), *([tx.non_blank(other)] if other is not None else []), plain)
    elif other is not None:
        text = F.when(tx.has_merged_cells(html), F.coalesce(tx.non_blank(other), plain)).otherwise(plain)
    else:
        text = plain
    return gridded.withColumn(out, text).drop("__grid")
