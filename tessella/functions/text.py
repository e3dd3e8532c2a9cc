"""Text functions as Spark expressions (JVM side; only rare HTML entities are decoded in Arrow batches)."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Named entities that are decoded in the JVM, `&amp;` last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": "\u00a0", "&middot;": "·", "&copy;": "©", "&times;": "×", "&mdash;": "—", "&hellip;": "…", "&amp;": "&"}
#: Java regex of what may be any other entity, with or without `;`.
OTHER_ENTITY = "&(?!(?:" + "|".join(e[1:-1] for e in ENTITIES) + ");)[#a-zA-Z]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TOKEN = r"[\x{4e00}-\x{9fff}]|[A-Za-z0-9_]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_space(c: Column | str) -> Column:
    """White-space runs (Unicode) become one space, ends trimmed; null stays null."""
    return F.trim(F.regexp_replace(col(c), r"(?U)[\s\x1c-\x1f]+", " "))


def non_blank(c: Column | str) -> Column:
    """The value, or null if it is null, empty or white space only."""
    return F.when(normalize_space(c) != "", col(c))


def bm25_tokens(c: Column | str) -> Column:
    """One token for each Han character, lower-cased runs of ASCII letters, digits and `_`; all else separates.

    Only ASCII is lower-cased, and before the search: `lower` would turn other letters into ASCII ones."""
    return F.regexp_extract_all(F.translate(F.coalesce(col(c), F.lit("")), UPPER, UPPER.lower()), F.lit(TOKEN), F.lit(0))


@F.pandas_udf(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """All entities of HTML, named or numeric."""
    return texts.map(html.unescape, na_action="ignore")


def strip_html(c: Column | str) -> Column:
    """Tags become spaces, entities are decoded, white space normalised. Only texts with an entity outside of ENTITIES go to Python."""
    bare = F.regexp_replace(col(c), "<[^>]+>", " ")
    out = bare
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return normalize_space(F.coalesce(unescape(F.when(bare.rlike(OTHER_ENTITY), bare)), out))


def digest(c: Column | str) -> Column:
    """SHA-1 (hex) of the text with white space normalised."""
    return F.sha1(normalize_space(c))


def doc_id_of(path: Column | str) -> Column:
    """File name without folder and without `_content_list.json` (or any other extension)."""
    name = F.element_at(F.split(col(path), r"[/\\]"), -1)
    return F.when(name.endswith("_content_list.json"), F.regexp_replace(name, r"_content_list\.json$", "")).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def truncate(c: Column | str, limit: int) -> Column:
    """The first `limit` characters and `…`, if longer; a limit of 0 or less leaves the text."""
    if limit <= 0:
        return col(c)
    return F.when(F.length(c) > limit, F.concat(F.left(col(c), F.lit(limit)), F.lit("…"))).otherwise(col(c))


def has_merged_cells(html: Column | str) -> Column:
    """Whether any colspan or rowspan is greater than 1."""
    spans = F.regexp_extract_all(F.coalesce(col(html), F.lit("")), F.lit(r"(?i)\b(?:colspan|rowspan)\s*=\s*[\"']?\s*(\d+)"), F.lit(1))
    return F.exists(spans, lambda x: x.rlike(r"^0*(?:[2-9]|[1-9]\d)"))


def angle_parts(c: Column | str) -> Column:
    """The trimmed text of the first `<...>`, without surrounding quotes; null if there is none."""
    inside = F.regexp_extract(col(c), r"(?s)<\s*(.+?)\s*>", 1)
    return F.when(inside != "", F.regexp_replace(inside, "^[\"'“”‘’]+|[\"'“”‘’]+$", ""))


def content_of(raw: Column | str, embed: Column | str) -> Column:
    """The raw content, else the embedded text, else an empty text; empty counts as missing."""
    return F.coalesce(F.nullif(col(raw), F.lit("")), F.nullif(col(embed), F.lit("")), F.lit(""))


def page_number(page_idx: Column | str, page: Column | str) -> Column:
    """The first of the two that is a whole number (digits only)."""
    as_int = [F.when(col(p).cast("string").rlike("^[0-9]+$"), col(p).cast("string").try_cast("int")) for p in (page_idx, page)]
    return F.coalesce(*as_int)
