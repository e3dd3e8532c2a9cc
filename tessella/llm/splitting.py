"""Splitting oversized texts at natural boundaries (problem 5).

Dynamic programming over boundary positions: pieces are slices of the text after white-space
normalisation; each piece has at most `max_chars` characters and starts exactly `overlap` characters
before the end of the piece before it. Among all such cuts the one with the least total of cut
penalties (paragraph < sentence < clause < space < hard cut) and squared size imbalance is taken.

Defined results: null, empty and blank texts give no piece; a text within the limit gives one piece,
equal to the normalised text; repeated rows give repeated pieces (callers that want each key once
use `dedupe_keys`); other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARAGRAPH, SENTENCE, CLAUSE, SPACE, HARD = 0, 1, 2, 3, 4
#: Cost of a cut by kind of boundary, against a squared imbalance of 1 for a piece that is empty.
PENALTY = (0.0, 0.15, 0.6, 1.5, 6.0)
NAMES = ("paragraph", "sentence", "clause", "space", "hard", "end")
_CLOSERS = "”’」』）)》】\"'"
_BOUNDARY = re.compile(
    rf"(?P<p>\n)|(?P<s>[。！？!?；;…]+[{_CLOSERS}]*|\.[{_CLOSERS}]*(?=\s|$))|(?P<c>[，、：:]|,(?!\d))|(?P<w> )"
)


def normalise(text: str) -> str:
    """White-space runs become one character: a line feed if the run has one, else a space; ends trimmed."""
    return re.sub(r"\s+", lambda m: "\n" if "\n" in m.group() else " ", text).strip()


def normalised(col) -> F.Column:
    """`normalise` as a Spark expression (JVM side)."""
    lines = F.regexp_replace(col, r"(?U)\s*\n\s*", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"(?U)[\s&&[^\n]]+", " "), r"(?U)^\s+|\s+$", "")


def _boundaries(text: str, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may lie on a best path, and their kinds.

    All natural boundaries, and every position that is less than `2 * step` away from a gap of more than `step` between
    neighbouring boundaries. No other hard cut can be on a best path: a piece advances by at most `step`, so the cut before and
    the one behind lie within `2 * step` of each other, and if all gaps there are at most `step`, one or two natural boundaries
    reach from one to the other. These cost at most two spaces and three imbalances of at most 1 each, which is no more than HARD."""
    at: dict[int, int] = {}
    for m in _BOUNDARY.finditer(text):
        kind = {"p": PARAGRAPH, "s": SENTENCE, "c": CLAUSE, "w": SPACE}[m.lastgroup]
        end = m.start() if kind in (PARAGRAPH, SPACE) else m.end()
        at[end] = min(kind, at.get(end, HARD))
    n = len(text)
    ends = np.array([0, *sorted(e for e in at if 0 < e < n), n])
    for k in np.flatnonzero(np.diff(ends) > step):
        for e in range(max(1, int(ends[k]) - 2 * step + 1), min(n, int(ends[k + 1]) + 2 * step)):
            at.setdefault(e, HARD)
    pos = np.array(sorted(e for e in at if 0 < e < n), dtype=np.int64)
    return pos, np.array([at[int(e)] for e in pos], dtype=np.int64)


def cut_points(text: str, max_chars: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, boundary kind) of each piece of an already normalised text."""
    if max_chars <= overlap or overlap < 0:
        raise ValueError("max_chars must exceed overlap, and overlap must not be negative")
    n = len(text)
    if n == 0:
        return []
    if n <= max_chars:
        return [(0, n, "end")]
    pos, kind = _boundaries(text, max_chars - overlap)
    path = best_path(n, pos, np.array(PENALTY)[kind], max_chars, overlap)[1]
    out, start = [], 0
    for j in path:
        e = int(pos[j]) if j < len(pos) else n
        out.append((start, e, NAMES[kind[j]] if j < len(pos) else "end"))
        start = e - overlap
    return out


def best_path(n: int, pos: np.ndarray, penalty: np.ndarray, max_chars: int, overlap: int) -> tuple[float, list[int]]:
    """Least cost and cuts (indexes into pos, the end last) of a text of n characters that may be cut at pos."""
    step = max_chars - overlap
    pieces = -(-(n - overlap) // step)
    ideal = (n + (pieces - 1) * overlap) / pieces
    m = len(pos)
    best = np.full(m + 1, np.inf)
    back = np.full(m + 1, -1, dtype=np.int64)
    ends = np.append(pos, n)
    cost_at = np.append(penalty, 0.0)
    first = (ends <= max_chars) & (ends > overlap)  # a shorter first piece could not share `overlap` characters
    best[first] = cost_at[first] + ((ends[first] - ideal) / ideal) ** 2
    # the piece before ends at i, so this one starts at ends[i] - overlap
    begin = ends - overlap + ideal
    lows = np.searchsorted(ends, ends - step).tolist()
    scale = 1.0 / ideal
    for j in range(1, m + 1):
        lo = lows[j]
        if lo < j:
            size = (ends[j] - begin[lo:j]) * scale
            size *= size
            size += best[lo:j]
            k = int(size.argmin())
            total = size[k] + cost_at[j]
            if total < best[j]:
                best[j], back[j] = total, lo + k
    path, j = [], m
    while j >= 0:
        path.append(j)
        j = int(back[j])
    return float(best[m]), path[::-1]


def split_oversized(df: DataFrame, key: list[str], text: str, max_chars: int = 500, overlap: int = 50, only_oversized: bool = False) -> DataFrame:
    """Pieces of every text: the key columns, piece_no (0-based), pieces, start, end, boundary, piece.

    Texts within the limit stay in the JVM; only oversized ones go through the Python operator.
    """
    rows = df.filter(F.length(text) > max_chars) if only_oversized else df  # normalising never lengthens a text
    norm = rows.select(*key, normalised(F.col(text)).alias("__t")).filter(F.length("__t") > 0)
    big = norm.filter(F.length("__t") > max_chars)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in big.select(*key).schema), "piece_no int, pieces int, start int, end int, boundary string, piece string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in enumerate(pdf["__t"]):
                cuts = cut_points(t, max_chars, overlap)
                rows += [(i, k, len(cuts), a, b, kind, t[a:b]) for k, (a, b, kind) in enumerate(cuts)]
            part = pd.DataFrame(rows, columns=["i", "piece_no", "pieces", "start", "end", "boundary", "piece"])
            keys = pdf[key].iloc[part["i"].to_numpy(dtype=np.int64)].reset_index(drop=True)
            yield pd.concat([keys, part.drop(columns="i")], axis=1)

    cut = big.mapInPandas(run, schema)
    if only_oversized:
        return cut
    small = norm.filter(F.length("__t") <= max_chars).select(*key, F.lit(0).alias("piece_no"), F.lit(1).alias("pieces"), F.lit(0).alias("start"), F.length("__t").alias("end"), F.lit("end").alias("boundary"), F.col("__t").alias("piece"))
    return small.unionByName(cut)
