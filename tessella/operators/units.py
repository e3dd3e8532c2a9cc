"""Quantities recorded in different units: every figure of a known measure in its common unit (problem 2).

Figures are read from textified tables (`header: label，header: cell。` lines) and running text. A device is a
company: all its figures of one measure, in order of time, are one series of a hidden Markov model whose hidden state is the
unit. A unit stated at the figure, else in its label or column, else for the table, else for the document is an observation
of near-certain weight; the rest is the jump of the value in log10 against the figure before, the change of the unit, and, where no
unit is stated, the distance to the smooth level of the measure over all stated figures. Every figure's unit is the one on
the Viterbi path (`decode_units`).

Statements for a whole document hold for the rows after them. They are carried along documents in
blocks of unit numbers, so that a document with very many rows is no hot group.

Defined results: null texts and cells without a figure (n/a signs, blanks) give nothing; bracketed
figures are negative in money columns; values that are not whole are rounded half up; equal values of one measure
in a record come once; repeated rows count once; a table without measures gives no rows; a figure without any stated unit, level
or neighbour takes the least unit.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tessella.session import cut, once_each, salted_join

# Units of each dimension as multiples of the common unit (money 元, energy 千瓦时, mass 千克, area 平方米,
# power 千伏安, time 小时, ratio 基点, length 米), as written after NFKC.
UNITS: dict[str, dict[str, int]] = {
    "money": {"元": 1, "圆": 1, "千元": 10**3, "万元": 10**4, "百万元": 10**6, "千万元": 10**7, "亿元": 10**8, "thousand": 10**3, "million": 10**6, "mn": 10**6, "billion": 10**9, "bn": 10**9},
    "energy": {"千瓦时": 1, "度": 1, "kwh": 1, "万千瓦时": 10**4, "万度": 10**4, "兆瓦时": 10**3, "mwh": 10**3, "吉瓦时": 10**6, "gwh": 10**6, "亿千瓦时": 10**8, "亿度": 10**8},
    "mass": {"千克": 1, "公斤": 1, "kg": 1, "吨": 10**3, "t": 10**3, "千吨": 10**6, "万吨": 10**7},
    "area": {"平方米": 1, "m2": 1, "万平方米": 10**4, "万m2": 10**4, "公顷": 10**4, "ha": 10**4, "平方公里": 10**6, "平方千米": 10**6, "km2": 10**6},
    "power": {"千伏安": 1, "kva": 1, "兆伏安": 10**3, "mva": 10**3, "万千伏安": 10**4, "万kva": 10**4, "吉伏安": 10**6, "gva": 10**6},
    "time": {"小时": 1, "h": 1, "天": 24, "日": 24, "日历天": 24, "周": 168},
    "ratio": {"基点": 1, "个基点": 1, "bp": 1, "bps": 1, "‰": 10, "%": 100, "以小数列示": 10**4},
    "length": {"米": 1, "m": 1, "千米": 10**3, "公里": 10**3, "km": 10**3, "万米": 10**4, "万公里": 10**7},
}
#: Chinese numerals of amounts in words.
DIGITS = {c: i for i, c in enumerate("零壹贰叁肆伍陆柒捌玖")} | {"〇": 0, "两": 2}
PLACES = {"拾": 10, "佰": 100, "仟": 1000}

_UNIT_OF = {(d, u): f for d, us in UNITS.items() for u, f in us.items()}
_ANY_UNIT = "|".join(re.escape(u) for u in sorted({u for us in UNITS.values() for u in us}, key=len, reverse=True))
_MONEY_UNIT = "|".join(re.escape(u) for u in sorted(UNITS["money"], key=len, reverse=True))
_NUMBER = r"(?:\d{1,3}(?:,\d{3})+(?!\d)|\d+)(?:\.\d+)?"
_WORDS = "零〇两壹贰叁肆伍陆柒捌玖拾佰仟万亿"
_FIGURE = re.compile(
    rf"(?P<open>\()?\s*(?P<minus>-|负)?\s*(?:(?P<words>(?:人民币)?[{_WORDS}]{{2,}}[元圆](?:整|正)?)"
    rf"|(?P<yi>{_NUMBER})\s*亿\s*(?P<wan>{_NUMBER})\s*万\s*元(?:人民币)?"
    rf"|(?P<currency>RMB|CNY|¥|人民币)?\s*(?P<minus2>-)?\s*(?P<number>{_NUMBER})\s*(?P<close>\))?\s*(?:\(?(?P<unit>(?:人民币)?(?:{_ANY_UNIT}))(?:人民币)?(?![A-Za-z])\)?)?)",
    re.I,
)
#: What may stand between a measure's name and its figure, and between a figure and the prior one.
_LINK = re.compile(r"\s*(?:为|是|达到?|:|由|从|=)?\s*")
_PRIOR = re.compile(r"\s*(?:变为|变至|增至|降至|\(\s*(?:上期|上年同期|去年)\s*:?|,\s*(?:上年同期|去年同期|去年|上期|上年)\s*为?|,\s*较\s*(?:上期|上年同期|去年同期|去年|上年)?的?)\s*")
#: Inline notation that may surround a name in running text.
_MARKS = re.compile(r"\*\*|__|`|'{2,5}|\[\[(?:[^\[\]|]*\|)?|\]\]|\]\([^()\s]*\)|\[|\\[A-Za-z]+\*?\{|(?<!\\)[{}]")
_OPENING = "除另有说明|除特别说明|若非特别标注|如无特别(?:注明|说明|标注)|本文件所列"
_DOC = re.compile(rf"(?:{_OPENING})[^。;\n]*?(?:以|按|单位[为:])\s*(?:人民币)?({_MONEY_UNIT})")
_TABLE = re.compile(rf"(?:金额|计量|下列金额|货币)?单位\s*(?:为|:|\s)\s*(?:人民币)?({_MONEY_UNIT})(?:人民币)?")
_CELLS = re.compile(r",(?=[^,:]+: )")
_RATE = re.compile(r"增减|变动|同比|环比|增长|幅度|change|growth", re.I)


def norm(text: str) -> str:
    """NFKC; white-space runs within a line become one space."""
    return re.sub(r"[^\S\n]+", " ", unicodedata.normalize("NFKC", text)).replace("−", "-").replace("–", "-")


def words_value(text: str) -> int:
    """The amount of Chinese numerals such as 捌亿柒仟壹佰壹拾万元整."""
    total = section = digit = 0
    for c in text:
        if c in DIGITS:
            digit = DIGITS[c]
        elif c in PLACES:
            section += (digit or 1) * PLACES[c]
            digit = 0
        elif c == "万":
            total += (section + digit) * 10**4
            section = digit = 0
        elif c == "亿":
            total = (total + section + digit) * 10**8
            section = digit = 0
    return total + section + digit


def factor_of(unit: str | None, dimension: str) -> int | None:
    """The factor of a unit as written, None if it is no unit of the dimension."""
    if not unit:
        return None
    u = re.sub(r"\s|人民币|RMB|CNY", "", unit, flags=re.I).lower()
    return _UNIT_OF.get((dimension, u)) or _UNIT_OF.get((dimension, u.removeprefix("个")))


class Figure:
    """A raw number with the factor of its unit, if stated, and the position behind it."""

    __slots__ = ("raw", "factor", "end")

    def __init__(self, raw: Decimal, factor: int | None, end: int):
        self.raw, self.factor, self.end = raw, factor, end


def figure(text: str, pos: int, dimension: str, brackets: bool) -> Figure | None:
    """The figure that starts at pos; brackets: a bracketed figure is negative."""
    m = _FIGURE.match(text, pos)
    if not m:
        return None
    sign = -1 if m["minus"] or m["minus2"] else 1
    if m["words"]:
        return Figure(Decimal(sign * words_value(m["words"])), 1, m.end()) if dimension == "money" else None
    if m["yi"]:
        raw = Decimal(m["yi"].replace(",", "")) * 10**8 + Decimal(m["wan"].replace(",", "")) * 10**4
        return Figure(sign * raw, 1, m.end()) if dimension == "money" else None
    raw = Decimal(m["number"].replace(",", ""))
    if m["open"]:
        if not (brackets and m["close"]):
            return None
        sign = -1
    factor, end = factor_of(m["unit"], dimension), m.end()
    if m["unit"] and factor is None:  # some other unit: the figure is of something else
        return None
    if not m["unit"]:
        end = m.end("close") if m["open"] else m.end("number")
        if m["currency"] and dimension == "money":
            factor = 1
    return Figure(sign * raw, factor, end)


#: States of each dimension: the log10 of its factors, in ascending order of the factors, padded to one width.
FACTORS = {d: sorted(set(us.values())) for d, us in UNITS.items()}
WIDTH = max(map(len, FACTORS.values()))
#: Costs (negative log-likelihoods up to a constant): another unit than the stated one, a change of unit, the greatest cost of
#: a jump of the value, and the variance of jumps in log10. A wrong stated unit costs more than both jumps at a figure can
#: save, so that a stated unit always holds.
STATED, CHANGE, JUMP_MOST, JUMP_VARIANCE, NEVER = 64.0, 0.7, 8.0, 0.25, 1e18


def state_table(dimensions: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(log10 of the factors, whether the state exists) of each dimension, padded to WIDTH."""
    logs, real = np.zeros((len(dimensions), WIDTH)), np.zeros((len(dimensions), WIDTH), bool)
    for i, d in enumerate(dimensions):
        n = len(FACTORS[d])
        logs[i, :n], real[i, :n] = np.log10(np.array(FACTORS[d], float)), True
    return logs, real


def emissions(x: np.ndarray, stated: np.ndarray, logs: np.ndarray, real: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Cost of each state at each figure. x: log10 of the raw numbers (NaN for 0); stated: the state that is stated, or -1;
    mean and spread: the level of the measure in log10 (NaN if unknown), which weighs where no unit is stated."""
    far = ((x[:, None] + logs - mean[:, None]) / np.maximum(spread, 0.3)[:, None]) ** 2 / 2
    cost = np.where(stated[:, None] >= 0, np.where(np.arange(WIDTH) == stated[:, None], 0.0, STATED), np.nan_to_num(far, nan=0.0))
    return np.where(real, cost, NEVER)


def _moves(x: np.ndarray, logs: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Cost of each move from the state of the figure before i (axis 1) to that of i (axis 2)."""
    jump = (x[i] - x[i - 1])[:, None, None] + logs[i][:, None, :] - logs[i - 1][:, :, None]
    return np.nan_to_num(np.minimum(JUMP_MOST, jump**2 / (2 * JUMP_VARIANCE)), nan=0.0) + CHANGE * (1 - np.eye(WIDTH))


def viterbi(x: np.ndarray, cost: np.ndarray, logs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The states of the least costly path through each series; the series lie one after another and begin at `starts`.

    All series take a step at once, the longest first in the arrays, so that a step is a few array operations."""
    size = np.diff(np.append(starts, len(x)))
    order = np.argsort(-size, kind="stable")
    first, size = starts[order], size[order]
    now, back = cost[first].copy(), np.zeros((len(x), WIDTH), np.int8)
    for t in range(1, int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -t))  # series that are longer than t
        i = first[:n] + t
        total = now[:n, :, None] + _moves(x, logs, i)
        back[i] = total.argmin(1)
        now[:n] = total.min(1) + cost[i]
    states = np.zeros(len(x), np.int64)
    states[first + size - 1] = now.argmin(1)
    for t in range(int(size[0]) - 1 if len(size) else 0, 0, -1):
        n = int(np.searchsorted(-size, -t))
        i = first[:n] + t
        states[i - 1] = back[i, states[i]]
    return states


def transfer(x: np.ndarray, cost: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Least cost of the paths through one part of a series, from each first state to each last state."""
    m = np.where(np.eye(WIDTH, dtype=bool), cost[0], NEVER)
    for i in range(1, len(x)):
        m = (m[:, :, None] + _moves(x, logs, np.array([i]))).min(1) + cost[i]
    return m


def link_parts(parts: list[tuple[np.ndarray, float, float]], logs: np.ndarray) -> list[tuple[int, int]]:
    """First and last state of each part of one series on the best path through all of them.

    parts: (transfer costs, log10 of the first raw number, of the last one), in order; logs: of the series' states."""
    total, froms, ends = parts[0][0], [], [parts[0][0].argmin(0)]
    now = total.min(0)
    for (_, _, last), (m, first, _) in zip(parts, parts[1:]):
        enter = now[:, None] + _moves(np.array([last, first]), np.stack([logs, logs]), np.array([1]))[0]
        froms.append(enter.argmin(0))  # by first state of this part: the last state of the part before
        through = enter.min(0)[:, None] + m
        ends.append(through.argmin(0))  # by last state of this part: its first state
        now = through.min(0)
    out, last = [], int(now.argmin())
    for k in range(len(parts) - 1, -1, -1):
        first = int(ends[k][last])
        out.append((first, last))
        if k:
            last = int(froms[k - 1][first])
    return out[::-1]


def decode(raws: list[Decimal], stated: list[int | None], dimension: str, level: tuple[float, float] | None) -> list[int]:
    """The factors along one series of figures, in reading order."""
    logs, real = (np.repeat(a, len(raws), 0) for a in state_table([dimension]))
    x = np.array([math.log10(abs(r)) if r else np.nan for r in raws])
    s = np.array([FACTORS[dimension].index(f) if f else -1 for f in stated])
    mean, spread = (np.full(len(raws), v) for v in level or (np.nan, np.nan))
    return [FACTORS[dimension][k] for k in viterbi(x, emissions(x, s, logs, real, mean, spread), logs, np.array([0]))]


class Measures:
    """The measures by name; recognises them at the start of a label and in running text."""

    def __init__(self, rows: list[tuple[int, str, str, str]]):
        self.of: dict[str, tuple[int, str]] = {}
        patterns = []
        for i, zh, en, dimension in rows:
            for name in (zh, en):
                if not name:
                    continue
                n = unicodedata.normalize("NFKC", name).lower()
                self.of[re.sub(r"\s+", "", n)] = (i, dimension)
                chars = r"\s*".join(re.escape(c) for c in re.sub(r"\s+", "", n)) if not n.isascii() else r"\s+".join(map(re.escape, n.split()))
                patterns.append(chars if not n.isascii() else rf"(?<![A-Za-z]){chars}(?![A-Za-z])")
        patterns.sort(key=len, reverse=True)
        self.name = re.compile("|".join(patterns) or r"(?!)", re.I)

    def get(self, written: str) -> tuple[int, str]:
        return self.of[re.sub(r"\s+", "", written.lower())]


Found = list[tuple[int, str, Decimal, int | None]]


def from_table(text: str, measures: Measures, before: int | None, document: int | None) -> Found:
    """(measure, dimension, raw, factor or None) of the figures of a textified table, in reading order."""
    table, out = before, []
    for line in norm(text).split("\n"):
        line = line.strip().rstrip("。.")
        cells = [c.split(": ", 1) for c in _CELLS.split(line)] if ": " in line else []
        if len(cells) < 2 or any(len(c) < 2 for c in cells):
            m = _TABLE.search(line)
            if m:
                table = factor_of(m[1], "money")
            continue
        label = _MARKS.sub("", cells[0][1]).strip()
        m = measures.name.match(label)
        if not m:
            continue
        measure, dimension = measures.get(m.group())
        rest = re.sub(r"\$[^$]*\$|\\\(.*?\\\)|[*†#]+$", "", label[m.end() :]).strip(" *")
        unit = re.fullmatch(rf"[(/,\[]?\s*((?:人民币)?(?:{_ANY_UNIT})(?:人民币)?)\s*[)\]]?", rest, re.I) if rest else None
        if rest and not unit:
            continue  # another indicator that begins alike
        own = factor_of(unit[1], dimension) if unit else None
        for head, cell in cells[1:]:
            if "单位" in head:
                own = own or factor_of(cell.strip(), dimension)
        for head, cell in cells[1:]:
            if "单位" in head or _RATE.search(head):
                continue
            cell = _MARKS.sub("", cell).strip()
            fig = figure(cell, 0, dimension, dimension == "money")
            if fig is None or cell[fig.end :].strip(" )。*"):
                continue
            column = re.search(rf"[(/]\s*((?:人民币)?(?:{_ANY_UNIT})(?:人民币)?)\s*\)?$", head, re.I)
            column = factor_of(column[1], dimension) if column else None
            general = (table or document) if dimension == "money" else None
            out.append((measure, dimension, fig.raw, fig.factor or own or column or general))
    return out


def from_text(text: str, measures: Measures, document: int | None) -> Found:
    """The same for running text: a name, its figure, and the prior figure if one follows."""
    text = re.sub(r"\\([%&#_$])", r"\1", _MARKS.sub("", norm(text)))
    stated = [(m.end(), factor_of(m[1], "money")) for m in _TABLE.finditer(text)]
    stated += [(m.end(), factor_of(m[1], "money")) for m in _DOC.finditer(text)]
    stated.sort()
    out = []
    for m in measures.name.finditer(text):
        measure, dimension = measures.get(m.group())
        general = None
        if dimension == "money":
            general = next((f for at, f in reversed(stated) if at <= m.start()), document)
        fig = figure(text, _LINK.match(text, m.end()).end(), dimension, dimension == "money")
        if fig is None:
            continue
        out.append((measure, dimension, fig.raw, fig.factor or general))
        link = _PRIOR.match(text, fig.end)
        prior = figure(text, link.end(), dimension, dimension == "money") if link else None
        if prior:
            out.append((measure, dimension, prior.raw, prior.factor or general))
    return out


def statement(text: str | None, whole: bool) -> int | None:
    """The money factor that a text states for the document (whole) or for the table behind it."""
    if not text:
        return None
    t = norm(text).strip()
    if whole:
        m = None
        for m in _DOC.finditer(t):
            pass
        return factor_of(m[1], "money") if m else None
    m = re.fullmatch(rf"[(\[]?{_TABLE.pattern}[)\]]?[。.]?", t)
    return factor_of(m[1], "money") if m else None


@F.pandas_udf(T.StructType([T.StructField("document", T.LongType()), T.StructField("next", T.LongType())]))
def statements(texts: pd.Series) -> pd.DataFrame:
    """What a text states for the document and for the table right behind it."""
    return pd.DataFrame({"document": pd.array([statement(t, True) for t in texts], "Int64"), "next": pd.array([statement(t, False) for t in texts], "Int64")})


def measure_rows(measures: DataFrame) -> list[tuple[int, str, str, str]]:
    """The dictionary of measures, which is fixed; more than 10,000 rows are refused."""
    rows = measures.select("measure_id", "name_zh", "name_en", "dimension").distinct().limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("a dictionary of measures has at most 10,000 rows")
    return [(r.measure_id, r.name_zh, r.name_en, r.dimension) for r in rows if r.dimension in UNITS]


@cache
def variants(chars: str) -> str:
    """Java regex of a character that NFKC turns into something with one of `chars`, such as a full-width letter."""
    want, spans = set(unicodedata.normalize("NFKD", chars).lower()), []
    for i in range(0x80, 0x110000):
        c = chr(i)
        if c not in chars and not want.isdisjoint(unicodedata.normalize("NFKD", c).lower()):
            if spans and spans[-1][1] == i - 1:
                spans[-1][1] = i
            else:
                spans.append([i, i])
    # Han and ASCII are most of the text and are passed over before the long class
    inside = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in spans)
    return rf"(?![\x00-\x7f\x{{4e00}}-\x{{9fff}}])[{inside}]" if spans else "(?!)"


def may_say(c: Column) -> Column:
    """Whether a text may hold what `_DOC` or `_TABLE` looks for; all texts that `statements` reads pass."""
    return c.rlike(f"单位|{_OPENING}") | c.rlike(variants("".join(sorted(set(re.sub(r"[(?:|)]", "", _OPENING)) | set("单位")))))


def names_pattern(rows: list[tuple[int, str, str, str]]) -> str:
    """Java regex of the measures' names in normalised texts, with white space and inline notation between the characters."""
    each = {unicodedata.normalize("NFKC", n) for _, zh, en, _ in rows for n in (zh, en) if n}
    between = rf"(?:[\s\x1c-\x1f]|{_MARKS.pattern})*+"
    return "(?iuU)" + "|".join(sorted(between.join(re.escape(c) for c in n if not c.isspace()) for n in each)) if each else "(?!)"


def may_name(c: Column, rows: list[tuple[int, str, str, str]]) -> Column:
    """Whether a text may name a measure; all texts in which `Measures` finds one pass, as it reads them after NFKC."""
    letters = {x for _, zh, en, _ in rows for n in (zh, en) if n for x in unicodedata.normalize("NFKC", n).lower() if not x.isspace()}
    return c.rlike(names_pattern(rows)) | c.rlike(variants("".join(sorted(letters | set("*_`'[]{}|\\")))) + r"|\][（﹙⁽₍︵]")


def figures(df: DataFrame, key: list[str], kind: str, text: str, before: str | None, document: str, rows: list[tuple[int, str, str, str]]) -> DataFrame:
    """(key, no, measure_id, dimension, raw, factor) of every figure; factor is null where no unit is stated."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*key).schema)
    keep = df.filter(may_name(F.col(text), rows) & (F.col(text).rlike(rf"(?U)\d|[{_WORDS}]") | F.col(text).rlike(variants("0123456789" + _WORDS))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        measures = Measures(rows)
        for pdf in batches:
            docs = [None if pd.isna(v) else int(v) for v in pdf["__document"]]
            tabs = [None if pd.isna(v) else int(v) for v in pdf["__before"]]
            out = []
            for i, t in enumerate(pdf["__text"]):
                found = from_table(t, measures, tabs[i], docs[i]) if kind == "table" else from_text(t, measures, docs[i])
                out += [(i, k, m, d, str(r), f) for k, (m, d, r, f) in enumerate(found)]
            part = pd.DataFrame(out, columns=["i", "no", "measure_id", "dimension", "raw", "factor"])
            part["factor"] = part["factor"].astype("Int64")
            keys = pdf[key].iloc[part["i"].astype(int).to_numpy()].reset_index(drop=True)
            yield pd.concat([keys, part.drop(columns="i")], axis=1)

    chosen = keep.select(*key, F.col(text).alias("__text"), (F.col(before) if before else F.lit(None)).cast("long").alias("__before"), F.col(document).cast("long").alias("__document"))
    return chosen.mapInPandas(run, f"{kinds}, no int, measure_id int, dimension string, raw string, factor long")


#: Figures that one task decodes, about.
PART_ROWS = 500_000


def _prepared(pdf: pd.DataFrame, levels: dict[int, tuple[float, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log10 of raw numbers, costs of the states, log10 of the states' factors) of figures."""
    kinds, at = np.unique(pdf["dimension"].to_numpy(str), return_inverse=True)
    logs, real = (a[at] for a in state_table([str(k) for k in kinds]))
    raw = np.abs(pdf["raw"].astype(float).to_numpy())
    with np.errstate(divide="ignore"):
        x = np.where(raw > 0, np.log10(raw), np.nan)
    index = {(d, f): k for d, fs in FACTORS.items() for k, f in enumerate(fs)}
    stated = np.array([-1 if pd.isna(f) else index[d, int(f)] for d, f in zip(pdf["dimension"], pdf["factor"])], np.int64)
    level = np.array([levels.get(m, (np.nan, np.nan)) for m in pdf["measure_id"].tolist()], float).reshape(-1, 2)
    return x, emissions(x, stated, logs, real, level[:, 0], level[:, 1]), logs


def _whole_series(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted batches, cut only between series of (part, device, measure_id); repeats of a figure are left out."""
    held: list[pd.DataFrame] = []
    series, one = ["device", "measure_id"], ["src", "item_id", "measure_id", "no"]
    for pdf in batches:
        if not len(pdf):
            continue
        last = pdf[series].iloc[-1]
        ends = (pdf[series] != last).any(axis=1).to_numpy()
        cut_at = int(np.flatnonzero(ends)[-1]) + 1 if ends.any() else 0
        if held and (held[-1][series].iloc[-1] == pdf[series].iloc[0]).all() and not cut_at:
            held.append(pdf)
            continue
        whole = pd.concat([*held, pdf.iloc[:cut_at]]) if held else pdf.iloc[:cut_at]
        if len(whole):
            yield whole.drop_duplicates(one).reset_index(drop=True)
        held = [pdf.iloc[cut_at:]]
    if held:
        yield pd.concat(held).drop_duplicates(one).reset_index(drop=True)


def _starts(pdf: pd.DataFrame) -> np.ndarray:
    s = pdf[["device", "measure_id"]]
    return np.flatnonzero((s != s.shift()).any(axis=1).to_numpy())


def decode_units(found: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """`found` (src, item_id, device, at, no, measure_id, dimension, raw, factor) with every figure decoded: `decoded` (factor),
    `value_common` and `first` (the first figure of the record with this value of the measure).

    A series is what one device (a company) reports of one measure, in order of time. Series are sorted over range partitions,
    so that a series with a third of all figures lies in many of them; its parts are linked exactly: each gives the least
    costs from each first to each last state, these are chained, and each part is decoded between the states found."""
    spark = found.sparkSession
    known = found.filter("factor IS NOT NULL AND cast(raw AS double) <> 0").groupBy("measure_id")
    log = F.log10(F.abs(F.col("raw").cast("double")) * F.col("factor"))
    stats = known.agg(F.avg(log).alias("m"), F.stddev_pop(log).alias("s")).collect()  # one row for each measure of the dictionary
    levels = {r.measure_id: (r.m, r.s) for r in stats}
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + found.count() // 1000), -(-found.count() // part_rows))
    place = ["device", "measure_id", "at", "src", "item_id"]
    ordered = cut(found.repartitionByRange(parts, *place).sortWithinPartitions(*place, "no").withColumn("part", F.spark_partition_id()))
    series = F.struct("device", "measure_id")
    ends = sorted(ordered.groupBy("part").agg(F.min(series).alias("lo"), F.max(series).alias("hi")).collect())  # a row for each partition
    shared = sorted({a.hi for a, b in zip(ends, ends[1:]) if a.hi == b.lo})
    fixed: dict[tuple[int, str, int], tuple[int, int]] = {}
    if shared:
        split = spark.createDataFrame([tuple(s) for s in shared], "device string, measure_id int")

        def costs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in _whole_series(batches):
                x, cost, logs = _prepared(pdf, levels)
                for a, b in zip(s := _starts(pdf), [*s[1:], len(pdf)]):
                    r = pdf.iloc[a]
                    yield pd.DataFrame({"part": [r["part"]], "device": r["device"], "measure_id": r["measure_id"], "dimension": r["dimension"], "first": x[a], "last": x[b - 1], "costs": [transfer(x[a:b], cost[a:b], logs[a:b]).ravel()]})

        # fewer series than partitions are split, and each part gives one small row
        rows = ordered.join(F.broadcast(split), ["device", "measure_id"], "left_semi").select(ordered.columns).mapInPandas(costs, "part int, device string, measure_id int, dimension string, first double, last double, costs array<double>").collect()
        for key in shared:
            mine = sorted((r for r in rows if (r.device, r.measure_id) == tuple(key)), key=lambda r: r.part)
            tie = lambda v: np.nan if v is None else v
            states = link_parts([(np.array(r.costs).reshape(WIDTH, WIDTH), tie(r.first), tie(r.last)) for r in mine], state_table([mine[0].dimension])[0][0])
            fixed |= {(r.part, r.device, r.measure_id): s for r, s in zip(mine, states)}
    sent = spark.sparkContext.broadcast((levels, fixed))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        levels, fixed = sent.value
        for pdf in _whole_series(batches):
            x, cost, logs = _prepared(pdf, levels)
            starts = _starts(pdf)
            for a, b in zip(starts, [*starts[1:], len(pdf)]) if fixed else ():
                r = pdf.iloc[a]
                ends = fixed.get((r["part"], r["device"], r["measure_id"]))
                if ends:
                    for row, state in zip((a, b - 1), ends):
                        cost[row, np.arange(WIDTH) != state] += NEVER
            states = viterbi(x, cost, logs, starts)
            decoded = [FACTORS[d][k] for d, k in zip(pdf["dimension"], states.tolist())]
            values = [common(Decimal(r), f) for r, f in zip(pdf["raw"], decoded)]
            out = pdf.drop(columns="part").assign(decoded=decoded, value_common=values)
            yield out.assign(first=~out.duplicated(["src", "item_id", "measure_id", "value_common"]))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return ordered.mapInPandas(run, f"{kinds}, decoded long, value_common long, first boolean")


def common(raw: Decimal, factor: int) -> int:
    return int((raw * factor).to_integral_value(ROUND_HALF_UP))


def last_before(rows: DataFrame, group: str, order: str, value: str, out: str, block: int = 1000) -> DataFrame:
    """`rows` with `out`: the latest non-null `value` of the group at a lower `order`.

    Groups are cut into blocks of the order; the last values of the blocks are carried over in a second,
    smaller window, so that no task orders more than a block, or a thousandth, of a group."""
    cut_up = rows.withColumn("__block", F.floor(F.col(order) / block))
    inside = W.partitionBy(group, "__block").orderBy(order).rangeBetween(W.unboundedPreceding, -1)
    here = cut_up.withColumn("__here", F.last(value, True).over(inside))
    last = cut_up.filter(F.col(value).isNotNull()).groupBy(group, "__block").agg(F.max_by(value, order).alias("__last"))
    blocks = cut_up.filter(F.col("__block") > 0).select(group, "__block").distinct().join(last, [group, "__block"], "full")
    carried = blocks.withColumn("__carry", F.last("__last", True).over(W.partitionBy(group).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)))
    carried = carried.filter(F.col("__carry").isNotNull()).select(group, "__block", "__carry")
    return here.join(carried, [group, "__block"], "left").withColumn(out, F.coalesce("__here", "__carry")).drop("__block", "__here", "__carry")


def _body(text: str, content: str) -> Column:
    return F.coalesce(F.when(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) != "", F.col(text)), F.col(content))


#: What names a figure's record, and its place in time: `figures` carries it along.
KEY = ["src", "item_id", "device", "at"]


def device_and_time(name: str) -> list[Column]:
    """The company and the date in a filing's name `date number company title`; a name in another form is a device of its own."""
    company = F.regexp_extract(name, r"^\d{4}-\d{2}-\d{2}\s+\S+\s+(\S+)", 1)
    return [F.when(company != "", company).otherwise(F.coalesce(F.col(name), F.lit(""))).alias("device"), F.coalesce(F.left(name, F.lit(10)), F.lit("")).alias("at")]


def content_list_figures(units: DataFrame, rows: list[tuple[int, str, str, str]]) -> DataFrame:
    """The figures of the tables of content_list: statements come from the text unit before a table and from earlier units."""
    texts = units.filter("type <> 'table'").select("doc_id", "unit_no", _body("text", "content").alias("t")).filter(may_say(F.col("t")))
    said = texts.select("doc_id", "unit_no", statements("t").alias("s")).select("doc_id", "unit_no", "s.document", "s.next").filter("document IS NOT NULL OR next IS NOT NULL")
    said = cut(said)  # few rows, read twice; else the texts would be searched again for each use
    tables = units.filter("type = 'table' AND table_text IS NOT NULL").select("unit_id", "doc_id", "unit_no", "table_text")
    # a row of a statement carries it; a table takes the one of the unit right before it and the latest of the document
    both = tables.withColumn("document", F.lit(None).cast("long")).withColumn("next", F.lit(None).cast("long")).unionByName(said.select(F.lit(None).cast("string").alias("unit_id"), "doc_id", "unit_no", F.lit(None).cast("string").alias("table_text"), "document", "next"))
    carried = last_before(both, "doc_id", "unit_no", "document", "doc_factor")
    before = said.filter("next IS NOT NULL").select("doc_id", (F.col("unit_no") + 1).alias("unit_no"), F.col("next").alias("table_factor")).dropDuplicates(["doc_id", "unit_no"])
    ready = carried.filter("unit_id IS NOT NULL").join(before, ["doc_id", "unit_no"], "left")
    named = ready.select(F.lit("content_list").alias("src"), F.col("unit_id").alias("item_id"), *device_and_time("doc_id"), "table_text", "table_factor", "doc_factor")
    return figures(named, KEY, "table", "table_text", "table_factor", "doc_factor", rows)


def meta_figures(meta: DataFrame, rows: list[tuple[int, str, str, str]]) -> DataFrame:
    """The figures of meta.embed_text; the document's statement is in row 0 of its index_dir."""
    first = meta.filter("rid = 0").select("index_dir", F.coalesce("embed_text", "raw_content").alias("t")).filter(may_say(F.col("t")))
    said = first.select("index_dir", statements("t").alias("s")).select("index_dir", F.col("s.document").alias("doc_factor")).filter("doc_factor IS NOT NULL").dropDuplicates(["index_dir"])
    texts = meta.filter(may_name(F.col("embed_text"), rows)).select("index_dir", F.lit("meta").alias("src"), F.col("id").alias("item_id"), *device_and_time("index_dir"), "embed_text")
    ready = salted_join(texts, said, ["index_dir"], F.col("item_id"), 4, "left")
    return figures(ready, KEY, "text", "embed_text", None, "doc_factor", rows)


def all_figures(units: DataFrame, meta: DataFrame, measures: DataFrame) -> DataFrame:
    """The figures of both tables, kept in the shared folder, as they are read more than once and reading text is the costly part.

    Deliveries of a record are reduced to one before its text is read."""
    rows = measure_rows(measures)
    return cut(content_list_figures(once_each(units, ["unit_id"]), rows).unionByName(meta_figures(once_each(meta, ["id"]), rows)))


def common_values(units: DataFrame, meta: DataFrame, measures: DataFrame) -> DataFrame:
    """(src, item_id, measure_id, value_common) of all figures of both tables."""
    return decode_units(all_figures(units, meta, measures)).filter("first").select("src", "item_id", "measure_id", "value_common")


def recovered_units(units: DataFrame, meta: DataFrame, measures: DataFrame, hide: int = 4) -> DataFrame:
    """(measure_id, figures, hidden, recovered): how many of the stated units that are hidden (every `hide`-th by hash) the
    decoding finds again, over all figures."""
    found = all_figures(units, meta, measures)
    hidden = (F.pmod(F.xxhash64("src", "item_id", "measure_id", "no"), F.lit(hide)) == 0) & F.col("factor").isNotNull()
    blind = found.withColumns({"truth": F.when(hidden, F.col("factor")), "factor": F.when(hidden, None).otherwise(F.col("factor"))})
    return decode_units(blind).groupBy("measure_id").agg(F.count("*").alias("figures"), F.count("truth").alias("hidden"), F.count_if(F.col("truth") == F.col("decoded")).alias("recovered"))
