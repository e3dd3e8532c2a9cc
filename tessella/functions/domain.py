"""Years, quarters and kinds of filings from titles and questions, as Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import col

# Keywords that tell reports from notices. 前三季度四季度 is one word.
REPORT_WORDS = """年报 年度报告 半年度 半年报 一季报 第一季度 二季报 第二季度 三季报 第三季度 前三季度四季度 财务 净利润 营收 营业收入 经营现金流
现金流量 资产负债 资产负债表 利润表 毛利率 ROE ROA 研发费用 费用率 报表 科目 分部 审计报告""".split()
NOTICE_WORDS = """公告 关于 签订合同 中标 回购 股份回购 质押 减持 增持 停牌 复牌 对外担保 担保 项目 定增 配股 董事会 股东大会
回复问询 更正 变更 提示性公告 提示公告 进展 终止 中止""".split()
REPORT_TITLES = "年报 季报 季度报告 年度报告 述职报告 工作报告".split()
# Patterns of years, ranges, quarters and spans of years, Han numerals, and how many years of a range count.
YEAR = r"((?:19|20)(?U:\d){2})"
RANGE = rf"{YEAR}(?U:\s)*[-~至到—－](?U:\s)*{YEAR}"
QUARTER = r"(?i)(Q[1-4]|[一二三四]季(?:度|报)?|第[一二三四]季度|[1-4]季报)"
RECENT = r"近(?U:\s)*([1-9]|1[0-9])(?U:\s)*年"
RECENT_HAN = r"近([ 一二两三四五六七八九十]+)年"
HAN_DIGITS = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}
RANGE_CAP = 10


def _hits(text: Column, words: list[str]) -> Column:
    return reduce(Column.__add__, [F.contains(text, F.lit(w)).cast("int") for w in words])


def classify(c: Column | str) -> Column:
    """struct(doc_type, confidence): the kind with more keywords; unknown without any (0) or in a tie (0.5)."""
    t = F.coalesce(col(c), F.lit(""))
    r, n = _hits(t, REPORT_WORDS), _hits(t, NOTICE_WORDS)
    sure = F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.1) * F.abs(r - n))
    kind = F.when(r > n, "report").when(n > r, "notice").otherwise("unknown")
    return F.struct(kind.alias("doc_type"), F.when((r == 0) & (n == 0), 0.0).when(r == n, 0.5).otherwise(sure).alias("confidence"))


def _ints(texts: Column) -> Column:
    return F.transform(texts, lambda x: x.cast("int"))


def absolute_years(t: Column) -> Column:
    return F.filter(_ints(F.regexp_extract_all(t, F.lit(YEAR), F.lit(1))), lambda y: y.between(1900, 2100))


def range_years(t: Column, cap: int | None) -> Column:
    """Years of all ranges such as 2019-2021, either way round; of a longer range the last `cap` years."""
    first, last = (_ints(F.regexp_extract_all(t, F.lit(RANGE), F.lit(g))) for g in (1, 2))

    def expand(a: Column, b: Column) -> Column:
        lo, hi = F.least(a, b), F.greatest(a, b)
        return F.sequence(F.greatest(lo, hi - (cap - 1)) if cap else lo, hi)

    return F.flatten(F.zip_with(first, last, expand))


def quarter_of(q: Column) -> Column:
    u = F.upper(q)
    out = F.when(u.rlike("^Q[1-4]$"), u)
    for k, han in enumerate("一二三四", 1):
        out = out.when(F.contains(u, F.lit(han)) | F.contains(u, F.lit(str(k))), f"Q{k}")
    return out


def quarters(t: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(t, F.lit(QUARTER), F.lit(1)), quarter_of), lambda q: q.isNotNull()))


def _recent(t: Column) -> Column:
    """How many years 近N年 names, in digits (1 to 19), null if none."""
    return F.nullif(F.regexp_extract(t, RECENT, 1), F.lit("")).cast("int")


def _recent_han(t: Column) -> Column:
    s = F.replace(F.trim(F.regexp_extract(t, RECENT_HAN, 1)), F.lit(" "), F.lit(""))
    digit = F.create_map(*[F.lit(x) for kv in HAN_DIGITS.items() for x in kv])
    head, tail = F.split_part(s, F.lit("十"), F.lit(1)), F.split_part(s, F.lit("十"), F.lit(2))
    tens = F.when(head == "", 10).otherwise(F.coalesce(F.try_element_at(digit, head), F.lit(0)) * 10)
    n = tens + F.when(tail == "", 0).otherwise(F.coalesce(F.try_element_at(digit, tail), F.lit(0)))
    return F.when(s == "", None).when(s == "十", 10).when(F.contains(s, F.lit("十")), F.when(n.between(1, 19), n)).otherwise(F.try_element_at(digit, s))


def _back(n: Column, current_year: int) -> Column:
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lit(current_year) - i)).otherwise(F.array().cast("array<int>"))


def query_period(c: Column | str, current_year: int) -> Column:
    """struct(years, quarters, is_range, n_recent, has_relative) of a question; the current year is a parameter."""
    t = F.coalesce(col(c), F.lit(""))
    none = F.array().cast("array<int>")
    relative = [F.when(F.contains(t, F.lit(w)), F.array(F.lit(current_year - k))).otherwise(none) for w, k in (("去年", 1), ("前年", 2), ("今年", 0))]
    recent, han = _recent(t), _recent_han(t)
    years = F.concat(absolute_years(t), range_years(t, RANGE_CAP), F.coalesce(_back(recent, current_year), none), F.coalesce(_back(han, current_year), none), *relative)
    return F.struct(
        F.array_sort(F.array_distinct(F.filter(years, lambda y: y.between(1900, 2100)))).alias("years"),
        quarters(t).alias("quarters"),
        t.rlike(RANGE).alias("is_range"),
        F.coalesce(F.when(han > 0, han), recent).alias("n_recent"),
        t.rlike("去年|前年|今年").alias("has_relative"),
    )


def title_meta(doc_id: Column | str, path: Column | str | None = None) -> Column:
    """struct(source_path, doc_type, year, quarter, source_date, year_source, years_mentioned, is_multi_year) of a filing's name."""
    d = F.coalesce(col(doc_id), F.lit(""))
    dated = r"^(?U:\d){4}-(?U:\d){2}-(?U:\d){2}(?U:\s)+"
    p = F.coalesce(col(path), F.lit("")) if path is not None else F.lit("")
    title = F.regexp_replace(d, dated, "")
    prefix = F.when(d.rlike(dated), F.left(d, F.lit(4)).cast("int"))
    found = F.concat(range_years(title, None), absolute_years(title))
    some = F.size(found) > 0
    rules = classify(title)
    kind = (
        F.when(F.contains(p, F.lit("公告")) | F.contains(title, F.lit("公告")), "notice")
        .when((rules["doc_type"] != "unknown") & (rules["confidence"] >= 0.4), rules["doc_type"])
        .when(F.contains(p, F.lit("财报")) | title.rlike("|".join(REPORT_TITLES)), "report")
    )
    return F.struct(
        p.alias("source_path"), kind.alias("doc_type"),
        F.when(some, F.element_at(found, -1)).otherwise(prefix).alias("year"),
        quarter_of(F.nullif(F.regexp_extract(title, QUARTER, 1), F.lit(""))).alias("quarter"),
        F.when(d.rlike(dated), F.left(d, F.lit(10))).alias("source_date"),
        F.when(some, "title").when(prefix.isNotNull(), "prefix").alias("year_source"),
        F.array_sort(F.array_distinct(F.array_compact(F.concat(found, F.array(prefix))))).alias("years_mentioned"),
        (F.size(F.array_distinct(found)) > 1).alias("is_multi_year"),
    )


def doc_type_of_root(root: Column | str) -> Column:
    """The kind of filing that a folder's name tells."""
    return F.when(F.contains(col(root), F.lit("公告")), "notice").when(F.contains(col(root), F.lit("财报")), "report")
