import html

import pytest
from pyspark.sql import functions as F

from tessella.functions import domain as dm
from tessella.functions import text as tx
from tessella.functions import vector as vec


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build("x").alias("y")).first().y


def test_tokens(spark):
    got = one(spark, "2021年第一季度 Total_assets 总资产 éa B2b", tx.bm25_tokens)
    assert got == "2021 年 第 一 季 度 total_assets 总 资 产 a b2b".split()
    assert one(spark, None, tx.bm25_tokens) == [] and one(spark, "\u212a\u0130", tx.bm25_tokens) == []


@pytest.mark.parametrize("raw", ["a　b c\n\t d", "", "   ", "x\x1cy", "一 二"])
def test_normalize_space_equals_python(spark, raw):
    assert one(spark, raw, tx.normalize_space) == " ".join(raw.split())


def test_text_functions(spark):
    assert one(spark, "<p>A&amp;B&nbsp;&lt;c&gt;</p><br/>", tx.strip_html) == "A&B <c>"
    assert one(spark, "abcdef", lambda c: tx.truncate(c, 3)) == "abc…" and one(spark, "abcdef", lambda c: tx.truncate(c, 0)) == "abcdef"
    assert one(spark, "/x/y/2020-01-01 标题_content_list.json", tx.doc_id_of) == "2020-01-01 标题"
    assert one(spark, '<td colspan="2">', tx.has_merged_cells) is True and one(spark, "<td rowspan=1>", tx.has_merged_cells) is False
    assert one(spark, None, tx.has_merged_cells) is False and one(spark, '<td colspan="99999999999999999999">', tx.has_merged_cells) is True
    assert one(spark, '改写 < "新的 问题" > 与 <b>', tx.angle_parts) == "新的 问题" and one(spark, "无", tx.angle_parts) is None
    assert one(spark, "", lambda c: tx.content_of(c, F.lit("e"))) == "e" and one(spark, None, lambda c: tx.content_of(c, F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize("name,want", [
    ("2022-04-15 2021年第一季度报告", (2021, "Q1", [2021, 2022], "title", "2022-04-15", False, "report")),
    ("2022-04-15 章程", (2022, None, [2022], "prefix", "2022-04-15", False, None)),
    ("关于2021-2019年度会计差错更正的公告", (2019, None, [2019, 2020, 2021], "title", None, True, "notice")),
    ("", (None, None, [], None, None, False, None)),
])
def test_titles(spark, name, want):
    r = one(spark, name, dm.title_meta)
    assert (r.year, r.quarter, r.years_mentioned, r.year_source, r.source_date, r.is_multi_year, r.doc_type) == want


@pytest.mark.parametrize("text,years,quarters", [
    ("近三年", [2022, 2023, 2024], []), ("近十五年", list(range(2010, 2025)), []), ("近20年", [], []), ("2000-2020年", [2000, *range(2011, 2021)], []),
    ("去年同期", [2023], []), ("前三季度", [], ["Q3"]), ("近3年与2030至2028年Q2、第四季度", [2022, 2023, 2024, 2028, 2029, 2030], ["Q2", "Q4"]), ("近二十年", [], []), (None, [], []),
])
def test_question_periods(spark, text, years, quarters):
    r = one(spark, text, lambda c: dm.query_period(c, 2024))
    assert r.years == years and r.quarters == quarters


@pytest.mark.parametrize("text,want", [("公告", ("notice", 0.6)), ("净利润", ("report", 0.6)), ("净利润公告", ("unknown", 0.5)), ("你好", ("unknown", 0.0)), ("四季度", ("unknown", 0.0)), (None, ("unknown", 0.0))])
def test_kinds(spark, text, want):
    r = one(spark, text, dm.classify)
    assert (r.doc_type, pytest.approx(r.confidence)) == want


def test_vectors(spark):
    assert one(spark, [3.0, 4.0], vec.l2_normalize, "array<double>") == pytest.approx([0.6, 0.8])
    assert one(spark, [0.0, 0.0], lambda c: vec.cosine(c, c), "array<double>") == 0
    df = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("a", 6.0), ("b", 3.0)], "g string, s double")
    got = sorted((r.g, r.s, r.n) for r in vec.with_minmax(df, ["g"], "s", "n", True).collect())
    assert got == [("a", 2.0, 0.0), ("a", 4.0, 0.5), ("a", 6.0, 1.0), ("b", 3.0, 0.0)]
    assert vec.with_minmax(df.limit(0), ["g"], "s", "n", False).count() == 0


@pytest.mark.parametrize("raw", ["&#20013;&#x4e2d;&ensp;&reg;&amp;#20013;", "&amp;lt;&LT;&copy2020", "R&D&nbsp;&mdash;&hellip;", "&#0;&#x80;&notit;&bogus;", "A&amp;B", "", "&"])
def test_strip_html_decodes_every_entity(spark, raw):
    assert one(spark, raw, tx.strip_html) == " ".join(html.unescape(raw).split())
    assert one(spark, None, tx.strip_html) is None


def test_title_by_path(spark):
    rows = [("2020-01-01 1 公司 某事", "库/公告/x.json"), ("2020-01-01 1 公司 某事", "库/财报/x.json"), ("2020-01-01 1 公司 某事", None), (None, None)]
    df = spark.createDataFrame(rows, "d string, p string")
    got = [(r.t.source_path, r.t.doc_type, r.t.year) for r in df.select(dm.title_meta("d", "p").alias("t")).collect()]
    assert got == [("库/公告/x.json", "notice", 2020), ("库/财报/x.json", "report", 2020), ("", None, 2020), ("", None, None)]
