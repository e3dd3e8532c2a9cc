import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.operators import chunking as ck
from tessella.operators import tables as tb


def texts(lengths):
    return [chr(97 + i % 26) * n for i, n in enumerate(lengths)]


def render(units, slices):
    return [units[s][b : b + k] if k else "\n".join(units[s : s + n]) for s, n, b, k in slices]


def naive_greedy(units, most):
    out, cur = [], []
    for u in units:
        if len(u) > most:
            if cur:
                out.append("\n".join(cur))
            out.append(u)
            cur = []
        elif cur and len("\n".join([*cur, u])) > most:
            out.append("\n".join(cur))
            cur = [u]
        else:
            cur.append(u)
    return out + (["\n".join(cur)] if cur else [])


def naive_length(units, most, overlap):
    out, cur = [], []
    for u in units:
        if len(u) > most:
            if cur:
                out.append("\n".join(cur))
            out += [u[i : i + most] for i in range(0, len(u), most)]
            cur = []
        elif sum(map(len, cur)) + len(u) > most:
            if cur:
                out.append("\n".join(cur))
            k = next((k for k in range(1, len(cur) + 1) if sum(map(len, cur[-k:])) >= overlap), len(cur))
            cur = (cur[-k:] if cur else []) + [u]
        else:
            cur.append(u)
    return out + (["\n".join(cur)] if cur else [])


SIZES = st.lists(st.integers(1, 30), max_size=40)


@settings(max_examples=200, deadline=None)
@given(SIZES, st.integers(5, 25))
def test_greedy_against_naive(sizes, most):
    u = texts(sizes)
    assert render(u, ck.greedy_slices(sizes, most)) == naive_greedy(u, most)


@settings(max_examples=200, deadline=None)
@given(SIZES, st.integers(6, 25), st.integers(1, 5))
def test_length_against_naive(sizes, most, overlap):
    u = texts(sizes)
    assert render(u, ck.strategy_slices(sizes, most, overlap)) == naive_length(u, most, overlap)


def test_known_folds():
    assert render(["aaaa", "bbbb", "cccc"], ck.strategy_slices([4, 4, 4], 10, 3)) == ["aaaa\nbbbb", "bbbb\ncccc"]
    assert render(["a", "b", "c"], ck.strategy_slices([1, 1, 1], 100, breaks=[False, True, False])) == ["a", "b\nc"]
    assert [s[3] for s in ck.strategy_slices([25], 10, breaks=[False])] == [10, 10, 5]
    assert [s[3] for s in ck.strategy_slices([25], 10, breaks=[False], twice=True)] == [10, 10, 5] * 2


UNITS = "doc_id string, unit_no int, type string, page_idx int, page string, text string, content string, items array<string>, table_body string, table_text string, text_level int"


def test_assembly(spark):
    rows = [
        ("d", 1, "text", 0, None, "aaaa", None, None, None, None, None), ("d", 2, "text", None, "0", "  ", "bbbb", None, None, None, None), ("d", 3, "header", 0, None, "kopf", None, None, None, None, None),
        ("d", 4, "table", 1, None, None, None, None, "<table>" + "x" * 3994, "项目: 1。\n\n 项目: 2。", None), ("d", 5, "text", 1, None, "cccccccccccc", None, None, None, None, None), ("d", 6, "list", None, "x", None, None, ["dd", " ", None], None, None, None),
        ("d", 7, "table", None, None, None, None, None, None, None, None), ("e", 1, "text", 0, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, UNITS)
    got = ck.assemble(df, "rows", 10).orderBy("ord").collect()
    assert [(r.id, r.type, r.content) for r in got] == [("d#p0#c1", "text", "aaaa\nbbbb"), ("d#p1#t1#r1", "table_row", "项目: 1。"), ("d#p1#t1#r2", "table_row", "项目: 2。"), ("d#p1#c2", "text", "cccccccccccc"), ("d#c3", "text", "dd")]
    assert [r.ord for r in got] == [1, 2, 3, 4, 5] and got[1].tbl.id == "d::p1::t1" and got[0].tbl is None and got[2].tbl.row_index == 2
    html = ck.assemble(df, "html", 10).orderBy("ord").collect()
    assert [(r.id, len(r.content), r.tbl and r.tbl.part) for r in html if r.type == "table"] == [("d#p1#c2", 2000, 1), ("d#p1#c3", 2001, 2)]
    assert [r.id for r in html if r.type == "text"] == ["d#p0#c1", "d#p1#c4", "d#c5"]
    assert [(r.id, r.seq) for r in ck.tables_index(df, "rows").orderBy("seq").collect()] == [("d::p1::t1", 1), ("d::t2", 2)]
    assert ck.assemble(df.limit(0), "rows").count() == 0 and ck.assemble(df.limit(0), "html").count() == 0


def test_latest_by_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", None, "y"), ("b", 1, "z"), ("c", None, None)], "k string, v int, x string")
    assert sorted(map(tuple, ck.latest_by_key(df, ["k"], "v").collect())) == [("a", 2, None), ("b", 1, "z"), ("c", None, None)]


GRIDS = [
    ("<table><tr><th>项目</th><th>本期</th></tr><tr><td>营收</td><td>10</td></tr></table>", "项目: 营收，本期: 10。"),
    ('<table><tr><th rowspan="2">A</th><th colspan="2">B</th></tr><tr><th>x</th><th>y</th></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>', "A: A，B: x，B: y。\nA: 1，B: 2，B: 3。"),
    ("<table><tr><td>a</td></tr><tr><td>b.</td></tr></table>", "列1: a。\n列1: b."),
    ("<table><tr><td>单位：元</td><td> </td></tr><tr><td>A</td><td>B</td></tr><tr><td>1</td><td>2</td></tr></table>", "A: 1，B: 2。"),
    ("<table><tr><td>项目<td>本期<tr><td>a&amp;b<td>1<br>2</table>after<table><tr><td>z</td></tr></table>", "项目: a&b，本期: 1 2。"),
    ("", ""), ("kein", ""), (None, ""), ("<table></table>", ""), ('<table><tr><td colspan="x" rowspan="0">a</td></tr></table>', "列1: a。"),
]


def test_tables_as_text(spark):
    df = spark.createDataFrame([(i, h, "alt") for i, (h, _) in enumerate(GRIDS)], "i int, html string, other string")
    got = {r.i: r.body for r in tb.textify(df, "html", "body").collect()}
    assert [got[i] for i in range(len(GRIDS))] == [t for _, t in GRIDS]
    routed = {r.i: r.body for r in tb.textify(df, "html", "body", other=tb.F.col("other")).collect()}
    assert routed[1] == "alt" and routed[0] == GRIDS[0][1]
    resumed = tb.textify(df.withColumn("old", tb.F.when(tb.F.col("i") == 0, "früher").otherwise(" ")), "html", "body", other=tb.F.lit(None).cast("string"), earlier=tb.F.col("old"))
    assert {r.i: r.body for r in resumed.collect()}[0] == "früher"


@pytest.mark.parametrize("seed", range(3))
def test_grid_spans_against_naive(seed):
    rnd = random.Random(seed)
    n, m = 4, 5
    cover = [[None] * m for _ in range(n)]
    html, k = "<table>", 0
    for r in range(n):
        html += "<tr>"
        for c in range(m):
            if cover[r][c] is None:
                w = 1
                while c + w < m and cover[r][c + w] is None and rnd.random() < 0.4:
                    w += 1
                h = 1 + (r + 1 < n and rnd.random() < 0.3)
                for y in range(r, r + h):
                    for x in range(c, c + w):
                        cover[y][x] = f"v{k}"
                html += f'<td colspan="{w}" rowspan={h}>v{k}</td>'
                k += 1
        html += "</tr>"
    assert tb.grid(html + "</table>") == cover


def test_strategies_frame(spark):
    df = spark.createDataFrame([("d", i, t, b) for i, (t, b) in enumerate([("aaaa", None), ("", True), ("bbbb", True), ("x" * 25, False)])] + [("n", 1, None, None)], "doc string, n int, body string, brk boolean")
    rows = ck.strategy_chunks(df, "doc", "n", "body", "level", 10, breaks="brk").toPandas().sort_values("no")
    assert rows.content.tolist() == ["aaaa", "bbbb", "x" * 10, "x" * 10, "x" * 5] and rows.id.tolist() == [f"d_{i}" for i in range(5)]
    assert ck.strategy_chunks(df, "doc", "n", "body", "length", 10, 3).count() == 4
    with pytest.raises(ValueError):
        ck.strategy_chunks(df, "doc", "n", "body", "other")
    v = spark.createDataFrame(pd.DataFrame({"d": ["a"] * 4, "n": [1, 2, 3, 4], "v": [[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [0.0, 0.0]]}))
    assert [r.split_here for r in ck.semantic_breaks(v, "d", "n", "v").orderBy("n").collect()] == [False, False, True, False]


def test_strategies_by_name_and_failed_embeddings(spark):
    df = spark.createDataFrame([("d", k, "字" * 4, False, k == 2) for k in range(5)] + [("e", k, "字" * 4, k == 3, False) for k in range(5)], "doc string, n int, body string, brk boolean, bad boolean")
    got = ck.strategy_chunks(df, "doc", "n", "body", "semantic", 12, 4, breaks="brk", failed="bad").toPandas()
    assert got[got.doc == "e"].sort_values("no").content.str.len().tolist() == [14, 9]  # three units, then two
    plain = ck.strategy_chunks(df, "doc", "n", "body", "length", 12, 4).toPandas()
    assert got[got.doc == "d"].sort_values("no").content.tolist() == plain[plain.doc == "d"].sort_values("no").content.tolist()
    ck.STRATEGIES["each"] = lambda most, overlap, twice: lambda lengths, breaks: ck.F.transform(lengths, lambda n, i: ck.F.struct(i.alias("start"), ck.F.lit(1).alias("n"), ck.F.lit(0).alias("begin"), ck.F.lit(0).alias("length")))
    assert ck.strategy_chunks(df, "doc", "n", "body", "each").count() == 10
    del ck.STRATEGIES["each"]


def test_tables_by_a_provider(spark):
    rows = [(1, "<table><tr><td colspan=2>a</td></tr></table>", None), (2, "<table><tr><td>b</td></tr></table>", None), (3, "<table><tr><td rowspan=3>c</td></tr></table>", "alt"), (4, None, None)]
    df = spark.createDataFrame(rows, "id int, html string, old string")
    told = lambda prompts: ["写好的文字" if "colspan" in p else None for p in prompts]
    assert {r.id: r.out for r in tb.textify_by(df, "html", "out", told).collect()} == {1: "写好的文字", 2: "列1: b。", 3: "列1: c。", 4: ""}
    assert {r.id: r.out for r in tb.textify_by(df, "html", "out", lambda p: 1 / 0, always=True, earlier=tb.F.col("old")).collect()} == {1: "", 2: "列1: b。", 3: "alt", 4: ""}  # a lone header row has no sentence
    assert tb._grid_or_error(5)[1]
