import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import splitting as sp

TEXT = st.text(st.sampled_from(list("汉字文本，。！；\n ab12.,”")), max_size=900)


@settings(max_examples=120, deadline=None)
@given(TEXT, st.sampled_from([(50, 10), (120, 0), (500, 50)]))
def test_pieces_cover_the_text(raw, limits):
    most, overlap = limits
    t = sp.normalise(raw)
    cuts = sp.cut_points(t, most, overlap)
    assert bool(cuts) == bool(t)
    if not t:
        return
    assert cuts[0][0] == 0 and cuts[-1][1] == len(t)
    assert all(0 < e - s <= most for s, e, _ in cuts)
    assert all(s2 == e - overlap and e2 > e for (_, e, _), (s2, e2, _) in zip(cuts, cuts[1:]))


def brute(t, most, overlap):
    """Least cost over all cuts at all positions, by plain recursion."""
    import functools

    n = len(t)
    cost = {e: sp.PENALTY[sp.HARD] for e in range(1, n)} | {n: 0.0}
    for m in sp._BOUNDARY.finditer(t):
        kind = {"p": sp.PARAGRAPH, "s": sp.SENTENCE, "c": sp.CLAUSE, "w": sp.SPACE}[m.lastgroup]
        e = m.start() if m.lastgroup in "pw" else m.end()
        if 0 < e < n:
            cost[e] = min(cost[e], sp.PENALTY[kind])
    pieces = -(-(n - overlap) // (most - overlap))
    ideal = (n + (pieces - 1) * overlap) / pieces

    @functools.cache
    def best(end, start):
        return min(
            (cost[e] + ((e - start - ideal) / ideal) ** 2 + (0 if e == n else best(e, e - overlap)) for e in range(max(end, overlap) + 1, min(n, start + most) + 1)),
            default=float("inf"),
        )

    return best(0, 0)


def total(t, most, overlap):
    cuts = sp.cut_points(t, most, overlap)
    pieces = -(-(len(t) - overlap) // (most - overlap))
    ideal = (len(t) + (pieces - 1) * overlap) / pieces
    names = dict(zip(sp.NAMES, [*sp.PENALTY, 0.0]))
    return sum(names[k] + ((e - s - ideal) / ideal) ** 2 for s, e, k in cuts)


def test_least_cost_against_brute_force():
    t = sp.normalise("第一句话在这里。第二句，比较长一些的内容也在这里！第三段\n另起一段。" * 4)
    assert total(t, 40, 6) == pytest.approx(brute(t, 40, 6))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 45), st.sampled_from("。，\n ")), max_size=8), st.sampled_from([(20, 4), (30, 3), (25, 12)]))
def test_least_cost_over_all_positions(runs, limits):
    t = sp.normalise("".join("字" * k + c for k, c in runs))
    if len(t) > limits[0]:
        assert total(t, *limits) == pytest.approx(brute(t, *limits))


def test_natural_boundaries_are_preferred():
    t = "甲" * 300 + "。" + "乙" * 300 + "。" + "丙" * 150
    assert [k for _, _, k in sp.cut_points(t, 500, 50)][0] == "sentence"
    assert {k for _, _, k in sp.cut_points("长" * 2000, 500, 50)} == {"hard", "end"}
    assert sp.cut_points("1,234" * 3, 500, 50) == [(0, 15, "end")]


def test_frame(spark):
    rows = [("a", None, 1), ("b", "", 1), ("c", " 　\n ", 1), ("d", "短文", 1), ("d", "短文", 1), ("e", "长文。" * 30000, None), (None, "句。" * 400, 2)]
    df = spark.createDataFrame(rows, "id string, body string, piece int")
    out = sp.split_oversized(df.withColumnRenamed("piece", "pieces"), ["id"], "body").toPandas()
    assert set(out.id.dropna()) == {"d", "e"} and out.id.isna().any()
    assert (out.piece.str.len() <= 500).all() and (out.id == "d").sum() == 2
    e = out[out.id == "e"].sort_values("piece_no")
    text = e.piece.iloc[0] + "".join(p[50:] for p in e.piece.iloc[1:])
    assert text == "长文。" * 30000 and (e.pieces == len(e)).all()
    assert sp.split_oversized(df.limit(0), ["id"], "body").count() == 0
    assert sp.split_oversized(df, ["id"], "body", only_oversized=True).select("id").distinct().count() == 2


def test_jvm_normalisation_equals_python(spark):
    texts = [" a　b\n\n c\t", "x  y", "\n\n", "p \n q", "a\r\nb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", sp.normalised(sp.F.col("t")).alias("n")).collect()}
    assert [got[i] for i in range(len(texts))] == [sp.normalise(t) for t in texts]
    assert re.fullmatch(r"a b\nc|a b\n c", sp.normalise(texts[0]))
