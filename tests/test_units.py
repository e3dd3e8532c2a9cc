from decimal import Decimal

import pytest

from tessella.operators import units as un

ROWS = [(1, "营业收入", "revenue", "money"), (2, "净利润", "net profit", "money"), (6, "用电量", "electricity used", "energy"), (8, "厂房面积", "floor area", "area"), (11, "毛利率", "gross margin", "ratio"), (10, "平均交付周期", "average lead time", "time")]
M = un.Measures(ROWS)


def values(found):
    return [(m, un.common(r, f) if f else None) for m, _, r, f in found]


@pytest.mark.parametrize("text,document,want", [
    ("报告期内营业收入为1,219.5万元人民币，上年同期为45亿3161万元。", None, [(1, 12195000), (1, 4531610000)]),
    ("全年实现 净利润 -0.71亿元，去年为人民币壹佰伍拾叁万陆仟元整，排名第37位。", None, [(2, -71000000), (2, 1536000)]),
    ("**净利润**：（3422.51）（上期：（6,933））。", 10**4, [(2, -34225100), (2, -69330000)]),
    ("本期[营业收入](https://a.example/p)RMB 192.21 million，较上期的CNY 65.8399 mn变动约7成。", None, [(1, 192210000), (1, 65839900)]),
    ("gross margin 0.2997（以小数列示），较４２２０个基点有所变化，涉及27个网点。", None, [(11, 2997), (11, 4220)]),
    ("毛利率<5\\%的订单需复核。营业收入同比增长12%。", 10**4, []),
    ("（下列金额单位：万元）营业收入20,802，较１３５６有所变化。净利润由1元变为2。", 10**8, [(1, 208020000), (1, 13560000), (2, 1), (2, 20000)]),
    ("\\textbf{厂房面积}由97.4113万㎡变为0.37 km²。用电量：1.01吉瓦时（上期：3,709万度）。", None, [(8, 974113), (8, 370000), (6, 1010000), (6, 37090000)]),
    ("平均交付周期58周（上期：12天）。", None, [(10, 9744), (10, 288)]),
    ("归属净利润率5，营业收入，净利润", 1, []), ("", 1, []),
])
def test_text(text, document, want):
    assert values(un.from_text(text, M, document)) == want


@pytest.mark.parametrize("text,before,document,want", [
    ("单位：千元\nItem: revenue，Current: 200431.5，Prior: -。\nItem: 净利润，Current: (135,101.9)，Prior: 3亿元。", 10**4, 10**8, [(1, 200431500), (2, -135101900), (2, 300000000)]),
    ("项目: 营业收入，本期（亿元）: 0.5，上期(亿元): 不适用。\n项目: 毛利率，本期（亿元）: 5%，上期(亿元): 74‰。", None, None, [(1, 50000000), (11, 500), (11, 740)]),
    ("项目: 厂房面积，公顷，本期: ４１，上期: /。\n项目: 营业收入/人民币千元，本期: 1，上期: 2万元。\n项目: 子公司家数，本期: 3家，上期: 4家。", None, 10**8, [(8, 410000), (1, 1000), (1, 20000)]),
    ("项目: 用电量，计量单位: MWh，本期: 1,071.937，上期: N/A。", None, None, [(6, 1071937)]),
    ("项目: 营业收入，本期: 7，上期: （8）。", 10**6, 10**8, [(1, 7000000), (1, -8000000)]),
    ("项目: 营业收入，本期: 7，上期: 8。", None, 10**8, [(1, 700000000), (1, 800000000)]),
    ("项目: 营业收入增长率，本期: 7，同比变动: 8。\n项目: 净利润 *，本期: 7元，变动幅度: 8%。", None, None, [(2, 7)]),
    ("本表各项数据均摘自经审计的合并财务报表及其附注，若与其他章节披露的口径不同以本表为准，计量单位：万元\n项目: 营业收入，截至报告期末且经审计调整后并按新会计准则重述列报的本期合并口径累计金额合计数: 7，上期: 8。", None, 10**8, [(1, 70000), (1, 80000)]),
    ("(表格文本化失败: 超时)", None, None, []), ("", None, None, []),
])
def test_table(text, before, document, want):
    assert values(un.from_table(text, M, before, document)) == want


def test_statements():
    assert un.statement("除另有说明外，本文件金额均以千元列示。", True) == 1000
    assert un.statement("<p>本文件所列金额数据，如无特别注明，单位为百万元。</p>", True) == 10**6
    assert un.statement("若非特别标注，以下金额按亿元填列。", True) == 10**8 and un.statement("未经许可，任何单位不得转载", True) is None
    assert un.statement("（金额单位：万元人民币）", False) == 10**4 and un.statement("计量单位 元", False) == 1
    assert un.statement("本文件所列金额以人民币万元计。", True) == 10**4
    assert un.statement("除另有说明外，本文件及其附件、附注和补充资料中所列示的全部金额、余额和发生额均以人民币千元列示。", True) == 1000
    assert un.statement("单位：万元，其他文字在后面", False) is None and un.statement(None, True) is None


def brute(raws, stated, dimension, level):
    import itertools
    import math

    states = sorted(set(un.UNITS[dimension].values()))
    best = None
    for path in itertools.product(*[[s] if s else states for s in stated]):
        cost = 0.0
        for i, (r, f) in enumerate(zip(raws, path)):
            x = math.log10(abs(r)) if r else None
            if x is not None and level and not stated[i]:
                cost += ((x + math.log10(f) - level[0]) / max(level[1], 0.3)) ** 2 / 2
            if i:
                cost += 0 if path[i - 1] == f else 0.7
                if x is not None and raws[i - 1]:
                    cost += min(8.0, (x + math.log10(f) - math.log10(abs(raws[i - 1])) - math.log10(path[i - 1])) ** 2 / 0.5)
        if best is None or cost < best[0] - 1e-12:
            best = (cost, list(path))
    return best


def test_viterbi_of_many_series_and_of_split_ones():
    import random

    import numpy as np

    rnd = random.Random(3)
    series = [[(Decimal(rnd.choice([0, 7, 70000, 300000000])), rnd.choice([None, None, 1, 10**4, 10**8])) for _ in range(rnd.randrange(1, 9))] for _ in range(30)]
    flat = [f for s in series for f in s]
    logs, real = (np.repeat(a, len(flat), 0) for a in un.state_table(["money"]))
    x = np.array([float(r.log10()) if r else np.nan for r, _ in flat])
    stated = np.array([un.FACTORS["money"].index(f) if f else -1 for _, f in flat])
    cost = un.emissions(x, stated, logs, real, np.full(len(flat), 9.0), np.full(len(flat), 0.8))
    starts = np.cumsum([0, *map(len, series)])[:-1]
    together = un.viterbi(x, cost, logs, starts).tolist()
    for s, a in zip(series, starts):
        one = un.decode([r for r, _ in s], [f for _, f in s], "money", (9.0, 0.8))
        assert [un.FACTORS["money"][k] for k in together[a : a + len(s)]] == one
        assert all(f in (None, g) for (_, f), g in zip(s, one))
        if len(s) > 3:  # in parts
            cuts = sorted(rnd.sample(range(1, len(s)), 2))
            ends = list(zip([0, *cuts], [*cuts, len(s)]))
            parts = [(un.transfer(x[a + i : a + j], cost[a + i : a + j], logs[a + i : a + j]), x[a + i], x[a + j - 1]) for i, j in ends]
            path = [un.FACTORS["money"].index(g) for g in one]
            whole = un.transfer(x[a : a + len(s)], cost[a : a + len(s)], logs[a : a + len(s)]).min()
            linked = un.link_parts(parts, logs[0])
            for (i, j), (first, last) in zip(ends, linked):
                assert (path[i], path[j - 1]) == (first, last)
            assert whole < un.NEVER


def test_a_series_over_many_partitions(spark):
    import random

    rnd = random.Random(5)
    rows = [("meta", f"i{k:03}", "公司" if k % 3 else "另一", f"2020-01-{k % 28 + 1:02}", 0, 1, "money", str(rnd.choice([5, 50000, 0, 400000000])), rnd.choice([None, None, 10**4, 1])) for k in range(90)]
    found = spark.createDataFrame(rows * 2, "src string, item_id string, device string, at string, no int, measure_id int, dimension string, raw string, factor long")
    one = {(r.item_id, r.no): r.decoded for r in un.decode_units(found).collect()}
    many = un.decode_units(found, part_rows=5)
    assert many.rdd.getNumPartitions() > 5
    rows = many.collect()
    assert len(rows) == 90 and {(r.item_id, r.no): r.decoded for r in rows} == one


@pytest.mark.parametrize("raws,stated", [(["5", "50000"], [10**8, None]), (["12", "13", "130000"], [None, None, None]), (["0", "3"], [None, 10**4]), (["2.5"], [None]), (["7", "70", "0.0007"], [None, 10**4, None])])
def test_viterbi_against_all_paths(raws, stated):
    raws = [Decimal(r) for r in raws]
    cost, path = brute(raws, stated, "money", (9.0, 0.8))
    got = un.decode(raws, stated, "money", (9.0, 0.8))
    assert all(s is None or s == g for s, g in zip(stated, got))
    import math

    def total(p):
        c = sum(((math.log10(abs(r)) + math.log10(f) - 9.0) / 0.8) ** 2 / 2 for r, f, s in zip(raws, p, stated) if r and not s)
        c += sum((0 if a == b else 0.7) + (min(8.0, (math.log10(abs(y)) + math.log10(b) - math.log10(abs(x)) - math.log10(a)) ** 2 / 0.5) if x and y else 0) for x, y, a, b in zip(raws, raws[1:], p, p[1:]))
        return c

    assert total(got) == pytest.approx(cost)


def test_words():
    assert un.words_value("捌亿柒仟壹佰壹拾万元整") == 871100000 and un.words_value("壹万零伍拾元整") == 10050 and un.words_value("拾元整") == 10


U = "unit_id string, doc_id string, unit_no int, type string, text string, content string, table_text string, extra int"


def test_frames(spark):
    rows = [
        ("d#1", "d", 1, "text", "除另有说明外，本文件金额均以千元列示。", None, None, 1), ("d#2", "d", 2, "table", None, None, "项目: 营业收入，本期: 7，上期: 7。", 1), ("d#2", "d", 2, "table", None, None, "项目: 营业收入，本期: 7，上期: 7。", 2),
        ("d#3", "d", 3, "text", " ", "单位：元", None, 1), ("d#4", "d", 4, "table", None, None, "项目: 营业收入，本期: 7，上期: -9。", 1), ("d#2500", "d", 2500, "table", None, None, "项目: 净利润，本期: 1，上期: 2。", 1),
        ("e#1", "e", 1, "table", None, None, "项目: 净利润，本期: 100000000，上期: 2亿元。", None), ("f#1", "f", 1, "table", None, None, None, None), (None, None, None, None, None, None, None, None),
    ]
    meta = [("i", 0, "i0", None, "<p>若非特别标注，以下金额按亿元填列。</p>", "x"), ("i", 1, "i1", "净利润为2，上年同期为2。", None, "x"), ("j", 0, "j0", "净利润为3元", None, "x"), (None, None, None, None, None, None)]
    m = spark.createDataFrame(meta, "index_dir string, rid int, id string, embed_text string, raw_content string, doc_factor string")
    measures = spark.createDataFrame([(*r, "x") for r in ROWS], "measure_id int, name_zh string, name_en string, dimension string, common_unit string")
    units = spark.createDataFrame(rows, U)
    got = sorted((r.src, r.item_id, r.measure_id, r.value_common) for r in un.common_values(units, m, measures).collect())
    assert got == [("content_list", "d#2", 1, 7000), ("content_list", "d#2500", 2, 1000), ("content_list", "d#2500", 2, 2000), ("content_list", "d#4", 1, -9), ("content_list", "d#4", 1, 7), ("content_list", "e#1", 2, 100000000), ("content_list", "e#1", 2, 200000000), ("meta", "i1", 2, 200000000), ("meta", "j0", 2, 3)]
    assert un.common_values(units.limit(0), m.limit(0), measures).count() == 0 and un.common_values(units, m, measures.limit(0)).count() == 0


def test_last_before_in_blocks(spark):
    import random

    rnd = random.Random(1)
    rows = [(g, o, rnd.choice([None, None, rnd.randrange(9)])) for g in "ab" for o in range(200)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    want = {(g, o): next((v for x, p, v in sorted(rows, key=lambda r: -r[1]) if x == g and p < o and v is not None), None) for g, o, _ in rows}
    for block in (7, 1000):
        assert {(r.g, r.o): r.out for r in un.last_before(df, "g", "o", "v", "out", block).collect()} == want


def test_prefilters_pass_what_is_read(spark):
    said = ["除另有说明外,金额以千元计", "除特别说明外，金额以千元计。", "若非特别标注，金额按千元", "如无特别注明，以千元", "本文件所列以千元", "除另有说明外，金额以千元⼈民币", "⾦额单位：千元", "除另有說明".replace("說", "说") + "，以千元", "如无特别㊟明，以千元"]
    texts = ["营业收入5", "ｒｅｖｅｎｕｅ 5", "营业　收入5", "营业**收入**5", "营业＊＊收入＊＊5", "营业\n收入5", "net profit 5", "[[a|营业]]收入5", "营业收⼊5", "营业收入⑤", "NET PROFIT 5"]
    F = un.F
    held = spark.createDataFrame([(t,) for t in said + ["单位：千元"]], "t string").filter(un.may_say(F.col("t")))
    assert held.count() == len(said) + 1
    assert all(un.statement(t, True) == 1000 or un.statement(t, False) == 1000 for t in said)
    assert all(un.from_text(t, M, 1000) for t in texts)
    plain = spark.createDataFrame([("其他，文字（一）",)], "t string")
    assert plain.filter(un.may_say(F.col("t")) | un.may_name(F.col("t"), ROWS)).count() == 0
    measures = spark.createDataFrame([(*r, "") for r in ROWS], "measure_id int, name_zh string, name_en string, dimension string, common_unit string")
    meta = spark.createDataFrame([(f"x{i}", 0, f"s{i}", s, s) for i, s in enumerate(said[:6])] + [(f"x{i % 6}", i + 1, f"i{i}", t, t) for i, t in enumerate(texts)], "index_dir string, rid int, id string, embed_text string, raw_content string")
    units = spark.createDataFrame([("s", "d", 0, "text", said[0], None, None), ("t", "d", 2, "table", None, None, "项目: ｒｅｖｅｎｕｅ，本期: 7，上期: 8。")], "unit_id string, doc_id string, unit_no int, type string, text string, content string, table_text string")
    got = {(r.item_id, r.value_common) for r in un.common_values(units, meta, measures).collect()}
    assert got == {(f"i{i}", 5000) for i in range(len(texts))} | {("t", 7000), ("t", 8000)}
