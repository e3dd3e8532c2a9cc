import math
import re
from collections import Counter

import pandas as pd
import pytest

from tessella.llm import reading as rd
from tessella.llm.queries import table

WORDS = {1: "小猫 喜欢 吃鱼 今天 很好", 3: "董事会 审议 通过 议案 公告", 5: "递延 所得税 负债 公允 价值 计量"}


def plain_terms(text):
    t = (text or "").lower()
    out = re.findall(r"[a-zß-öø-ɏ]+", t)
    for run in re.findall(r"[一-鿿㐀-䶿]+", t):
        out += [run[i : i + 2] for i in range(len(run) - 1)]
    return out


def test_terms_against_a_plain_way():
    texts = ["中文分词 and Words, words", None, "", "单 字", "ABC abc\nabc中文分", "é naïve x÷y"]
    doc, slot = rd.terms(texts)
    seen = {}
    for d, t in enumerate(texts):
        mine = Counter(int(s) for s in slot[doc == d])
        want = plain_terms(t)
        assert sum(mine.values()) == len(want)
        seen[d] = (mine, Counter(want))
    # equal terms get equal slots in any document and place
    assert sorted(seen[0][0].values()) == sorted(seen[0][1].values())
    assert set(seen[4][0]) & set(seen[0][0])


def test_grades_against_naive_bayes(spark):
    import random

    rnd = random.Random(1)
    make = lambda g: "".join(rnd.choice(WORDS[g].split()) for _ in range(12))
    docs = [(i, make(g), g) for i in range(60) for g in [rnd.choice([1, 3, 5])]]
    df = spark.createDataFrame([(i, t, "x", 9) for i, t, _ in docs] + [(100, None, "x", 1), (101, "", "x", 1), (102, "略", "x", 1), (103, make(5) * 3000, "x", 1)], "doc_id int, text string, kind string, grade int")
    labels = spark.createDataFrame([(i, g, "r") for i, _, g in docs[:30]] + [(0, docs[0][2], "r2"), (None, 3, "r"), (1, None, "r")], "doc_id int, grade int, rater string")
    got = {r.doc_id: r.grade for r in rd.grade_documents(df.drop("grade"), labels, "doc_id", "text", "grade").collect()}
    lm = {g: Counter(w for i, t, x in docs[:30] if x == g for w in plain_terms(t)) for g in (1, 3, 5)}
    vocab = set().union(*lm.values())
    score = lambda t, g: sum(math.log((lm[g][w] + rd.ALPHA) / (sum(lm[g].values()) + rd.ALPHA * len(vocab))) for w in plain_terms(t) if w in vocab)
    for i, t, g in docs:
        assert got[i] == max((1, 3, 5), key=lambda k: score(t, k)) == g
    assert got[100] is got[101] is got[102] is None and got[103] == 5


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "中文文本有很多字词")], "doc_id int, text string")
    none = spark.createDataFrame([], "doc_id int, grade int")
    assert rd.grade_documents(df, none, "doc_id", "text", "grade").first().grade is None
    assert rd.grade_documents(df.limit(0), none, "doc_id", "text", "grade").count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = table(spark, d, "reading_labels")
    train, test = labels.filter("doc_id % 4 <> 2"), labels.filter("doc_id % 4 = 2").toPandas()
    if not len(test):
        pytest.skip("no labels are held out")
    docs = table(spark, d, "documents").join(rd.F.broadcast(labels.select("doc_id")), "doc_id")
    got = rd.grade_documents(docs, train, "doc_id", "text", "grade").toPandas()
    both = pd.merge(got, test, on="doc_id")
    assert (both.grade_x == both.grade_y).mean() > 0.97 and ((both.grade_x >= 4) == (both.grade_y >= 4)).mean() > 0.98
