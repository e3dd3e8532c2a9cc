import re
import unicodedata
from collections import defaultdict
from itertools import combinations

from tessella.llm import sitelines as sl


def norm(line):
    return re.sub(r"\d+", "0", "".join(c for c in unicodedata.normalize("NFKC", line).lower() if c.isalnum()))


def rows():
    out = []
    for s, docs in (("a", 40), ("b", 12), ("c", 2)):
        for d in range(docs):
            body = [f"正文{chr(0x4E00 + d)}{chr(0x5000 + d * 7)}", "", f"第 {d} 页 共 {d * 3} 页 ＡＢ", f"扫码关注{s}"]
            if d % 20 == 0:
                body.append("罕见行")
            if d % 5 == 0:
                body += ["版权所有", "翻印必究"]
            out.append((f"{s}{d}#1", f"{s}{d}", s, "\n".join(body)))
    out += [("n1", "n1", None, "扫码关注a"), ("n2", "a0", "a", None), ("n3", None, "a", "扫码关注a"), ("e", "a1", "a", ""), ("long", "a2", "a", "长行" * 50000 + "\n扫码关注A！")]
    return out + out[:5]


def brute(data, total_docs):
    docs = defaultdict(set)
    for k, d, s, t in data:
        if t is not None and s is not None and d is not None:
            for x in t.split("\n"):
                if norm(x):
                    docs[s, norm(x)].add(d)
    good = {key for key, v in docs.items() if len(v) >= 3 and len(v) >= 0.1 * len(total_docs[key[0]]) - 1e-9}
    return {(k, i) for k, d, s, t in data if t is not None and s is not None and d is not None for i, x in enumerate(t.split("\n")) if (s, norm(x)) in good}


def frames(spark, data):
    df = spark.createDataFrame(data, "id string, doc_id string, source string, content string").withColumn("lines", sl.F.lit(1)).withColumn("s", sl.F.lit("x"))
    docs = df.filter("source is not null and doc_id is not null").select(sl.F.col("source").alias("s"), sl.F.xxhash64("doc_id").alias("d"))
    lines = sl.cut(sl.line_table(df, "id", "doc_id", "source", "content"))
    return df, docs, lines, sl.cut(sl.frequent_lines(lines, docs))


def test_against_brute_force(spark):
    data = rows()
    total = defaultdict(set)
    for _, d, s, _ in data:
        if d is not None:
            total[s].add(d)
    df, docs, lines, frequent = frames(spark, data)
    at = sl.cut(sl.occurrences(lines, frequent))
    at = sl.of_sequences(at, sl.prefix_span(at, docs, max_gap=1))
    assert {(r.k, r.line_no) for r in at.collect()} == brute(data, total)
    clean = {r.id: r.clean for r in sl.remove_lines(df.dropDuplicates(["id"]), "id", "content", at).collect()}
    assert clean["n2"] is None and clean["n1"] == "扫码关注a" and clean["c0#1"].endswith("扫码关注c\n罕见行\n版权所有\n翻印必究")
    assert clean["a0#1"] == f"正文{chr(0x4E00)}{chr(0x5000)}\n\n罕见行" and clean["long"] == "长行" * 50000


def test_prefix_span_patterns(spark):
    data = rows()
    df, docs, lines, frequent = frames(spark, data)
    ids = {norm(x): int(sl.line_ids([x])[0][0]) for x in ("版权所有", "翻印必究", "扫码关注a", "第1页共2页AB")}
    found = {(r.s, tuple(r.pattern)): r.support for r in sl.prefix_span(sl.occurrences(lines, frequent), docs).collect()}
    assert found["a", (ids["版权所有"], ids["翻印必究"])] == 8
    assert found["a", (ids["第0页共0页ab"] if "第0页共0页ab" in ids else ids[norm("第1页共2页AB")], ids["扫码关注a"])] == 40
    # every prefix of a frequent sequence is frequent, with at least its support
    assert all(found[s, p[:-1]] >= n for (s, p), n in found.items() if len(p) > 1)


def test_identifiers():
    a = sl.line_ids(["Ｐ１２，x\nP-9 x。\n ，。\nﬁn ½", None, ""])
    assert len(a[0]) == 4 and a[0][0] == a[0][1] != a[0][3] and a[0][2] == 0
    assert a[1].tolist() == [0] and a[2].tolist() == [0]


def test_empty(spark):
    df, docs, lines, frequent = frames(spark, [("x", "y", "z", None)])
    assert lines.count() == 0 and frequent.count() == 0 and sl.occurrences(lines, frequent).count() == 0
    at = sl.occurrences(lines, frequent)
    assert sl.of_sequences(at, sl.prefix_span(at, docs, max_gap=1)).count() == 0 and sl.remove_lines(df, "id", "content", at).first().clean is None


def test_prefix_span_over_whole_documents(spark):
    """Four lines with bodies and blanks between, over two chunks whose ids are not in document order; all against brute force."""
    data = []
    for d in range(4):
        data += [(f"z{d}", f"d{d}", "a", 1, f"首行\n正文{chr(0x4E00 + d)}\n\n次行"), (f"y{d}", f"d{d}", "a", 2, f"三行\n首行\n段{chr(0x5000 + d)}\n末行{d}")]
    data += [("x", "d9", "a", 1, "末行1\n首行"), ("w", "d8", "a", None, "次行"), ("v", "d8", "a", 5, "首行")]
    df = spark.createDataFrame(data + data[:3], "id string, doc_id string, source string, ord int, content string")
    docs = df.select(sl.F.col("source").alias("s"), sl.F.xxhash64("doc_id").alias("d"))
    lines = sl.cut(sl.line_table(df, "id", "doc_id", "source", "content", "ord"))
    at = sl.cut(sl.occurrences(lines, sl.frequent_lines(lines, docs)))
    got = [(tuple(r.pattern), r.support) for r in sl.prefix_span(at, docs).collect()]

    name = {x: int(sl.line_ids([x])[0][0]) for x in ("首行", "次行", "三行", "末行1")}
    documents = [[name[x] for x in t] for t in [["首行", "次行", "三行", "首行", "末行1"]] * 4 + [["末行1", "首行"], ["首行", "次行"]]]
    held = defaultdict(set)
    for i, t in enumerate(documents):
        for n in range(1, len(t) + 1):
            for c in combinations(t, n):
                held[c].add(i)
    assert len(got) == len(dict(got)) and dict(got) == {p: len(v) for p, v in held.items() if len(v) >= 3}
    assert dict(got)[tuple(name[x] for x in ("首行", "次行", "三行", "首行", "末行1"))] == 4
    # the options: at most two lines, next to each other in one chunk
    near = {tuple(r.pattern): r.support for r in sl.prefix_span(at, docs, 2, 1).collect()}
    assert {p: n for p, n in near.items() if len(p) > 1} == {(name["三行"], name["首行"]): 4}
    assert {len(p) for p in map(tuple, (r.pattern for r in sl.prefix_span(at, docs, 3).collect()))} == {1, 2, 3}
