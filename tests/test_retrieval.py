import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import evaluate, registry, retrieval
from tessella.operators import index as ix
from tessella.session import lagged, row_numbers


def index(df):
    return ix.SparseIndex.build(df, "source", "doc_id", "text")


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, modal string, index_dir string, rid int, id string, score_raw double")


def test_rrf_by_folder_and_by_id(spark):
    df = hits(spark, [(1, "faiss", "F", 0, "x", 0.9), (1, "faiss", "F", 1, "y", 0.5), (1, "bm25", "B", 0, "z", 9.0), (1, "bm25", "B", 1, "x", 5.0)])
    by_folder = {(r.index_dir, r.rid): r.score_rrf for r in retrieval.rrf(df, 0.5, ["index_dir", "rid"]).collect()}
    assert by_folder == pytest.approx({("F", 0): 0.5 / 61, ("F", 1): 0.5 / 62, ("B", 0): 0.5 / 61, ("B", 1): 0.5 / 62})
    by_id = {r.id: r.score_rrf for r in retrieval.rrf(df, 0.5, ["id"]).collect()}
    assert by_id == pytest.approx({"x": 0.5 / 61 + 0.5 / 62, "z": 0.5 / 61, "y": 0.5 / 62})
    assert retrieval.rrf(df.limit(0), 0.5, ["id"]).count() == 0


def test_prune_order(spark):
    df = hits(spark, [(1, "faiss", "F", k, i, s) for k, (i, s) in enumerate([("a", 9.0), ("b", 8.0), ("a", 7.0), (None, 6.0), (None, 5.0), ("c", 4.0)])]).withColumn("table_id", F.when(F.col("rid").isin(0, 1), "t"))
    # b falls with the table of a, then four remain, of which the second a and the second null go
    got = retrieval.prune(df, "score_raw", 4).orderBy("pre_rank").collect()
    assert [(r.id, r.pre_rank) for r in got] == [("a", 1), (None, 3)]


def test_rerank(spark):
    docs = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "d")], "query_id int, position int, id string")
    same = retrieval.rerank(docs, None, 2).orderBy("query_id", "rerank_rank").collect()
    assert [(r.id, r.rerank_score) for r in same] == [("a", 3.0), ("b", 2.0), ("d", 1.0)]
    given = spark.createDataFrame([(1, 2, 0.9), (1, 0, 0.1), (1, None, 0.5), (1, 1, None)], "query_id int, position int, rerank_score double")
    got = retrieval.rerank(docs, given, 5).orderBy("query_id", "rerank_rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(1, "c"), (1, "a"), (2, "d")]


def test_context(spark):
    rows = [("i", "d", k, None, None, t) for k, t in enumerate("abcde", 1)] + [("j", "d", k, "t" if 2 <= k <= 4 else None, 10 - k if 2 <= k <= 4 else None, t) for k, t in enumerate("abcde", 1)]
    chunks = spark.createDataFrame(rows, "index_dir string, doc_id string, ord int, table_id string, row_index int, content string")
    hit = spark.createDataFrame([(1, "i", "d", 3, None, "c"), (2, "i", "d", 1, None, "a"), (3, "j", "d", 3, "t", "c"), (4, "i", "d", None, None, "base"), (5, "x", "d", 1, "t", None)], "hit_id int, index_dir string, doc_id string, ord int, table_id string, content string")
    got = {r.hit_id: r.restored for r in retrieval.restore_context(hit, chunks, 1).collect()}
    assert got == {1: "b\n\nc\n\nd", 2: "a\n\nb", 3: "a\n\nd\nc\nb\n\ne", 4: "base", 5: ""}
    assert {r.hit_id: r.restored for r in retrieval.restore_context(hit, chunks, 0).collect()}[3] == "d\nc\nb"


def test_pages_and_routes(spark):
    df = spark.createDataFrame([(None,), (1,), (2,), (3,), (4,)], "page int")
    assert sorted(r.page or 0 for r in retrieval.page_filter(df, 2, 3).collect()) == [0, 2, 3]
    routes = spark.createDataFrame([(1, 0, 1, "a"), (1, 1, 1, "b"), (1, 1, 2, "a"), (1, 2, 1, None), (1, 2, 2, None)], "query_id int, route int, rank int, id string")
    assert [(r.id, r.position) for r in retrieval.merge_routes(routes).orderBy("position").collect()] == [("a", 1), ("b", 2), (None, 3)]


def test_answer_context_is_cut(spark):
    df = spark.createDataFrame([(1, 1, "d", 2, "text", "x" * 50, False), (1, 2, None, None, None, "y" * 500, True)], "query_id int, rank int, doc_id string, page int, type string, content string, is_table boolean")
    full = retrieval.answer_context(df, 0, 10).first().context
    assert full == "[1] doc=d page=2 type=text\n" + "x" * 10 + "…\n\n[2] doc= page=None type=\n" + "y" * 500
    cut = retrieval.answer_context(df, 0, 10, most=1300, margin=1000).first().context
    assert cut.startswith(full[:200]) and cut.endswith("]") and len(cut) < len(full)


def test_bm25_against_naive(spark):
    docs = [(1, "s", "总资产 a a b"), (2, "s", "b c"), (3, "s", ""), (4, "s", None), (5, "t", "a"), (6, "t", "资产 c c c")]
    df = spark.createDataFrame(docs, "doc_id int, source string, text string")
    q = spark.createDataFrame([(7, "a 资 a"), (8, "?")], "query_id int, q string")
    tok = lambda t: __import__("re").findall("[一-鿿]|[A-Za-z0-9_]+", t or "")
    want = {}
    for idx in ("s", "t"):
        rows = {d: tok(t) for d, s, t in docs if s == idx}
        n, avgdl = len(rows), sum(map(len, rows.values())) / len(rows)
        df_ = Counter(t for r in rows.values() for t in set(r))
        raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df_.items()}
        idf = {t: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, v in raw.items()}
        for qid, text in ((7, "a 资 a"), (8, "?")):
            score = {d: sum(idf.get(t, 0) * r.count(t) * 2.5 / (r.count(t) + 1.5 * (0.25 + 0.75 * len(r) / avgdl)) for t in tok(text) if t in r) for d, r in rows.items()}
            for k, d in enumerate(sorted(score, key=lambda d: (-round(score[d], 9), d))[:3], 1):
                want[qid, idx, d] = (k, pytest.approx(score[d]))
    got = {(r.query_id, r.idx, r.rid): (r.rank, r.score) for r in retrieval.bm25_top_k(q, index(df), 3).collect()}
    assert got == want
    assert retrieval.bm25_top_k(q.limit(0), index(df), 3).count() == 0 == retrieval.bm25_top_k(q, index(df.limit(0)), 3).count()


def stored_bytes(spark):
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())


def test_bm25_pairs_are_not_stored(spark):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{w}" for w in rng.zipf(1.3, n) % 40)
    df = spark.createDataFrame([(i, "st"[i % 3 == 0], text(60)) for i in range(1500)] + [(2000 + i, "u", "") for i in range(3)], "doc_id int, source string, text string").cache()
    q = spark.createDataFrame([(i, text(6)) for i in range(300)] + [(900, "nowhere"), (901, None), (902, "")], "query_id int, q string").cache()
    before = stored_bytes(spark)
    built = index(df)
    full = {tuple(r) for r in retrieval.bm25_top_k(q, built, 4).collect()}
    assert stored_bytes(spark) - before < 2_000_000  # 303 x 1,503 scores and the tokens took more
    assert len(full) == 303 * 11 and {r[1:] for r in full if r[0] == 900} == {r[1:] for r in full if r[0] == 902} == {r[1:] for r in full if r[0] == 901}
    assert {r[1:] for r in full if r[0] == 900} == {(s, d, 0.0, k) for s, ds in (("s", (1, 2, 4, 5)), ("t", (0, 3, 6, 9)), ("u", (2000, 2001, 2002))) for k, d in enumerate(ds, 1)}
    place = lambda rows: {(r[0], r[1], r[4]): (r[2], pytest.approx(r[3])) for r in rows}
    assert {k: (v[0], v[1].expected) for k, v in place(retrieval.bm25_top_k(q, built, 4, block=70, part_rows=90).collect()).items()} == place(full)


def test_dense_against_naive(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (60, 4)).astype(float)
    df = spark.createDataFrame([(i % 3, i, v[i].tolist()) for i in range(60)] + [(0, 99, None)], "idx int, rid int, v array<double>")
    q = spark.createDataFrame([(k, v[k].tolist()) for k in range(5)] + [(9, None)], "query_id int, q array<double>")
    for block in (2, 100):
        got = {}
        for r in retrieval.dense_top_k(q, df, 4, block).collect():
            got.setdefault((r.query_id, r.idx), {})[r.rank] = r.rid
        for k in range(5):
            for idx in range(3):
                best = sorted((i for i in range(60) if i % 3 == idx), key=lambda i: (-(v[i] @ v[k]), i))[:4]
                assert [got[k, idx][n] for n in range(1, 5)] == best
    assert retrieval.dense_top_k(q.limit(0), df, 4).count() == 0


def test_index_is_stored_without_shuffled_terms(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(f"w{w}" for w in rng.zipf(1.2, n) % 3000)
    df = spark.createDataFrame([(f"a document of reports, number {i // 5:04}", i % 5, text(int(rng.integers(0, 80)))) for i in range(3000)] + [(None, 0, "w1")], "idx string, rid int, text string").cache()
    facts = df.select("idx").distinct().select("idx", F.when(F.col("idx") < "a document of reports, number 0500", "report").alias("doc_type"), F.when(F.col("idx") > "a document of reports, number 0100", 2021).alias("year"))
    before = stored_bytes(spark)
    ix.SparseIndex.store(df, "idx", "rid", "text", facts, str(tmp_path / "stored"))
    assert stored_bytes(spark) - before < 200_000  # only facts are kept; tokens, terms and frequencies took megabytes
    assert {p.name for p in (tmp_path / "stored/terms").iterdir() if p.is_dir()} == {"doc_type=report", "doc_type=__HIVE_DEFAULT_PARTITION__"}
    built = ix.SparseIndex.build(df, "idx", "rid", "text")
    with monkeypatch.context() as m:
        m.setattr(ix, "PART_ROWS", 1)  # as for an index with a large sub-index
        ix.SparseIndex.store(df.filter("idx < 'a document of reports, number 0002'"), "idx", "rid", "text", facts, str(tmp_path / "large"))
    assert ix.SparseIndex.read(spark, str(tmp_path / "large")).stats.count() == 2
    got = ix.SparseIndex.read(spark, str(tmp_path / "stored"))
    for name in ("tokens", "terms", "stats"):
        rows = lambda x: sorted((tuple(round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in r) for r in getattr(x, name).filter("idx IS NOT NULL").select(*sorted(getattr(built, name).columns)).collect()), key=str)
        assert rows(got) == rows(built)


def test_most_keeps_the_last_row_of_all(spark):
    # 30 sub-indexes, none but the first of which has the term: the last row is that of the last sub-index
    rows = spark.createDataFrame([(f"d{i:02}", r, "x y z" if i else f"a x{r}") for i in range(30) for r in range(4)], "idx string, rid int, text string")
    q = spark.createDataFrame([(1, "a"), (2, "y"), (3, "none")], "query_id int, q string")
    built = ix.SparseIndex.build(rows, "idx", "rid", "text")
    full = retrieval.bm25_top_k(q, built, 3).collect()
    want = set()
    for n in (1, 2, 3):
        own = sorted((r for r in full if r.query_id == n), key=lambda r: (-round(r.score, 9), r.idx, r.rid))
        want |= {tuple(r) for r in own[:5] + own[-1:]}
    for part_rows in (2, 100):
        assert {tuple(r) for r in retrieval.bm25_top_k(q, built, 3, 5, part_rows=part_rows).collect()} == want


ROWS = [("r21", "report", "2021"), ("ru", "report", "unknown"), ("n21", "notice", "2021"), ("n22", "notice", "2022"), ("x", None, "2021")]
ROUTES = [
    ("report", [2021], None, {"r21"}, {"r21"}), ("report", [2030], None, {"r21", "ru", "n21", "n22"}, {"ru"}), ("report", [], None, set(), {"ru"}), ("notice", [], None, "all", "all"),
    (None, [2021], None, {"r21", "n21"}, {"r21", "n21"}), (None, [2022], None, {"n22"}, {"ru", "n22"}), (None, [], None, "all", "all"), ("notice", [], "both", set(), {"ru"}), (None, [2021], "report", {"r21"}, {"r21"}),
]


@pytest.mark.parametrize("kind,years,override,dense,sparse", ROUTES)
def test_routes(spark, kind, years, override, dense, sparse):
    reg = [spark.createDataFrame([(k, d, t, y) for d, t, y in ROWS], "kind string, index_dir string, doc_type string, year_key string") for k in ("faiss", "bm25")]
    got = registry.route(*reg, kind, years, override).collect()
    everything = {d for d, _, _ in ROWS}
    for name, want in (("faiss", dense), ("bm25", sparse)):
        assert {r.index_dir for r in got if r.kind == name} == (everything if want == "all" else want)


def test_routes_of_a_batch(spark):
    """All questions in one job, with the results of each alone."""
    reg = [spark.createDataFrame([(k, d, t, y) for d, t, y in ROWS], "kind string, index_dir string, doc_type string, year_key string") for k in ("faiss", "bm25")]
    cases = [*ROUTES, ("other", [2021], None, {"r21", "n21"}, set()), (None, None, None, "all", "all")]
    q = spark.createDataFrame([(k, t, y, o, 1) for k, (t, y, o, _, _) in enumerate(cases)], "query_id int, doc_type string, years array<int>, override string, kind int")
    routed = registry.route_batch(q, *reg).cache()
    listed = {name: registry.routed_dirs(routed, reg[k], name).collect() for k, name in enumerate(("faiss", "bm25"))}
    scopes = {(r.query_id, r.kind): r.scope for r in routed.collect()}
    for k, (_, _, _, *wants) in enumerate(cases):
        for name, want in zip(("faiss", "bm25"), wants):
            everything = {d for d, t, _ in ROWS if t or scopes.get((k, name)) == "all"} if scopes.get((k, name)) in ("named", "all") else None
            got = everything or {r.index_dir for r in listed[name] if r.query_id == k}
            assert got == ({d for d, _, _ in ROWS} if want == "all" else want), (k, name)
    assert registry.route_batch(q, reg[0].limit(0), reg[1].limit(0)).filter("scope <> 'all'").count() == 0


def test_building_the_registries(spark):
    schema = "index_dir string, rid int, doc_id string, doc_meta struct<doc_type: string, year: int, quarter: string, source_date: string>"
    dense = spark.createDataFrame([("a", 0, "a", ("report", 2020, None, None)), ("a", 1, "x", (None, None, None, None)), ("b", 0, "b", (None, None, None, None))], schema)
    sparse = spark.createDataFrame([("a", 0, "a", ("notice", None, "Q1", None)), ("c", 3, "c", (None, 2019, None, None))], schema)
    docs, index = registry.build(dense, sparse, "财报库", "公告库")
    assert {r.doc_id: (r.doc_type, r.year, r.quarter) for r in docs.collect()} == {"a": ("report", 2020, "Q1"), "b": ("report", None, None), "c": ("notice", 2019, None)}
    assert {(r.kind, r.index_dir, r.doc_type) for r in index.collect()} == {("faiss", "财报库/a", "report"), ("faiss", "财报库/b", "report"), ("bm25", "公告库/a", "report"), ("bm25", "公告库/c", "notice")}


def test_reports(spark):
    df = spark.createDataFrame([("a", 3, 0.2, 1.0), ("a", 1, 0.5, 3.0), ("b", 0, 0.7, 1.0)], "strategy string, chunk_count long, score double, time_sec double")
    got = {r.strategy: (r.avg_score, r.avg_time, r.total_chunks, r.files) for r in evaluate.weighted_report(df).collect()}
    assert got["a"] == (pytest.approx(0.275), 2.0, 4, 2) and got["b"][0] == 0.0
    v = spark.createDataFrame([("x", 1, [1.0, 0.0]), ("x", 2, [0.0, 1.0]), ("x", 3, [0.0, 2.0]), ("y", 1, [1.0])], "g string, n int, v array<double>")
    assert {r.g: r.score for r in evaluate.adjacent_distance(v, "g", "n", "v").collect()} == {"x": pytest.approx(0.5), "y": 0.0}


def test_incremental(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    done = [spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("b",)], "k string")]
    assert sorted(r.k or "" for r in ix.pending(df, done, "k").collect()) == ["", "a", "c"]
    old = spark.createDataFrame([("a", " "), ("b", "alt")], "k string, old string")
    got = {r.k: r.out for r in ix.resume(df.withColumn("new", F.lit("neu")), old, ["k"], "old", "new", "out").collect()}
    assert got == {"a": "neu", "b": "alt", "c": "neu", None: "neu"}


def test_hot_keys_give_the_same_numbers_and_neighbours(spark):
    rows = [(1 if k % 3 else 2 + k % 5, float(k % 7), k) for k in range(300)]
    df = spark.createDataFrame(rows, "query_id int, s double, rid int")
    order = [F.col("s").desc(), F.col("rid")]
    plain = {(r.query_id, r.rid): r.n for r in row_numbers(df, ["query_id"], order, "n").collect()}
    split = row_numbers(df, ["query_id"], order, "n", hot_rows=50)
    assert split.columns == ["query_id", "s", "rid", "n"] and {(r.query_id, r.rid): r.n for r in split.collect()} == plain and len(plain) == 300
    plain = {(r.query_id, r.rid): r.b for r in lagged(df, ["query_id"], "rid", "s", "b").collect()}
    assert {(r.query_id, r.rid): r.b for r in lagged(df, ["query_id"], "rid", "s", "b", hot_rows=50).collect()} == plain


def test_null_tables_of_a_query_are_no_group(spark):
    df = hits(spark, [(1, "faiss", "F", k, f"i{k}", float(k)) for k in range(40)]).withColumn("table_id", F.when(F.col("rid") == 5, "t"))
    assert retrieval.dedup(df, ["table_id"], [F.col("score_raw").desc()], False).count() == 40
    assert retrieval.dedup(df, ["table_id"], [F.col("score_raw").desc()], True).count() == 2


def test_candidate_filter(spark):
    df = spark.createDataFrame([("d", "text", 1), ("d", "table", 2), ("e", "text", None), (None, None, 2)], "doc_id string, type string, page int")
    count = lambda **how: retrieval.candidate_filter(df, **how).count()
    assert [count(), count(doc_id="d"), count(kind="text"), count(doc_id="d", kind="text"), count(first=2), count(last=1), count(doc_id="", kind=None)] == [4, 2, 2, 1, 3, 2, 4]


def test_best_over_all_sub_indexes(spark):
    """The rows of a query do not grow with the sub-indexes, and are the best of the full search and the least."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 4))
    rows = spark.createDataFrame([(f"d{i // 4:03}", i, v[i].tolist(), "甲乙 a b".split()[0] * (i % 5) + " a" * (i % 3) + f" x{i} y{i} z{i}") for i in range(400)], "idx string, rid int, v array<double>, text string")
    q = spark.createDataFrame([(k, v[k].tolist(), "a 甲") for k in range(3)], "query_id int, q array<double>, t string")
    full = retrieval.dense_top_k(q, rows, 3).toPandas().sort_values(["query_id", "score"], ascending=[True, False])
    few = retrieval.dense_top_k(q, rows.repartition("idx"), 3, most=10).toPandas().sort_values(["query_id", "score"], ascending=[True, False])
    assert few.groupby("query_id").size().tolist() == [11] * 3
    for k in range(3):
        a, b = full[full.query_id == k], few[few.query_id == k]
        assert b.rid.tolist() == [*a.rid[:10], a.rid.iloc[-1]]
    built = ix.SparseIndex.build(rows, "idx", "rid", "text")
    asked = q.select("query_id", F.col("t").alias("q"))
    full = retrieval.bm25_top_k(asked, built, 3).toPandas()
    few = retrieval.bm25_top_k(asked, built, 3, 10).toPandas()
    assert few.groupby("query_id").size().tolist() == [11] * 3
    for k in range(3):
        a = full[full.query_id == k].assign(s=lambda x: x.score.round(9)).sort_values(["s", "idx", "rid"], ascending=[False, True, True])
        b = few[few.query_id == k].assign(s=lambda x: x.score.round(9)).sort_values(["s", "idx", "rid"], ascending=[False, True, True])
        assert b.rid.tolist()[:10] == a.rid.tolist()[:10] and b.score.min() == a.score.min()


def test_stored_index(spark, tmp_path):
    df = spark.createDataFrame([(1, "s", "总资产 a"), (2, "s", "b c"), (3, "t", "a b")], "doc_id int, source string, text string")
    facts = spark.createDataFrame([("s", "report", 2021), ("t", None, None)], "idx string, doc_type string, year int")
    index(df).write(str(tmp_path), facts)
    q = spark.createDataFrame([(1, "a")], "query_id int, q string")
    want = {tuple(r) for r in retrieval.bm25_top_k(q, index(df), 2).collect()}
    assert {tuple(r) for r in retrieval.bm25_top_k(q, ix.SparseIndex.read(spark, str(tmp_path)), 2).collect()} == want
    routed = ix.SparseIndex.read(spark, str(tmp_path), (F.col("doc_type") == "report") & (F.col("year") == 2021))
    assert {r.idx for r in retrieval.bm25_top_k(q, routed, 2).collect()} == {"s"}
