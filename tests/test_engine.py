import ast
from pathlib import Path
from urllib.error import HTTPError

import pytest
from pyspark.sql import functions as F

from tessella.operators import chunking, intent, providers, registry, retrieval
from tessella.plans.engine import Engine, Parameters
from tessella.streaming import ingest

ROOT = Path(__file__).resolve().parent.parent
UNITS = "doc_id string, unit_no int, type string, page_idx int, page string, text string, content string, items array<string>, table_body string, table_text string, text_level int, loaded_at int"


def units(spark):
    rows = [(f"{y}-03-01 公司{k} {y}年年度报告", n, "text", n, None, t, None, None, None, None, None, 1) for k, y in ((1, 2021), (2, 2022)) for n, t in enumerate(["营业收入 增长 变压器", "电缆 铜材 采购", f"董事会 公告 {y}"], 1)]
    rows += [("2021-05-05 公司3 关于回购的公告", 1, "table", 0, None, None, None, None, "<table></table>", "项目: 回购，本期: 1。\n项目: 股份，本期: 2。", None, 1)]
    return spark.createDataFrame(rows, UNITS)


def test_search(spark):
    e = Engine(spark)
    rows = e.index(e.chunk(units(spark), "rows", 12)).cache()
    assert rows.count() == 8 and rows.filter("doc_type = 'notice'").count() == 2
    q = spark.createDataFrame([(1, "回购 股份"), (2, "电缆采购")], "query_id long, q string")
    got = e.search(q, rows, Parameters(dense_per_index=2, sparse_per_index=3, rerank_top_k=3), reranker=_lexical).collect()
    best = {r.query_id: r for r in got if r.rerank_rank == 1}
    assert best[1].doc_id.endswith("公告") and best[1].restored == "项目: 回购，本期: 1。\n项目: 股份，本期: 2。"
    assert "电缆" in best[2].content and "\n\n" in best[2].restored
    with pytest.raises(ValueError):
        e.candidates(q, rows, Parameters(), dense=False, sparse=False)
    found, what, trace = e.route_and_search("2022年年度报告的电缆", rows, dense=False)
    assert what.years == [2022] and what.doc_type == "report" and all("2022年" in r.doc_id for r in found.collect()) and trace.to_dict()["stages"][0]["name"] == "intent"
    again = e.index(e.chunk(units(spark), "rows"), done=rows.select("index_dir").distinct())
    assert again.count() == 0


def _lexical(d):
    from tessella.operators.retrieval import lexical_scores

    return lexical_scores(d, "q", "content").select("query_id", "position", "rerank_score")


def test_intent(spark):
    assert intent.parse_answer('text {"search_filters": {"years": [2021, "2021", 2020], "category": "report"}} end').to_dict() == {"doc_type": "report", "years": [2021, 2020], "quarters": [], "confidence": 0.9}
    assert intent.parse_answer("nothing") is None and intent.parse_answer(None) is None and intent.parse_answer('{"search_filters": []}') is None
    got, trace = intent.analyse(spark, "去年净利润", 2024, lambda q: "broken")
    assert (got.doc_type, got.years) == ("report", [2023]) and trace.to_dict()["stages"][0]["details"] == {"source": "rules"}
    assert intent.prune({"a": None, "b": [None, {"c": None, "d": 0}]}) == {"b": [{"d": 0}]}


def test_providers(spark):
    calls = []

    def flaky(batch):
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return batch

    assert providers.retrying(flaky, 3, 0)([1]) == [1] and providers.token_estimate("abcde") == 2 and providers.token_estimate("") == 1
    with pytest.raises(OSError):
        providers.retrying(lambda b: (_ for _ in ()).throw(OSError()), 2, 0)([1])
    df = spark.createDataFrame([("a b",), (None,), ("",), ("ab",)], "t string")
    v = [r.v for r in providers.embed(df, "t", "v", providers.HashedEmbedder(8), 1).collect()]
    assert v[0] == v[3] and sum(v[0]) == 2 and v[1] is None and v[2] is None
    assert [r.g for r in providers.generate(df, "t", "g", lambda p: [x and x.upper() for x in p], 2).collect()] == ["A B", None, "", "AB"]


def test_stream_ingest(spark, tmp_path):
    """Documents in several batches, late units, repeats; the chunks are those of all units at once."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    u = units(spark).cache()
    late = u.filter("doc_id like '2022%' AND unit_no = 2")
    for batch in (u.filter("doc_id like '2021%'"), u.filter("doc_id like '2022%' AND unit_no <> 2"), u.filter("doc_id like '2021%'"), late):
        batch.write.mode("append").parquet(src)
        q = ingest.ingest(ingest.unit_stream(spark, src, u.schema), out, str(tmp_path / "state"))
        q.awaitTermination(120)
        assert q.exception() is None
    cols = ["id", "doc_id", "type", "content", "ord"]
    want = {tuple(r) for r in chunking.assemble(u, "rows").select(cols).collect()}
    got = [tuple(r) for r in ingest.current(spark, out).select(cols).collect()]
    assert len(got) == len(want) and set(got) == want
    assert spark.read.parquet(f"{out}/units").count() == u.count()


def test_stream_stops_at_a_broken_output(spark, tmp_path):
    src, out = str(tmp_path / "in"), tmp_path / "out"
    (out / "units" / "batch=0" / "bucket=1").mkdir(parents=True)
    (out / "units" / "batch=0" / "bucket=1" / "part-0.parquet").write_text("broken")
    units(spark).write.parquet(src)
    q = ingest.ingest(ingest.unit_stream(spark, src, units(spark).schema), str(out), str(tmp_path / "state"))
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark raises
        q.awaitTermination(120)
    assert not (out / "chunks").exists()


def test_answers(spark):
    e = Engine(spark)
    rows = e.index(e.chunk(units(spark), "rows", 12)).cache()
    q = spark.createDataFrame([(1, "回购 股份"), (2, "电缆采购"), (3, None)], "query_id long, q string")
    told, sources = e.answer(q, rows, lambda chats: [f"{c[0]}|{c[1][1][:12]}" for c in chats], "系统", p=Parameters(dense_per_index=2, sparse_per_index=3, rerank_top_k=2))
    got = {r.query_id: r.answer for r in told.collect()}
    assert set(got) == {1, 2, 3} and got[1].startswith("('system', '系统')|")
    s = sources.collect()
    assert {r.ref for r in s} == {1, 2} and {r.type for r in s} <= {"table_full", "text"} and all(r.content for r in s)

    def model(chats):
        text = chats[0][0][1]
        return [f"好的：< “{c[0][1].rsplit('：', 1)[1].strip()} 改写” >" if "<改写后的语句>" in c[0][1] and "复述" not in c[0][1] else "没有" if "复述" in c[0][1] else " 一段报道 " for c in chats] if text else []

    routes = {(r.query_id, r.name): r.q for r in retrieval.expand_questions(q.filter("query_id = 1"), model).collect()}
    assert routes == {(1, "orig"): "回购 股份", (1, "mq_1"): "回购 股份 改写", (1, "mq_2"): "回购 股份 改写", (1, "hyde"): "一段报道"}
    assert retrieval.expand_questions(q, lambda chats: 1 / 0).count() == 3
    merged = e.expand_and_search(q.filter("query_id < 3"), rows, model, Parameters(dense_per_index=2, sparse_per_index=2, rerank_top_k=3)).collect()
    assert len({(r.query_id, r.id) for r in merged}) == len(merged) and {r.query_id for r in merged} == {1, 2} and "orig" not in merged[0].asDict()
    scope = {r.query_id: r.strategy for r in registry.decisions(e.route_questions(spark.createDataFrame([(1, "2022年年度报告的电缆"), (2, "天气")], "query_id long, q string"), rows)).collect()}
    assert scope == {1: "year_buckets", 2: "global"}


def test_provider_errors_and_usage(spark):
    calls = []

    def refused(batch):
        calls.append(1)
        raise HTTPError("http://localhost", 400, "bad", {}, None)

    with pytest.raises(HTTPError):
        providers.retrying(refused, 3, 0)([1])
    assert len(calls) == 1
    df = spark.createDataFrame([("ab",), (None,), ("abcd",), (" ",), ("abcdef",)], "t string").coalesce(1)
    billed = providers.embed_counting(df, "t", "v", "n", lambda texts: ([[1.0]] * len(texts), 7), 2).collect()
    assert sum(r.n for r in billed) == 14 and [r.v is None for r in billed] == [False, True, False, True, False]
    assert [r.n for r in providers.embed_counting(df, "t", "v", "n", lambda texts: ([[1.0]] * len(texts), None), 2).collect()] == [1, 0, 2, 0, 3]
    broken = providers.embed(df, "t", "v", lambda texts: 1 / 0 if "abcd" in texts else [[1.0]] * len(texts), 1, failed_as_null=True).collect()
    assert [r.v is None for r in broken] == [False, True, True, True, False]


def test_nothing_but_the_entry_imports_the_optional_part():
    for p in [*ROOT.glob("tessella/**/*.py"), *ROOT.glob("tests/*.py")]:
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text(encoding="utf-8"))):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p


def test_entry(spark):
    import __spark_entry__ as e

    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs) and "bm25_topk_per_index" in qs
    assert e.entry(spark).select("query_id", F.col("rank")).schema.names == ["query_id", "rank"]
