import json

from tessella.sources import files as sf


def test_documents_and_units(spark, tmp_path):
    nested = [{"type": "text", "text": " ", "content": "一", "page_idx": 0, "text_level": 1, "sub": [{"type": "equation", "value": "x=1"}]}, {"type": "header", "text": "kopf", "z": {"type": "text", "raw": "tief", "page": "3"}}, [[{"type": "list", "items": ["a", {"text": "b"}, {"no": 1}, 5, " "]}]], {"type": "table", "table_body": "<table></table>", "page_idx": 2}, "str", None, 7]
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "2020-01-01 标题+x_content_list.json").write_text(json.dumps(nested, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "bad_content_list.json").write_text("{not json")
    (tmp_path / "other.json").write_text("[]")
    docs = sf.read_documents(spark, str(tmp_path))
    assert sorted(r.doc_id for r in docs.collect()) == ["2020-01-01 标题+x", "bad"]
    assert [r.doc_id for r in sf.rejects(docs).collect()] == ["bad"]
    got = sf.units(docs).orderBy("unit_no").collect()
    assert [(r.unit_no, r.type, r.text) for r in got] == [(1, "text", "一"), (2, "equation", "x=1"), (3, "text", "tief"), (4, "list", None), (5, "table", None)]
    assert got[3]["items"] == ["a", "b", " "] and got[2].page == "3" and got[0].text_level == 1 and got[4].page_idx == "2"
    assert [r.type for r in sf.units(docs, nested=False).orderBy("unit_no").collect()] == ["text", "list", "table"]


def test_lines(spark, tmp_path):
    p = tmp_path / "x"
    (p / "y").mkdir(parents=True)
    (p / "a.jsonl").write_text('{"id": "1", "order": 3, "meta": {"year": 2020}, "more": 1}\n\nnot json\n{"id": "2"}\n', encoding="utf-8")
    (p / "y" / "b.jsonl").write_text('{"id": "3", "content": "字"}\n', encoding="utf-8")
    got = {r.id: r for r in sf.read_lines(spark, str(p), sf.CHUNK).collect()}
    assert set(got) == {"1", "2", "3"} and got["1"].meta.year == 2020 and got["3"].content == "字"
    out = tmp_path / "out"
    df = sf.read_lines(spark, str(p), sf.CHUNK)
    sf.write_lines(df, str(out))
    sf.write_lines(df.limit(1), str(out), "append")
    text = "".join(f.read_text(encoding="utf-8") for f in out.glob("*.json"))
    assert text.count("\n") == 4 and "字" in text and "null" not in text
    assert sf.read_or_empty(spark, str(tmp_path / "missing"), sf.TABLE).count() == 0
    sf.write_json(df.select("id"), str(tmp_path / "j"))
    assert sorted(line for f in (tmp_path / "j").glob("part*") for line in f.read_text().splitlines()) == ['{"id":"1"}', '{"id":"2"}', '{"id":"3"}']


def test_uploads(spark, tmp_path):
    for name, n in (("a.pdf", 10), ("b.pdf", 2000), ("c.txt", 1), ("d.pdf", 5)):
        (tmp_path / name).write_bytes(b"x" * n)
    f = sf.file_sizes(spark, str(tmp_path))
    log = tmp_path / "log"
    log.write_text([r.path for r in f.collect() if "d.pdf" in r.path][0] + "\n\n")
    assert [r.path.rsplit("/", 1)[1] for r in sf.to_upload(f, sf.read_log(spark, str(log)), 1000).collect()] == ["a.pdf"]


def test_listings_and_order(spark, tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "meta.jsonl").write_text(f'{{"id": "{name}1"}}\n\n{{"id": "{name}2"}}\n')
    (tmp_path / "a" / "vectors.bin").write_text("x")
    (tmp_path / "b" / "vectors.bin").write_text("x")
    assert [r.id[0] for r in sf.read_lines_in_order(spark, str(tmp_path), sf.CHUNK).collect()] == list("aabbcc")
    assert [r.index_dir.rsplit("/", 1)[1] for r in sf.index_dirs(spark, str(tmp_path), ("vectors.bin", "meta.jsonl")).collect()] == ["a", "b"]
    assert {r.path.split("/")[-2]: r.lines for r in sf.line_counts(spark, str(tmp_path)).collect()} == {"a": 2, "b": 2, "c": 2}
    assert [r.doc_id for r in sf.read_documents(spark, str(tmp_path), ".jsonl", 2).collect()] == ["meta", "meta"]


def test_sheets(spark, tmp_path):
    import zipfile

    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "qa.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>问题</t></si><si><r><t>标准</t></r><r><t>回答</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>净利润？</t></is></c><c r="B2"><v>5.5</v></c></row><row r="4"><c r="B4"><v>7</v></c></row></sheetData></worksheet>')
    got = sf.records(sf.read_sheet(spark, str(tmp_path))).orderBy("row").collect()
    assert [(r.row, r.record) for r in got] == [(2, {"问题": "净利润？", "标准回答": "5.5"}), (4, {"问题": None, "标准回答": "7"})]


def test_candidate_log(spark, tmp_path):
    df = spark.createDataFrame([(1, "i", k, float(k)) for k in range(50)], "query_id int, index_dir string, rid int, score double")
    for _ in range(2):
        sf.write_candidates(df, str(tmp_path / "log"), "score")
    rows = spark.read.json(str(tmp_path / "log")).collect()
    assert len(rows) == 60 and min(r.rid for r in rows) == 20
