"""Operators on small frames of literal rows."""

import pytest
from pyspark.sql import functions as F

from tenderflow.operators import evidence, fields, ledger, lots, outline, requirements, scores, structure
from tenderflow.plans import catalog
from tenderflow.settings import Settings
from tenderflow.sources import files


def test_table_candidates(spark):
    rows = [("d", 5, "t", 0, 0, "最高限价（万元）"), ("d", 5, "t", 0, 1, "350.5"), ("d", 5, "t", 1, 0, "招标人"), ("d", 5, "t", 1, 1, ""), ("d", 5, "t", 2, 0, "某市财政局"), ("d", 5, "t", 3, 0, "开标时间"), ("d", 5, "t", 3, 1, "详见附件")]
    found = fields.table_candidates(spark.createDataFrame(rows, "doc_id string, ord int, table_id string, row int, col int, text string"))
    assert {(r.field_key, r.value_normalized) for r in found.collect()} == {("price_limit", "3505000"), ("tenderer", "某市财政局")}


def test_pattern_layers(spark):
    """Each form of a value is found, the surest form first; OCR spaces and units are no obstacle."""
    said = {
        "最高投标限价（人民币）：¥86,000,000 元。": ("price_limit", "86000000", 0.7),
        "最高限价：人民币捌仟陆佰万元整": ("price_limit", "86000000", 0.74),
        "招标控制价：10,000,000 元": ("price_limit", "10000000", 0.73),
        "拦标价：350.5万元": ("price_limit", "3505000", 0.73),
        "投标保证金：人民币伍拾万元整（¥5,000,000.00）。": ("security_deposit", "500000", 0.73),
        "招标编号：S C A N - 2 0 2 6 - G C - 0 0 9 9": ("tender_no", "SCAN-2026-GC-0099", 0.74),
        "法定代表人：姓名": None,
        "招标编号：0711-XXOTLXXX13XXX": None,
        "投标保证金：合同价的1%": None,
        "招标人：见招标公告": ("tenderer", "见招标公告", 0.66),
        "统一社会信用代码：见招标公告": None,
    }
    blocks = spark.createDataFrame(list(enumerate(said)), "doc_id int, text string").selectExpr("*", "0 ord")
    got = {r.doc_id: (r.field_key, r.value_normalized, r.confidence) for r in fields.text_candidates(blocks).collect()}
    assert got == {i: want for i, want in enumerate(said.values()) if want}


def test_digits_that_repeat_are_values(spark):
    """An amount like 111111 is found in texts and tables, a name with a long number too; dashes are noise still."""
    said = {"最高投标限价：111111元。": "111111", "最高投标限价：1000000000元。": "1000000000", "项目名称：工程10000000000000号。": "工程10000000000000号", "项目名称：————————。": None, "联系电话：00000000": None, "项目名称：———————1。": None}
    blocks = spark.createDataFrame(list(enumerate(said)), "doc_id int, text string").selectExpr("*", "0 ord")
    assert {r.doc_id: r.value_normalized for r in fields.text_candidates(blocks).collect()} == {i: want for i, want in enumerate(said.values()) if want}
    cells = spark.createDataFrame([("d", 5, "t", 0, 0, "最高限价"), ("d", 5, "t", 0, 1, "333333元")], "doc_id string, ord int, table_id string, row int, col int, text string")
    assert [r.value_normalized for r in fields.table_candidates(cells).collect()] == ["333333"]


def test_titles_only_fill_gaps(spark):
    blocks = spark.createDataFrame([("d", 0, 1, "评标办法（综合评估法）"), ("d", 1, 0, "评标办法：最低价法"), ("e", 0, 1, "评标办法（综合评估法）")], "doc_id string, ord int, level int, text string")
    cells = spark.createDataFrame([], "doc_id string, ord int, table_id string, row int, col int, text string")
    near = spark.createDataFrame([], "doc_id string, ord int, field_key string")
    got = {(r.doc_id, r.value_normalized) for r in fields.merged(fields.all_candidates(blocks, near, cells)).collect()}
    assert got == {("d", "最低价法"), ("e", "综合评估法")}


def test_title_candidates(spark):
    heads = spark.createDataFrame([("d", 1, "第三章 评标办法（综合评估法）"), ("d", 2, "评标办法（其他）"), ("e", 1, "评标办法")], "doc_id string, ord int, text string")
    assert [(r.doc_id, r.value_normalized) for r in fields.title_candidates(heads).collect()] == [("d", "综合评估法")]


def test_file_scopes(spark):
    named = spark.createDataFrame([("d", 0, "结算审核包1新.docx"), ("d", 1, "文件.docx"), ("d", 2, "公告.docx")], "doc_id string, file_no int, source_file string")
    blocks = spark.createDataFrame([("d", 0, 0, ""), ("d", 0, 1, "东河特高压线路工程 结算审核包1"), ("d", 1, 0, "监理包12"), ("d", 2, 0, "公告")], "doc_id string, file_no int, ord int, text string")
    got = {r.file_no: (r.lot, r.project) for r in lots.file_scopes(named, blocks).collect()}
    assert got == {0: ("结算审核包1", "东河特高压线路工程"), 1: ("监理包12", ""), 2: (None, "")}


def test_header_column(spark):
    header = F.array(*map(F.lit, ("分标名称", "包号", "包名称")))
    got = spark.range(1).select(lots.header_column(header, ("包名称",), ("分标",)).alias("a"), lots.header_column(header, ("标包",), ("分标",)).alias("b"), lots.header_column(header, ("限价",)).alias("c")).first()
    assert (got.a, got.b, got.c) == (2, 0, None)


def test_items_of_score_tables(spark):
    """Scores by form, header or place; categories from short cells; blank and missing cells."""
    tables = {
        "a": ["序号|项目|得分|页", "1|技术标（60分）||", "2|甲| 7.5 |9", "3|乙|有|8", "4|丙|5 分|9", " | ||", "价格||", "5|丁|见|后"],
        "b": ["号|项", "3|价格技术", "戊|己|x\n5分\ny|100", "庚|一二三四五六七八九十一二三技术|6|-"],
    }
    rows = [(1, t, i, [c if c else None for c in r.split("|")]) for t, said in tables.items() for i, r in enumerate(said)] + [(1, "b", 4, None), (1, "b", 5, [])]
    got = scores.classic_rows(spark.createDataFrame(rows, "doc_id long, table_id string, row int, cells array<string>").repartition(3))
    want = {("a", 2, "technical", "甲", 7.5, "9"), ("a", 3, "technical", "乙", 8.0, "8"), ("a", 4, "technical", "丙", 5.0, "9"), ("b", 2, "technical", "己", 100.0, "100"), ("b", 3, "technical", "一二三四五六七八九十一二三技术", 6.0, "-")}
    assert {tuple(r)[1:] for r in got.collect()} == want


def test_lines_of_a_number_without_a_part(spark, tmp_path):
    """The least part's quantity, whatever the order of the lines; no part comes last, after the greatest."""
    lines = [(1, 1, None, 7.0), (1, 1, 2**63 - 1, 9.0), (1, 2, 5, None), (1, 2, 5, 4.0), (1, 2, 5, 3.0), (1, 2, 8, 1.0), (2, 3, None, 6.0)]
    for k, order in enumerate((lines, lines[::-1])):
        spark.createDataFrame(order, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
        got = catalog.QUERIES["score_rows"](spark, f"{tmp_path}/{k}").collect()
        assert {tuple(r) for r in got} == {(1, 3, f"part-{2**63 - 1}", 9.0, "commercial"), (1, 5, "part-5", 3.0, "commercial"), (2, 7, None, 6.0, "technical")}


def test_outline_reuse(spark):
    cases = [("包1", None, 3, None, True), ("包1", "包1", 3, None, True), ("包1", "包2", 1, "包2", False), (None, "监理包2", 1, "包2", True), (None, "包2", 2, None, False)]
    rows = spark.createDataFrame([c[:4] for c in cases], "cached string, asked string, n int, single string")
    got = [r.ok for r in rows.select(outline.reusable(F.col("cached"), F.col("asked"), F.col("n"), F.col("single")).alias("ok")).collect()]
    assert got == [c[4] for c in cases]


def test_bid_outline(spark):
    said = [(1, "第一章 公告"), (1, "第六章 投标文件格式"), (2, "一、商务文件"), (3, "（一）偏差表"), (2, "二、技术文件"), (1, "附件")]
    tree = structure.sections(spark.createDataFrame([("d", i, level, t) for i, (level, t) in enumerate(said)], "doc_id string, ord int, level int, text string"))
    scores = spark.createDataFrame([("d", "technical", 0, "施工方案"), ("d", "technical", 1, "技术文件 5分")], "doc_id string, bucket string, ord int, name string")
    placed, added = outline.bid_outline(tree, scores)
    assert [(r.name, r.bucket) for r in placed.orderBy("ord").collect()] == [("商务文件", "commercial"), ("偏差表", "commercial"), ("技术文件", "technical")]
    assert added.first().added == ["施工方案"]


def test_requirements_build(spark):
    said = ["投标人近5年内完成类似业绩3项，附合同。", "技术负责人1名，须为高级工程师。", "未列入失信被执行人。"]
    blocks = spark.createDataFrame([("d", i, t) for i, t in enumerate(said)], "doc_id string, ord int, text string")
    scores = spark.createDataFrame([("d", "S-1", "企业业绩")], "doc_id string, score_id string, name string")
    got = {r.type: r for r in requirements.build(blocks, scores).collect()}
    assert set(got) == {"performance", "team", "credit"}
    assert got["performance"].req_id == "R-001" and got["performance"].scoring_refs == ["S-1"] and got["team"].scoring_refs == [] and got["team"].parsed["count"] == "1"


def test_skipped_levels_and_deep_first_heading(spark):
    levels = [3, 1, 3, 2, 0, 3]
    tree = structure.sections(spark.createDataFrame([("d", i, n, f"t{i}") for i, n in enumerate(levels)], "doc_id string, ord int, level int, text string"))
    assert [(r.ord, r.block_end, r.parent) for r in tree.orderBy("ord").collect()] == [(0, 1, None), (1, 6, None), (2, 3, 1), (3, 6, 1), (5, 6, 3)]
    assert {r.ord: r.path for r in structure.section_paths(tree).collect()}[5] == "t1 > t3 > t5"


def test_value_cell_search_wraps(spark):
    cells = spark.createDataFrame([("d", "t", 0, 0, "a"), ("d", "t", 2, 0, " "), ("d", "t", 3, 1, "b")], "doc_id string, table_id string, row int, col int, text string")
    hits = spark.createDataFrame([("d", "t", 1), ("d", "t", 4)], "doc_id string, table_id string, hit_row int")
    assert {r.hit_row: r.text for r in evidence.value_cell(cells, hits).collect()} == {1: "b", 4: "a"}


def test_warnings_and_settings(spark):
    docs = spark.createDataFrame([("a", "pdf_scan"), ("b", "docx"), ("c", "doc")], "doc_id string, route string")
    assert {r.doc_id for r in ledger.quality_warnings(docs).collect()} == {"a", "c"}
    spark.conf.set("spark.tenderflow.child_chars", "200")
    assert Settings.of(spark).child_chars == 200 and Settings.of(spark).zone_window == 150
    spark.conf.unset("spark.tenderflow.child_chars")


def test_allowed_paths(tmp_path):
    inside = tmp_path / "a.docx"
    inside.write_text("x")
    assert files.allowed_path(str(inside), [str(tmp_path)]) == str(inside)
    assert files.allowed_path("hdfs://x/y", []) == "hdfs://x/y"
    with pytest.raises(PermissionError):
        files.allowed_path(str(tmp_path / ".." / "b"), [str(tmp_path)])


def test_shared_folder_is_needed_off_local(spark):
    from types import SimpleNamespace

    from tenderflow.shared import shared_path

    remote = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: {}, master="spark://x:7077"))
    with pytest.raises(ValueError):
        shared_path(remote, "x")


def test_terminal_events_are_sent(spark, tmp_path):
    from tenderflow.streaming import tasks

    schema = "task_id long, seq long, ts timestamp, state string"
    rows = spark.createDataFrame([(1, 0, "submitted"), (1, 1, "completed"), (2, 0, "working")], "task_id long, seq long, state string").selectExpr("task_id", "seq", "timestamp'2024-01-01' ts", "state")
    rows.write.parquet(str(tmp_path / "events"))
    events = tasks.source(spark, str(tmp_path / "events"), rows.schema)
    assert events.isStreaming and schema
    out = str(tmp_path / "sent")
    tasks.notify(events, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "checkpoint")).awaitTermination()
    assert [(r.task_id, r.state) for r in spark.read.parquet(out).collect()] == [(1, "completed")]
    artifacts = spark.createDataFrame([(1, "report.json")], "task_id long, name string")
    both = tasks.with_artifacts(rows.select("task_id", "state"), artifacts)
    assert sorted((r.kind, r.name) for r in both.filter("task_id = 1").collect() if r.name) == [("artifact-update", "report.json")]


def test_sources_of_evidence(spark):
    found = spark.createDataFrame([("d", "b1", None, "x"), ("d", None, "t1", "y"), ("d", None, None, "项目名称：东河大桥工程的施工招标"), ("d", None, None, "")], "doc_id string, block_id string, table_id string, snippet string")
    blocks = spark.createDataFrame([("d", "b1", "f1", 0, "正文"), ("d", "b2", "f2", 1, "一、项目名称：东河大桥工程的施工招标公告"), ("d", "b3", "f3", 2, "项目名称：东河大桥工程的施工招标公告")], "doc_id string, block_id string, source_file string, ord int, text string")
    tables = spark.createDataFrame([("d", "t1", "f3")], "doc_id string, table_id string, source_file string")
    got = {(r.snippet, r.source_file) for r in evidence.with_sources(found, blocks, tables).collect()}
    assert got == {("x", "f1"), ("y", "f3"), ("项目名称：东河大桥工程的施工招标", "f2"), ("", None)}


def test_pages_of_probes_within_their_document(spark):
    probes = spark.createDataFrame([("d", "b1", "the quick brown fox jumps over"), ("e", "b1", "the quick brown fox jumps over"), ("d", "b2", "abc")], "doc_id string, block_id string, text string")
    pages = spark.createDataFrame([("d", 1, "nothing here"), ("d", 2, "so the quick  brown fox jumps over it"), ("d", 3, "the quick brown fox jumps over")], "doc_id string, page_no int, text string")
    assert [(r.doc_id, r.block_id, r.page_no) for r in evidence.first_pages(probes, pages).collect()] == [("d", "b1", 2)]


def test_quotes_of_all_lengths(spark):
    from tenderflow.operators import quotes

    body = "".join(chr(97 + (i * i + 3 * i) % 26) + (" " if i % 7 == 0 else "") for i in range(900))
    asked = [(n, body[200 : 200 + n]) for n in (7, 9, 12, 20, 40, 70, 150, 400)] + [(999, "not in any text at all, surely")]
    texts = [(1, body), (2, body[230:].replace(" ", "\n")), (3, None), (4, "")]
    got = {(r.text_id, r.quote_id) for r in quotes.held(spark.createDataFrame(texts, "id long, said string"), spark.createDataFrame(asked, "id long, said string")).collect()}
    squeezed = lambda t: "".join((t or "").split())
    want = {(i, n) for i, t in texts for n, q in asked if len(squeezed(q)) >= 8 and squeezed(q) in squeezed(t)}
    assert got == want and want


def test_a_run_leaves_nothing(spark):
    import os

    from tenderflow import shared

    path = shared.shared_path(spark, "some")
    spark.range(3).write.parquet(path)
    assert path.startswith(shared.run_folder(spark)) and os.path.isdir(path)
    shared.end_run(spark)
    assert not os.path.exists(shared.run_folder(spark))
    assert shared.shared_path(spark, "other") and os.path.isdir(shared.run_folder(spark))
