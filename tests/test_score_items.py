"""Score items of all forms of tables, with their categories, lots and order."""

import pytest
from pyspark.sql import functions as F

from tenderflow.functions import scoring
from tenderflow.operators import score_items, structure
from tenderflow.plans import report

CLASSIC = [
    ["序号", "评分项", "分值", "评分标准"],
    ["商务标（40分）", "", "", ""],
    ["1", "企业业绩", "20", "每提供一项得5分，最多20分，须附合同复印件"],
    ["2", "信誉", "20分", "优得15-20分，良得10-14分"],
    ["技术标（60分）"],
    ["3", "这一格的文字超过了三十个字所以它不可能是评分项的名称只能作为评分的细则来读", "60", ""],
    ["投标报价评分标准：以基准价计算", "", "", ""],
    ["", "", "", ""],
]
GRID = [
    ["序号", "项目", "评审内容及分值", "项目内容"],
    ["1", "信誉评价（18分）", "信用（8分）", "AAA级得8分"],
    ["2", "信誉评价（18分）", "", "AA级得5分"],
    ["3", "信誉评价（18分）", "奖项（10分）", "每项得2分"],
    ["4", "扣分项（-5分）", "不良行为（-5分）", "每次扣1分"],
]
MATRIX = [["序号", "分标", "权重设置", "价格公式"], ["", "分标", "权重设置", "价格公式", "下浮系数", "正向系数"], ["1", "换流站", "30：20：50", "公式一", "0.5", "1"], ["", "", "", ""]]
OTHER = [["奖项", "分值"], ["甲", "5分"], ["乙", "6分"]]
ROWS = "doc_id string, table_id string, row int, cells array<string>"


def rows_of(spark, tables, doc="d"):
    return spark.createDataFrame([(doc, t, i, c) for t, rows in tables.items() for i, c in enumerate(rows)], ROWS)


def test_items_of_all_forms(spark):
    rows = rows_of(spark, {"t1": CLASSIC, "t2": GRID, "t3": MATRIX, "t4": OTHER})
    blocks = [(0, "heading", 1, "第三章 评分办法", None), (1, "paragraph", 0, "施工包1", None), (2, "table", 0, "", "t1"), (3, "heading", 1, "商务评分标准", None), (4, "paragraph", 0, "说明：", None), (5, "table", 0, "", "t2"), (6, "heading", 1, "价格", None), (7, "table", 0, "", "t3"), (8, "table", 0, "", "t4")]
    b = spark.createDataFrame([("d", *x) for x in blocks], "doc_id string, ord int, type string, level int, text string, table_id string")
    items, totals = score_items.extract(rows, b, structure.sections(b), structure.zones(b))
    got = {r.score_id: r for r in items.collect()}
    shown = {k: (r.table_id, r.name, r.max_score, r.rule_type, r.lot, r.confidence) for k, r in got.items()}
    assert shown == {
        "C-001": ("t2", "信用", 8.0, "binary", "施工包1", 0.9),  # its section is the scoring zone
        "C-002": ("t2", "奖项", 10.0, "binary", "施工包1", 0.9),
        "C-003": ("t2", "不良行为", 5.0, "binary", "施工包1", 0.75),
        "C-004": ("t1", "企业业绩", 20.0, "binary", "施工包1", 0.9),
        "C-005": ("t1", "信誉", 20.0, "graded", "施工包1", 0.9),
        "T-001": ("t1", "这一格的文字超过了三十个字所以它不可能是", 60.0, "binary", "施工包1", 0.9),
        "P-001": ("t1", "投标报价评分", 0.0, "formula", "施工包1", 0.7),
        "P-002": ("t3", "投标报价评分（换流站）", 50.0, "formula", "换流站", 0.88),
    }
    assert got["C-004"].numbers.unit_score == 5.0 and list(got["C-004"].proofs) == ["合同"] and got["C-005"].numbers.grades[0].max == 20
    assert got["C-001"].rule_text == "AAA级得8分 / AA级得5分" and got["C-001"].extra == {"group": "信誉评价"} and got["C-003"].extra["penalty"] == "true"
    assert got["P-002"].formula == "公式一；下浮系数=0.5；正向系数=1；负向系数=" and got["P-001"].formula.startswith("投标报价评分标准")
    assert sorted((r.table_id, r.category, r.lot, r.total) for r in totals.collect()) == [("t1", "commercial", "施工包1", 40.0), ("t1", "technical", "施工包1", 60.0), ("t2", "commercial", "施工包1", 18.0)]
    states = {r.category: (r.declared_total, r.computed_total, r.state) for r in score_items.checks(items, totals).collect()}
    assert states == {"commercial": (58.0, 58.0, "passed"), "technical": (60.0, 60.0, "passed")}


def test_rows_alone_and_repeats(spark):
    rows = rows_of(spark, {"a": CLASSIC, "b": CLASSIC, "c": OTHER})
    items, totals = score_items.extract(rows)
    assert {r.table_id for r in items.collect()} == {"a"} and items.count() == 4 and totals.count() == 4
    assert score_items.extract(rows.limit(0))[0].count() == 0


def test_a_table_over_two_pages(spark):
    rows = rows_of(spark, {"a": CLASSIC[:4], "b": [["4", "服务", "5", "好得5分"], ["5", "", "", ""]]})
    tables = spark.createDataFrame([("d", 1, "a", 1, 1, 4, False, False), ("d", 2, "b", 2, 2, 4, True, True)], "doc_id string, ord int, table_id string, first_page int, last_page int, n_cols int, first_row_blank boolean, last_row_blank boolean")
    items, _ = score_items.extract(score_items.joined_islands(rows, tables))
    assert {(r.table_id, r.row, r.name, r.category) for r in items.filter("name = '服务'").collect()} == {("a", 4, "服务", "commercial")}


@pytest.mark.parametrize("header, form", [(["评分项", "分值"], "classic"), (["条款号", "分值"], None), (["奖项"], None), (["说明", "数值"], "classic")])
def test_forms(spark, header, form):
    rows = rows_of(spark, {"t": [header, ["甲", "5分"], ["乙", "6分"]]})
    assert score_items.table_facts(rows).select(F.col("form")).first().form == form


def test_usage_labels(spark):
    rows = [(True, False, "performance", "评分要求-业绩要求"), (True, True, "leader", "评分要求/标书要求-人员简历"), (False, True, "plan", "标书要求-编制要求"), (False, False, "price", ""), (True, False, "team", "评分要求-人员要求"), (True, True, "own", "评分要求/标书要求-own")]
    frame = spark.createDataFrame(rows, "s boolean, d boolean, kind string, want string")
    assert frame.filter(scoring.usage_label(F.col("s"), F.col("d"), F.col("kind")) != F.col("want")).count() == 0


def test_whole_report(spark):
    said = [
        (1, "第一章 招标公告", None), (0, "项目名称：东河大桥工程。招标编号：ZB-2026-001。", None), (0, "采购人：东河水务局。投标截止时间：2026年11月20日09时30分。", None), (0, "", "lots"),
        (1, "第二章 评标办法", None), (0, "包1施工", None), (0, "", "t1"), (0, "★投标人须近5年内完成类似业绩3项，附合同复印件。", None), (0, "", "no"),
        (1, "第三章 投标文件格式", None), (2, "一、技术部分", None), (2, "施工方案", None), (2, "二、商务部分", None), (0, "开标时间：5009年1月2日。", None),
    ]
    b = spark.createDataFrame([("d", i, level, t, "table" if ref else "heading" if level else "paragraph", ref, f"b-{i}", "a.docx") for i, (level, t, ref) in enumerate(said)], "doc_id string, ord int, level int, text string, type string, table_id string, block_id string, source_file string")
    tables = {
        "lots": [["包号", "包名称", "最高限价（万元）", "招标范围"], ["包2", "桥面", "120", "桥面施工"], ["包1", "桥墩", "300.5", "桥墩施工"]],
        "t1": [["序号", "评分项", "分值", "评分标准"], ["技术标（60分）"], ["1", "质量方案", "60分", "优得50-60分"], ["商务标（40分）"], ["2", "业绩", "30分", "每项得10分"]],
        "no": [["序号", "否决投标情形"], ["1", "投标人资格不符合要求的按否决投标处理"]],
    }
    ledger = spark.createDataFrame([("d", "DONE"), ("d", "PENDING")], "doc_id string, status string")
    out = report.analyse(b, rows_of(spark, tables), ledger=ledger, as_of=F.lit("2026-06-01").cast("date"))
    got = {name: frame.collect() for name, frame in out.items() if name not in ("chunks", "block_windows", "blocks", "section_paths")}
    assert {r.field_key: r.value_normalized for r in got["fields"]} == {"project_name": "东河大桥工程", "tender_no": "ZB-2026-001", "tenderer": "东河水务局", "bid_deadline": "2026-11-20 09:30"}
    assert len(got["all_fields"]) == 31 and got["missing"] == [] and got["lots"][0].doc_id == "d"
    assert {(r.lot, r.field_key): r.value for r in got["lot_fields"]}["包1", "price_limit"] == "3005000" and got["targets"][0].target_lot == "包1"
    assert {r.name: r.lot for r in got["scores"]} == {"质量方案": "包1施工", "业绩": "包1施工"} and {(r.category, r.state) for r in got["score_checks"]} == {("technical", "passed"), ("commercial", "failed")}
    assert [r.text for r in got["rejections"]] == ["投标人资格不符合要求的按否决投标处理"] and len(got["star_clauses"]) == 1
    assert {r.title for r in got["outline"]} == {"一、技术部分", "施工方案", "二、商务部分"} and {tuple(r.added) for r in got["outline_added"]} == {("质量方案",), ("业绩",)}
    assert {(r.issue, r.about) for r in got["issues"]} == {("sum_failed", "commercial/包1施工"), ("ledger_open", "1")} and got["ledger"][0].pending == 1
    assert {r.source_file for r in got["evidence"] if r.ord < 100} == {"a.docx"} and any(r.label == "标书要求-业绩要求" for r in got["requirements"])
    stats = got["statistics"][0]
    assert (stats.blocks, stats.tables, stats.fields_found, stats.score_items, stats.star_clauses, stats.lots, stats.fields_total) == (14, 3, 4, 2, 1, 2, 31)
    short = report.summary(out)
    assert [(r.lot, r.price_limit) for r in short["lots"].collect()] == [("包1", "3005000")] and short["basic"].first().tender_no == "ZB-2026-001" and short["requirements"].count() == len(got["requirements"])
    part = report.selected(out, "d", "包2", "technical", ("scores", "lots"))
    assert set(part) == {"scores", "lots"} and part["scores"].count() == 1 and [r.lot for r in part["lots"].collect()] == ["包2"]  # an unclear lot stays
    assert report.selected(out, "other", sections=("fields",))["fields"].count() == 0
