"""Column functions on literal pairs."""

import pytest
from pyspark.sql import functions as F

from tenderflow.functions import lots, numbering, numerals, scoring, text, validators


def values(spark, function, given):
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, v string")
    return [r.out for r in rows.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


CASES = [
    (numerals.cn_number, {"伍佰": 500.0, "三千五百": 3500.0, "二十万": 200000.0, "十": 10.0, "贰亿伍仟万": 2.5e8, "三万五千亿": 3.5e12, "一亿三千万": 1.3e8, "零": None, "abc": None, "三点五": 3.0}),
    (lambda c: numerals.money(c).cast("double"), {"人民币贰亿伍仟万元整（¥250,000,000.00）": 2.5e8, "3,500.5万元": 35005000.0, "1.2亿": 1.2e8, "三千五百万元": 3.5e7, "大写：伍佰万元整": 5e6, "¥ 1,234.5": 1234.5, "0元": None, "无": None, None: None}),
    (numerals.date_time, {"2026年11月20日09时30分": "2026-11-20 09:30", "二〇二六年十月一日": "2026-10-01", "定于 2026-1-5 举行": "2026-01-05", "2026年13月1日": None, "11月20日": None, "见公告": None, "2026/11/20 9:05:07": "2026-11-20 09:05:07", "2026 年 1 月 5": "2026-01-05", "二〇二六年十二月三十一号 9点5分": "2026-12-31 09:05", "": None, None: None}),
    (lambda c: numerals.duration(c)["days"], {"540日历天": 540, "三个月": 90, "2年": 730, "12个月": 360, "十天后": None, "60 个日历天（约2个月）": 60}),
    (numerals.ordinal, {"十二": 12, "二十": 20, "九十九": 99, "7": 7, "百": 0, "": 0}),
    (numerals.to_ten_thousands, {"1234500": "123.45", "10000": "1", "面议": "面议", "0.5": "0.00005"}),
    (lambda c: numbering.numbering(c)["level"], {"第三章 评标": 1, "第二节 总则": 2, "（一）范围": 3, "一、总则": 2, "1.2.3 细则": 4, "1.2 范围": 3, "3、内容": 2, "正文": None, "2026年": None}),
    (lambda c: numbering.numbering(c)["no"], {"第十二章 评标": "12", "1.2.3 细则": "1.2.3", "3、内容": "3", "一、总则": ""}),
    (numbering.bare_title, {"第三章 评标办法": "评标办法", "一、总则": "总则", "1.2 范围": "范围", "正文": "正文"}),
    (validators.is_id_number, {"11010519491231002X": True, "110105194912310021": False, "11010519491331002X": False, None: False}),
    (validators.is_credit_code, {"91110000MA01ABCD2E": True, "91110000MI01ABCD2E": False}),
    (validators.is_phone, {"13812345678": True, "010-12345678": True, "0755-1234567-12": True, "12812345678": False}),
    (validators.is_organisation, {"某某建设有限公司": True, "张三": False, None: False}),
    (validators.is_public_url, {"https://example.org/a": True, "http://127.0.0.1/": False, "http://10.1.2.3": False, "http://169.254.169.254/x": False, "ftp://example.org": False, "http://[::1]/": False, "http://user@192.168.0.1/": False, "http://172.32.0.1": True, "http://": False}),
    (text.compare_form, {" Ａ，b​　C ": "ａ,bc", None: ""}),
    (text.is_placeholder, {"见 附件": True, "详见附件": True, "水泥": False}),
    (text.diversity, {"——————": 1 / 6, "": 0.0, "ab": 1.0}),
    (text.squeeze_ocr_spaces, {"A B 1 - 2": "AB1-2", "中 A": "中 A", "1 2": "12"}),
    (text.sentences, {"第一句话。短；第二句话\n ok 12 ": ["第一句话", "第二句话", "ok 12"], None: []}),
    (text.loose_json, {'{"a": 1}': '{"a": 1}', 'x ```{"a": [1]}``` y': '{"a": [1]}', "none": None}),
    (text.strip_sub_label, {"名称：（某某）": "某某", "a": "a"}),
    (lambda c: lots.packages(c)["nums"], {"包1-包3、5": [1, 2, 3, 5], "包1 至 包3": [1, 2, 3], "第2包": [2], "3号包": [3], "500千伏线路": [], "包３": [3]}),
    (lambda c: lots.packages(c)["complete"], {"包1-包3": True, "500千伏线路": False, "包3-包1": False, "": True}),
    (lots.identity, {"监理包012": 12, "线路": None}),
    (lambda c: lots.applies(c, F.lit("甲::包2")), {"-": "unknown", "甲::包2": "target", "甲::包1-包3": "universal", "乙::包2": "other", "包2": "unknown", "甲::包5": "other", "甲::除包2外": "unknown"}),
    (lambda c: scoring.performance(c)["years"], {"近5年内完成类似业绩3项": 5, "完成类似业绩3项": None, "开标前3年具有业绩": 3}),
    (lambda c: scoring.rule_numbers(c)["unit_score"], {"每项得2分，最多得6分": 2.0, "优秀": None}),
    (scoring.category, {"技术标（60分）": "technical", "商务": "commercial", "评标价": "price", "其他": None}),
]


@pytest.mark.parametrize("function,pairs", CASES, ids=range(len(CASES)))
def test_pairs(spark, function, pairs):
    got = values(spark, function, pairs)
    assert got == [pytest.approx(v) if isinstance(v, float) else v for v in pairs.values()]


def test_formal_writing_round_trip(spark):
    rows = spark.range(0, 3_000_000, 997).select("id", numerals.cn_number(numerals.formal(F.col("id"))).alias("back"))
    assert rows.filter("id > 0 and (back is null or back <> id)").count() == 0


def test_score_cell(spark):
    header = F.array(*map(F.lit, ("序号", "评分项", "分值")))
    rows = spark.createDataFrame([(["1", "a", "5分"],), (["1", "a", "6"],), (["1", "7", "x"],), (["1", "a", "b"],)], "c array<string>")
    got = [r.s and (r.s.score, r.s.col) for r in rows.select(scoring.score_cell(F.col("c"), header).alias("s")).collect()]
    assert got == [(5.0, 2), (6.0, 2), (7.0, 1), None]


def test_verdict_is_three_valued(spark):
    rows = spark.createDataFrame([("±800kV换流站土建，合同金额500万元，2020年",), ("换流站土建",), ("220kV变电站监理",)], "v string")
    asked = scoring.scope(F.lit("±800千伏换流站土建"))
    v = scoring.verdict(scoring.performance_elements(F.col("v")), asked, F.lit(1e6), F.lit(5), F.lit(2024))
    assert [r.v.verdict for r in rows.select(v.alias("v")).collect()] == ["match", "uncertain", "no_match"]


def test_negations(spark):
    got = spark.range(1).select(scoring.without(F.array(F.lit("土建"), F.lit("监理")), F.array(F.lit("土建施工"))).alias("w")).first().w
    assert got == ["监理"]
