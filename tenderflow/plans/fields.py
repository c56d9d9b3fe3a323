"""Queries on values, fields, validators, review and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbering as nb
from ..functions import numerals, text, validators
from ..operators import fields, review, rules
from ..shared import shared_path
from .registry import query, read


@query("SELECT o_orderkey, CAST(floor(o_totalprice) AS DOUBLE) AS yuan FROM orders")
def money_cn_roundtrip(spark, sf_dir):
    """SF-2, SF-5, R-1: prices in formal writing and back."""
    said = F.concat(F.lit("最高投标限价（大写）："), numerals.formal(F.floor("o_totalprice")), F.lit("元整"))
    return read(spark, sf_dir, "orders").select("o_orderkey", said.alias("said")).select("o_orderkey", numerals.money(F.col("said")).cast("double").alias("yuan"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN CAST(round(l_extendedprice, 2) AS DOUBLE) WHEN 1 THEN l_quantity * 10000 ELSE l_quantity * 100000000 END AS yuan FROM lineitem""")
def money_arabic_units(spark, sf_dir):
    """SF-5, SF-9: thousands separators, 万元 and 亿."""
    k = F.col("l_linenumber") % 3
    said = F.when(k == 0, F.concat(F.lit("¥"), F.format_number("l_extendedprice", 2), F.lit("元"))).when(k == 1, F.concat(text.number_text(F.col("l_quantity")), F.lit("万元"))).otherwise(F.concat(F.col("l_quantity").cast("string"), F.lit("亿")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", said.alias("said")).select("l_orderkey", "l_linenumber", "l_partkey", numerals.money(F.col("said")).cast("double").alias("yuan"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 3 = 0 THEN ' 09:30' ELSE '' END AS deadline FROM orders")
def deadline_roundtrip(spark, sf_dir):
    """SF-6, SF-3, SF-4, R-2: dates as Chinese text with a time, ISO, and with Chinese digits."""
    d = F.col("o_orderdate")
    year = F.translate(F.date_format(d, "yyyy"), "0123456789", "零一二三四五六七八九")
    two = lambda x: F.when(x < 10, F.substr(F.lit("一二三四五六七八九"), x, F.lit(1))).otherwise(F.concat(F.when(x >= 20, F.substr(F.lit("一二三四五六七八九"), (x / 10).cast("int"), F.lit(1))).otherwise(""), F.lit("十"), F.when(x % 10 > 0, F.substr(F.lit("一二三四五六七八九"), x % 10, F.lit(1))).otherwise("")))
    said = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.date_format(d, "yyyy年M月d日"), F.lit("9时30分")))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("截止 "), F.date_format(d, "yyyy/M/d")))
        .otherwise(F.concat(year, F.lit("年"), two(F.month(d)), F.lit("月"), two(F.dayofmonth(d)), F.lit("日")))
    )
    return read(spark, sf_dir, "orders").select("o_orderkey", said.alias("said")).select("o_orderkey", numerals.date_time(F.col("said")).alias("deadline"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size * 30 ELSE p_size * 365 END::INTEGER AS days, CASE p_partkey % 3 WHEN 0 THEN '日历天' WHEN 1 THEN '月' ELSE '年' END AS unit FROM part""")
def duration_days(spark, sf_dir):
    """SF-7, R-3."""
    unit = F.when(F.col("p_partkey") % 3 == 0, "日历天").when(F.col("p_partkey") % 3 == 1, "个月").otherwise("年")
    said = F.concat(F.lit("计划工期 "), F.col("p_size"), unit)
    return read(spark, sf_dir, "part").select("p_partkey", said.alias("said")).select("p_partkey", numerals.duration(F.col("said")).alias("d")).select("p_partkey", "d.days", "d.unit")


@query("""
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 4 WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 0 END AS level,
  CASE p_partkey % 8 WHEN 0 THEN '12' WHEN 1 THEN (p_size::VARCHAR) WHEN 4 THEN '3.2.' || p_size WHEN 5 THEN '3.' || p_size WHEN 6 THEN (p_size::VARCHAR) ELSE '' END AS no,
  CASE WHEN p_partkey % 8 = 6 THEN p_name ELSE 'T ' || p_name END AS title FROM part""")
def numbering_levels(spark, sf_dir):
    """SF-11, SF-12, SF-13: numbered titles of all forms."""
    t, n = F.concat(F.lit("T "), "p_name"), F.col("p_size").cast("string")
    forms = (F.concat(F.lit("第十二章 "), t), F.concat(F.lit("第"), n, F.lit("条："), t), F.concat(F.lit("（三）"), t), F.concat(F.lit("二、"), t), F.concat(F.lit("3.2."), n, F.lit(" "), t), F.concat(F.lit("3."), n, F.lit(" "), t), F.concat(n, F.lit("、"), t), t)
    said = F.element_at(F.array(*forms), (F.col("p_partkey") % 8 + 1).cast("int"))
    found = read(spark, sf_dir, "part").select("p_partkey", said.alias("said")).withColumn("x", nb.numbering(F.col("said")))
    return found.select("p_partkey", F.coalesce("x.level", F.lit(0)).alias("level"), F.coalesce("x.no", F.lit("")).alias("no"), nb.bare_title(F.col("said")).alias("title"))


def tender_texts(spark, sf_dir):
    """R-5: three blocks an order: a limit, a deadline and, in a third of them, a deposit."""
    o = F.col("o_orderkey")
    limit = F.concat(F.lit("最高投标限价："), F.floor("o_totalprice"), F.lit("元。项目名称：工程"), o, F.lit("号。"))
    date = F.concat(F.lit("投标截止时间："), F.date_format("o_orderdate", "yyyy年M月d日"), F.lit("。"))
    deposit = F.when(o % 3 == 0, F.concat(F.lit("投标保证金："), F.floor(F.col("o_totalprice") / 100), F.lit("元；联系人：张三，电话：13800000000"))).when(o % 3 == 1, F.lit("投标保证金：详见附件"))
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), x.alias("text")) for i, x in enumerate((limit, date, deposit))))
    return read(spark, sf_dir, "orders").select(o.alias("doc_id"), F.explode(rows).alias("b")).select("doc_id", "b.*").filter("text is not null")


def tender_cells(spark, sf_dir):
    """A table of label cells for a quarter of the orders: a limit a yuan higher, and weights."""
    cell = lambda r, c, t: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), t.alias("text"))
    limit = F.concat((F.floor("o_totalprice") + 1), F.lit("元"))
    cells = F.array(cell(0, 0, F.lit("最高投标限价：")), cell(0, 1, F.lit("—")), cell(0, 2, limit), cell(1, 0, F.lit("权重设置 30:20:50")), cell(1, 1, F.lit("1:1:1")))
    rows = read(spark, sf_dir, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("doc_id"), F.explode(cells).alias("c"))
    return rows.select("doc_id", F.lit(9).alias("ord"), F.lit("t").alias("table_id"), "c.*")


def candidates(spark, sf_dir):
    """Candidates of full texts, of zones (the first block), of tables and of a title in a seventh of the orders."""
    blocks = tender_texts(spark, sf_dir).withColumn("level", F.lit(0))
    title = F.lit("第三章 评标办法（综合评估法）")
    heads = read(spark, sf_dir, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("doc_id"), F.lit(3).alias("ord"), title.alias("text"), F.lit(1).alias("level"))
    near = blocks.filter("ord = 0").select("doc_id", "ord", F.lit("price_limit").alias("field_key"))
    return fields.all_candidates(blocks.unionByName(heads), near, tender_cells(spark, sf_dir))


CANDIDATES_SQL = """
WITH c AS (
  SELECT o_orderkey AS doc_id, 0 AS ord, 'price_limit' AS field_key, floor(o_totalprice)::BIGINT::VARCHAR AS value_normalized, 'full' AS source, 0.73 AS confidence FROM orders
  UNION ALL SELECT o_orderkey, 0, 'price_limit', floor(o_totalprice)::BIGINT::VARCHAR, 'zone', 0.84 FROM orders
  UNION ALL SELECT o_orderkey, 9, 'price_limit', (floor(o_totalprice) + 1)::BIGINT::VARCHAR, 'table', 0.95 FROM orders WHERE o_orderkey % 4 = 0
  UNION ALL SELECT o_orderkey, 9, k, v, 'table', 0.95 FROM orders, (VALUES ('technical_weight', '30'), ('commercial_weight', '20'), ('price_weight', '50')) w(k, v) WHERE o_orderkey % 4 = 0
  UNION ALL SELECT o_orderkey, 3, 'evaluation_method', '综合评估法', 'title', 0.9 FROM orders WHERE o_orderkey % 7 = 0
  UNION ALL SELECT o_orderkey, 0, 'project_name', '工程' || o_orderkey || '号', 'full', 0.74 FROM orders
  UNION ALL SELECT o_orderkey, 1, 'bid_deadline', strftime(o_orderdate, '%Y-%m-%d'), 'full', 0.74 FROM orders
  UNION ALL SELECT o_orderkey, 2, 'security_deposit', floor(o_totalprice / 100)::BIGINT::VARCHAR, 'full', 0.73 FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 2, 'contact_phone', '13800000000', 'full', 0.66 FROM orders WHERE o_orderkey % 3 = 0
)
"""


@query(CANDIDATES_SQL + "SELECT doc_id, ord, field_key, value_normalized, source, confidence::DOUBLE AS confidence FROM c")
def field_candidates(spark, sf_dir):
    """SO-1, FX-1, FX-3, FX-4, FX-6, JN-2, TK-3, PF-12 to PF-14, SF-24, SF-25."""
    return candidates(spark, sf_dir).select("doc_id", "ord", "field_key", "value_normalized", "source", "confidence")


@query(CANDIDATES_SQL + """
, best AS (SELECT doc_id, field_key, arg_max(value_normalized, confidence) AS value_normalized, arg_max(source, confidence) AS source, max(confidence) AS confidence FROM c GROUP BY doc_id, field_key)
SELECT doc_id, field_key, value_normalized, source,
  CASE WHEN field_key = 'security_deposit' AND value_normalized::DOUBLE NOT BETWEEN 1000 AND 1000000000 THEN round(confidence * 0.5, 2) ELSE confidence END::DOUBLE AS confidence FROM best""")
def field_merge(spark, sf_dir):
    """TK-1, TK-2, PF-25, FX-5, FX-6."""
    return fields.merged(candidates(spark, sf_dir)).select("doc_id", "field_key", "value_normalized", "source", "confidence")


@query("""
WITH x AS (SELECT o_orderkey AS doc_id, k AS field_key, (CASE WHEN o_orderkey % 2 = 0 THEN 20 ELSE 0.5 END) * f * floor(o_totalprice) AS v FROM orders, (VALUES ('price_limit', 10000), ('security_deposit', 0.0001)) t(k, f))
SELECT doc_id, field_key, floor(v)::BIGINT::VARCHAR AS value_normalized,
  CASE WHEN field_key = 'security_deposit' AND floor(v) < 1000 THEN 0.4 ELSE 0.8 END::DOUBLE AS confidence FROM x WHERE floor(v) BETWEEN 1 AND 10000000000""")
def field_ranges(spark, sf_dir):
    """TK-2, PF-25: limits of billions keep their confidence, small deposits count half, what no amount can be is not chosen."""
    o = read(spark, sf_dir, "orders")
    factor = F.when(F.col("o_orderkey") % 2 == 0, 20.0).otherwise(0.5)
    of = lambda k, f: F.struct(F.lit(k).alias("field_key"), (factor * f * F.floor("o_totalprice")).alias("v"))
    rows = o.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(of("price_limit", 10000.0), of("security_deposit", 0.0001))).alias("x")).select("doc_id", "x.*")
    text_of = F.floor("v").cast("string")
    found = rows.select("doc_id", F.lit(0).alias("ord"), "field_key", F.lit("amount").alias("kind"), text_of.alias("value_raw"), text_of.alias("value_normalized"), F.lit("full").alias("source"), F.lit(0.8).alias("confidence"))
    return fields.merged(found).select("doc_id", "field_key", "value_normalized", "confidence")


#: A text for each pack: what stands before and after a value, which of the values it is, and
#: what is found: the value with what belongs to it, and the confidence of a full text.
PACK_CASES = (
    ("project_name", "项目名称：工程", "号", "n", "工程", "号", 0.74), ("tender_no", "招标编号：ZB-", "-A", "n", "ZB-", "-A", 0.74),
    ("tenderer", "采购人：甲", "单位", "n", "甲", "单位", 0.73), ("agency", "采购代理机构：乙", "事务所", "n", "乙", "事务所", 0.72),
    ("legal_representative", "法定代表人：张某某", "", "none", "张某某", "", 0.74), ("contact_phone", "联系电话：138", "", "eight", "138", "", 0.74),
    ("credit_code", "统一社会信用代码：91310245MA", "", "eight", "91310245MA", "", 0.74), ("fund_source", "资金来源：自筹", "", "n", "自筹", "", 0.72),
    ("site", "建设地点：东城区", "路", "n", "东城区", "路", 0.72), ("price_limit", "招标控制价（¥", "元）", "n", "", "", 0.76),
    ("budget_amount", "项目预算：", "万元", "n", "", "0000", 0.7), ("security_deposit", "保证金金额：", "元", "n", "", "", 0.69),
    ("bid_deadline", "开标时间：2026年3月", "日上午", "two", "2026-03-", "", 0.7), ("bid_validity", "投标有效期为", "日历天", "two", "", "天", 0.74),
    ("duration", "合同工期：", "日历天", "two", "", "天", 0.73), ("quality_standard", "质量标准：合格", "", "n", "合格", "", 0.72),
    ("performance_bond", "履约保证金（", "元）", "n", "", "", 0.73), ("deposit_refund", "退还保证金：开标后", "日内", "n", "开标后", "日内", 0.69),
    ("deposit_method", "缴纳方式：电汇", "", "n", "电汇", "", 0.69), ("payment_terms", "付款方式：按月支付", "", "n", "按月支付", "", 0.69),
    ("objection_clause", "异议处理：书面提出", "", "n", "书面提出", "", 0.69), ("doc_get_way", "招标文件获取方式：平台下载", "", "n", "平台下载", "", 0.69),
    ("doc_price", "工本费：", "元", "n", "", "", 0.7), ("submission_location", "递交地点：三楼", "室", "n", "三楼", "室", 0.7),
    ("warranty_period", "质保期：", "天", "two", "", "天", 0.7), ("acceptance_requirements", "验收标准：国标", "", "n", "国标", "", 0.69),
    ("evaluation_method", "评审办法：综合评估法", "", "n", "综合评估法", "", 0.72), ("evaluation_committee", "评标委员会组成：专家", "人", "n", "专家", "人", 0.69),
    ("technical_weight", "技术部分", "分", "two", "", "", 0.7), ("commercial_weight", "商务部分", "分", "two", "", "", 0.7), ("price_weight", "报价部分", "分", "two", "", "", 0.7),
)
PACK_VALUES = ", ".join(f"({i}, '{k}', '{v}', '{a}', '{z}', {c})" for i, (k, _, _, v, a, z, c) in enumerate(PACK_CASES))


@query(f"""
SELECT p_partkey AS doc_id, k AS field_key, a || CASE v WHEN 'n' THEN (p_partkey + 1000)::VARCHAR WHEN 'eight' THEN lpad((p_partkey + 1000)::VARCHAR, 8, '0') WHEN 'two' THEN (p_partkey % 19 + 10)::VARCHAR ELSE '' END || z AS value_normalized, c::DOUBLE AS confidence
FROM part JOIN (VALUES {PACK_VALUES}) p(i, k, v, a, z, c) ON i = p_partkey % {len(PACK_CASES)}""")
def field_packs(spark, sf_dir):
    """FX-1, FX-4, TK-3: a text for each of the 31 packs."""
    key = F.col("p_partkey")
    values = {"n": (key + 1000).cast("string"), "eight": F.lpad((key + 1000).cast("string"), 8, "0"), "two": (key % 19 + 10).cast("string"), "none": F.lit("")}
    said = F.array(*(F.concat(F.lit(before), values[v], F.lit(after)) for _, before, after, v, *_ in PACK_CASES))
    blocks = read(spark, sf_dir, "part").select(key.alias("doc_id"), F.lit(0).alias("ord"), F.get(said, (key % len(PACK_CASES)).cast("int")).alias("text"))
    return fields.text_candidates(blocks).select("doc_id", "field_key", "value_normalized", "confidence")


#: Label cells of the fields that tables give, one spelling each, and what stands around the value.
LABEL_CASES = (
    ("project_name", "采购项目名称", "工程", "号"), ("tender_no", "标段编号", "BD-", ""), ("tenderer", "招 标 人", "甲单位", ""), ("agency", "招标代理", "乙单位", ""),
    ("fund_source", "资金性质", "自筹", ""), ("site", "实施地点", "东城区", "路"), ("price_limit", "拦标价", "", "元"), ("security_deposit", "应提交投标保证金金额", "", "元"),
    ("deposit_method", "缴纳方式", "电汇", ""), ("bid_deadline", "递交投标文件截止时间", "2026年3月", "日"), ("bid_validity", "投标有效期", "", "日历天"), ("duration", "供货期", "", "天"),
    ("quality_standard", "质量要求", "合格", ""), ("evaluation_method", "评审办法", "综合评估法", ""), ("credit_code", "统一社会信用代码", "91310245MA12ABCD", ""), ("legal_representative", "法人代表", "张某某", ""),
    ("contact_phone", "传真", "010-123456", ""), ("warranty_period", "缺陷责任期", "", "天"), ("performance_bond", "履约保证金（万元）", "", ""), ("doc_price", "工本费", "", "元"), ("submission_location", "提交地点", "三楼", "室"), ("budget_amount", "采购预算（大写）", "", "元"),
)
LABEL_VALUES = ", ".join(f"({i}, '{k}', '{a}', '{z}')" for i, (k, _, a, z) in enumerate(LABEL_CASES))


@query(f"""
WITH x AS (SELECT p_partkey AS doc_id, k AS field_key, a, z, (p_partkey % 19 + 10)::VARCHAR AS v FROM part JOIN (VALUES {LABEL_VALUES}) p(i, k, a, z) ON i = p_partkey % {len(LABEL_CASES)})
SELECT doc_id, field_key, CASE WHEN field_key = 'bid_deadline' THEN '2026-03-' || v WHEN field_key IN ('bid_validity', 'duration', 'warranty_period') THEN v || '天'
  WHEN field_key IN ('price_limit', 'security_deposit', 'doc_price', 'budget_amount') THEN v WHEN field_key = 'performance_bond' THEN v || '0000' WHEN field_key = 'legal_representative' THEN a ELSE a || v || z END AS value_normalized FROM x""")
def field_tables(spark, sf_dir):
    """FX-2, FX-3, WN-16: a table for each of the 22 labels: a head row, the label, a column head, the value below the label."""
    i, v = (F.col("p_partkey") % len(LABEL_CASES)).cast("int"), (F.col("p_partkey") % 19 + 10).cast("string")
    case = lambda part: F.get(F.array(*(F.lit(c[part]) for c in LABEL_CASES)), i)
    value = F.when(case(0) == "legal_representative", case(2)).otherwise(F.concat(case(2), v, case(3)))
    cell = lambda r, c, t: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), t.alias("text"))
    right = F.array(cell(0, 0, case(1)), cell(0, 1, F.lit("列头")), cell(1, 0, F.concat(case(1), F.lit("："))), cell(1, 1, F.lit("/")), cell(1, 2, value))
    below = F.array(cell(0, 0, F.lit("表")), cell(1, 0, case(1)), cell(1, 1, F.lit("等级")), cell(2, 0, value))
    cells = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.explode(F.when(F.col("p_partkey") % 2 == 0, right).otherwise(below)).alias("c"))
    found = fields.table_candidates(cells.select("doc_id", F.lit(5).alias("ord"), F.lit("t").alias("table_id"), F.lit(1).alias("header_rows"), "c.*"))
    return found.select("doc_id", "field_key", "value_normalized")


@query(CANDIDATES_SQL + "SELECT doc_id, field_key, count(DISTINCT value_normalized)::BIGINT AS n_values, string_agg(DISTINCT value_normalized, ',' ORDER BY value_normalized DESC) AS alternatives FROM c GROUP BY doc_id, field_key HAVING count(DISTINCT value_normalized) > 1")
def field_value_conflicts(spark, sf_dir):
    """AG-7 on extracted candidates."""
    found = fields.conflicts(candidates(spark, sf_dir), ["doc_id", "field_key"], "value_normalized", "confidence")
    return found.select("doc_id", "field_key", "n_values", F.array_join("alternatives", ",").alias("alternatives"))


@query("""
WITH g AS (SELECT l_orderkey AS doc_id, l_quantity AS v, max(l_extendedprice) AS c FROM lineitem GROUP BY ALL)
SELECT doc_id, count(*)::BIGINT AS n_values, string_agg(v::BIGINT::VARCHAR, ',' ORDER BY c DESC, v) AS alternatives, CASE WHEN max(v) / min(v) > 5 THEN 'spread' WHEN count(*) >= 4 THEN 'several' END AS note FROM g GROUP BY doc_id HAVING count(*) > 1""")
def field_conflicts(spark, sf_dir):
    """AG-7, AG-8: quantities of an order as values of one field."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_quantity", "l_extendedprice")
    found = fields.conflicts(lines, ["doc_id"], "l_quantity", "l_extendedprice")
    return found.select("doc_id", "n_values", F.array_join(F.transform("alternatives", lambda v: v.cast("long").cast("string")), ",").alias("alternatives"), "note")


CATALOG = (("price_limit", True), ("bid_deadline", True), ("security_deposit", True), ("contact_phone", False), ("tenderer", True))


@query("""
SELECT o_orderkey AS doc_id, 'tenderer' AS field_key FROM orders UNION ALL SELECT o_orderkey, 'security_deposit' FROM orders WHERE o_orderkey % 3 <> 0""")
def required_missing(spark, sf_dir):
    """PF-21, D13."""
    required = [k for k, needed in CATALOG if needed]
    return fields.required_missing(fields.merged(candidates(spark, sf_dir)), tender_texts(spark, sf_dir), required).select("doc_id", "field_key")


@query("""
SELECT o_orderkey AS doc_id, k AS field_key, CASE WHEN k = 'tenderer' OR (k IN ('security_deposit', 'contact_phone') AND o_orderkey % 3 <> 0) THEN 'not_found' ELSE 'found' END AS status FROM orders, (VALUES ('price_limit'), ('bid_deadline'), ('security_deposit'), ('contact_phone'), ('tenderer')) v(k)""")
def field_defaults(spark, sf_dir):
    """DM-5."""
    keys = [k for k, _ in CATALOG]
    return fields.with_defaults(fields.merged(candidates(spark, sf_dir)), tender_texts(spark, sf_dir), keys).select("doc_id", "field_key", "status")


@query("""
SELECT o_orderkey AS doc_id, l.k AS label, CASE WHEN o_orderkey % 2 = 0 THEN l.k || '-right-' || o_custkey ELSE l.k || '-below-' || o_custkey END AS value_raw FROM orders, (VALUES ('A'), ('B')) l(k) WHERE o_orderkey % 2 = 0 OR l.k = 'A'""")
def label_value_cell(spark, sf_dir):
    """WN-16, FX-3, R-4: values right of labels, or below them."""
    o, even = F.col("o_orderkey"), F.col("o_orderkey") % 2 == 0
    said = lambda k, where: F.concat(F.lit(f"{k}-{where}-"), "o_custkey")
    cell = lambda r, c, t, label: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), t.alias("text"), F.lit(label).alias("is_label"))
    right = F.array(cell(0, 0, F.lit("A"), True), cell(0, 1, F.lit(" "), False), cell(0, 2, said("A", "right"), False), cell(1, 0, F.lit("B"), True), cell(1, 1, said("B", "right"), False))
    below = F.array(cell(0, 0, F.lit("A"), True), cell(1, 0, said("A", "below"), False), cell(2, 0, F.lit("B"), True), cell(2, 1, F.lit(""), False))
    cells = read(spark, sf_dir, "orders").select(o.alias("doc_id"), F.lit("t").alias("table_id"), F.explode(F.when(even, right).otherwise(below)).alias("c")).select("doc_id", "table_id", "c.*")
    return fields.label_values(cells).select("doc_id", F.col("text").alias("label"), "value_raw")


@query("""
SELECT c_custkey AS doc_id, 'price_limit' AS field_key, substr(sha256(c_custkey || '|price_limit|' || CASE WHEN c_custkey % 4 = 0 THEN 'a,b' ELSE 'a' END), 1, 20) AS item_id,
  CASE WHEN c_custkey % 5 = 0 AND c_custkey % 4 = 0 THEN 'low_confidence,conflict' WHEN c_custkey % 5 = 0 THEN 'low_confidence' ELSE 'conflict' END AS reasons FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 4 = 0""")
def review_queue(spark, sf_dir):
    """PF-20, DD-7."""
    k = F.col("c_custkey")
    found = read(spark, sf_dir, "customer").select(k.alias("doc_id"), F.lit("price_limit").alias("field_key"), F.lit("a").alias("value"), F.when(k % 5 == 0, 0.6).otherwise(0.9).alias("confidence"), F.lit("found").alias("status"), F.when(k % 4 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"))).alias("candidate_values"))
    return review.open_items(found, found.filter("doc_id % 4 = 0")).select("doc_id", "field_key", "item_id", "reasons")


@query("""
SELECT c_custkey AS item_id, CASE WHEN c_custkey % 3 = 0 THEN 'resolved' ELSE 'open' END AS status, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 2 = 1 THEN 'old' ELSE 'new' END AS value FROM customer""")
def review_upsert(spark, sf_dir):
    """JN-13, SNK-4: every second item comes anew; resolved ones stay."""
    k = F.col("c_custkey")
    old = read(spark, sf_dir, "customer").select(k.alias("item_id"), F.when(k % 3 == 0, "resolved").otherwise("open").alias("status"), F.lit("old").alias("value"))
    new = read(spark, sf_dir, "customer").filter(k % 2 == 0).select(k.alias("item_id"), F.lit("open").alias("status"), F.lit("new").alias("value"))
    return review.upsert(old, new)


@query("""
SELECT c_custkey AS item_id, CASE WHEN c_custkey % 5 IN (0, 1, 2) THEN 'resolved' ELSE 'open' END AS status, CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN 'fixed' WHEN 2 THEN '' END AS decision,
  CASE c_custkey % 5 WHEN 3 THEN 'correct needs a value' WHEN 4 THEN 'unknown action' END AS error FROM customer""")
def review_decisions(spark, sf_dir):
    """DM-2."""
    k = F.col("c_custkey") % 5
    c = read(spark, sf_dir, "customer")
    items = c.select(F.col("c_custkey").alias("item_id"), F.lit(1).alias("doc_id"), F.col("c_name").alias("primary_value"), F.lit("open").alias("status"))
    action = F.when(k == 0, "accept").when(k.isin(1, 3), "correct").when(k == 2, "reject").otherwise("guess")
    return review.resolve(items, c.select(F.col("c_custkey").alias("item_id"), action.alias("action"), F.when(k == 1, "fixed").alias("value"))).select("item_id", "status", "decision", "error")


@query("""
SELECT c_nationkey AS doc_id, string_agg('f' || c_custkey || '=' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, ';' ORDER BY 'f' || c_custkey) AS fields FROM customer WHERE c_custkey % 2 = 0 GROUP BY c_nationkey""")
def gold_export(spark, sf_dir):
    """SNK-3, SRC-17."""
    k = F.col("c_custkey")
    items = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), F.concat(F.lit("f"), k).alias("field_key"), k.alias("item_id"), F.when(k % 3 == 0, "reject").otherwise("accept").alias("action"), F.col("c_name").alias("decision"), F.when(k % 2 == 0, "resolved").otherwise("open").alias("status"))
    shown = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return review.gold(items).select("doc_id", shown.alias("fields"))


@query("""
WITH p AS (SELECT lang, l.quality = 1 AS g, length(d.text) >= 500 AS f FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT lang, (count(*) FILTER (g AND f))::BIGINT AS tp, (count(*) FILTER (NOT g AND f))::BIGINT AS fp, (count(*) FILTER (g AND NOT f))::BIGINT AS fn FROM p GROUP BY lang),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c)
SELECT lang, tp, fp, fn, round(p, 3) AS precision, round(r, 3) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 3) AS f1 FROM m""")
def field_prf(spark, sf_dir):
    """JN-17, AG-11, HL-9: a length rule against the quality labels."""
    pairs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("g"), (F.length("text") >= 500).alias("f"))
    return review.precision_recall(pairs, F.col("g"), F.col("f"), "lang")


@query("""
WITH g AS (SELECT p_brand AS k, substr(p_name, 1, 6) AS name FROM part WHERE p_partkey % 2 = 0), f AS (SELECT p_brand AS k, p_name AS name FROM part WHERE p_partkey % 3 = 0)
SELECT k, count(*)::BIGINT AS n_gold, (count(*) FILTER (EXISTS (SELECT 1 FROM f WHERE f.k = g.k AND (contains(f.name, g.name) OR contains(g.name, f.name)))))::BIGINT AS n_hit FROM g GROUP BY k""")
def score_name_recall(spark, sf_dir):
    """JN-16."""
    part = read(spark, sf_dir, "part")
    gold = part.filter("p_partkey % 2 = 0").select(F.col("p_brand").alias("k"), F.substring("p_name", 1, 6).alias("name"))
    return review.name_recall(gold, part.filter("p_partkey % 3 = 0").select(F.col("p_brand").alias("k"), F.col("p_name").alias("name")), "k")


@query("SELECT o_orderkey, (o_totalprice::DECIMAL(20, 2))::VARCHAR AS yuan, rtrim(rtrim((o_totalprice::DECIMAL(20, 2) * 10000)::DECIMAL(30, 2)::VARCHAR, '0'), '.') AS back FROM orders")
def wan_conversion(spark, sf_dir):
    """SF-46: 万 times ten thousand squared is the yuan again, exactly."""
    yuan = F.col("o_totalprice").cast("decimal(20,2)")
    wan = numerals.to_ten_thousands(yuan.cast("string")).cast("decimal(30,6)") * 100_000_000
    back = F.regexp_replace(F.regexp_replace(wan.cast("decimal(30,2)").cast("string"), "0+$", ""), r"\.$", "")
    return read(spark, sf_dir, "orders").select("o_orderkey", yuan.cast("string").alias("yuan"), back.alias("back"))


def rendered_ids(spark, sf_dir):
    """R-12: 17 digits with a valid date of birth and the check sign, wrong for every third."""
    k = F.col("c_custkey")
    head = F.concat(F.lit("110101"), F.lit("19"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("0"), (k % 9 + 1).cast("string"), F.lit("1"), (k % 10).cast("string"), F.lpad((k % 1000).cast("string"), 3, "0"))
    return read(spark, sf_dir, "customer").select("c_custkey", head.alias("head"))


@query("SELECT c_custkey, c_custkey % 3 <> 0 AS valid FROM customer")
def id_checksum(spark, sf_dir):
    """PF-4."""
    sign = validators.id_sign(F.col("head"))
    wrong = F.when(sign == "5", "6").otherwise("5")
    whole = F.concat("head", F.when(F.col("c_custkey") % 3 == 0, wrong).otherwise(F.lower(sign)))
    return rendered_ids(spark, sf_dir).select("c_custkey", validators.is_id_number(whole).alias("valid"))


@query("""
SELECT c_custkey, c_custkey % 2 = 0 AS credit_code, c_custkey % 3 <> 2 AS phone, c_custkey % 4 <> 3 AS organisation, c_custkey % 5 = 0 AS person, c_custkey % 2 = 1 AS tender_number, c_custkey % 3 = 0 AS placeholder, c_acctbal BETWEEN 1000 AND 1000000000 AS deposit FROM customer""")
def value_shapes(spark, sf_dir):
    """PF-2, PF-5, PF-6, PF-8 to PF-11, SF-1."""
    k = F.col("c_custkey")
    code = F.when(k % 2 == 0, F.concat(F.lit("91110000"), F.lpad((k % 10**9).cast("string"), 9, "0"), F.lit("x"))).otherwise("91110000I234567890")
    phone = F.when(k % 3 == 0, F.concat(F.lit("138"), F.lpad(k.cast("string"), 8, "0"))).when(k % 3 == 1, "010-12345678-12").otherwise("12800000000")
    org = F.when(k % 4 == 0, "某某建设集团有限公司").when(k % 4 == 1, " 市财政局 ").when(k % 4 == 2, "第一医院").otherwise("张三")
    number = F.when(k % 2 == 1, F.concat(F.lit("ZB-2026/"), k)).otherwise("（）—")
    word = F.when(k % 3 == 0, " 详 见附件 ").otherwise("混凝土")
    return read(spark, sf_dir, "customer").select(
        "c_custkey", validators.is_credit_code(code).alias("credit_code"), validators.is_phone(phone).alias("phone"), validators.is_organisation(org).alias("organisation"),
        validators.is_person_name(F.when(k % 5 == 0, "李小明").otherwise("Li Ming")).alias("person"), validators.is_tender_number(number).alias("tender_number"), text.is_placeholder(word).alias("placeholder"), validators.in_range(F.col("c_acctbal"), "deposit").alias("deposit"),
    )


@query("SELECT o_orderkey, o_orderdate::DATE BETWEEN DATE '1996-01-01' - 365 AND DATE '1996-01-01' + 90 AS in_window FROM orders")
def date_window(spark, sf_dir):
    """PF-7: with the date of reference as a parameter."""
    return read(spark, sf_dir, "orders").select("o_orderkey", validators.date_in_window(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"), F.to_date(F.lit("1996-01-01")), 365, 90).alias("in_window"))


@query("SELECT p_partkey, 'AB' || p_size || 'C-' || p_partkey AS code FROM part")
def ocr_spaces(spark, sf_dir):
    """SF-8."""
    return read(spark, sf_dir, "part").select("p_partkey", text.squeeze_ocr_spaces(F.concat(F.lit("A B "), "p_size", F.lit("  C - "), "p_partkey")).alias("code"))


@query("SELECT p_partkey AS doc_id, 'size_class' AS field_key, 'S' || (p_size + 1000) AS value_normalized, 0.7::DOUBLE AS confidence FROM part")
def added_field(spark, sf_dir):
    """UX-1, UX-2, UX-3: a field whose pack is a row of a stored rule table, found by its second version."""
    path = shared_path(spark, "rules")
    added = rules.Row("pack", "size_class", "number", "尺寸等级", False, ["notice"], 0, 0.9, "尺寸等级[：:]([A-Z0-9]{4,10})")
    for rows in (rules.BUILT_IN.rows(), [*rules.BUILT_IN.rows(), added]):
        rules.store(rules.frame(spark, rows), path)
    blocks = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("ord"), F.concat(F.lit("尺寸等级：S"), F.col("p_size") + 1000, F.lit("。")).alias("text"))
    return fields.text_candidates(blocks, rules=rules.load(spark, path)).select("doc_id", "field_key", "value_normalized", "confidence")
