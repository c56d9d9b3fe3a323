"""Queries on scores, requirements, lots, outlines and performance verdicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lots as lot_names
from ..functions import scoring
from ..operators import lots, outline, requirements, score_items, scores, structure
from .registry import query, read


def score_rows_of(spark, sf_dir):
    """R-6: a score table per order: a header, a category row before the lines with an odd
    number, and a row a line: serial, part, `N分`, rule."""
    o, n, part = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = read(spark, sf_dir, "lineitem").select(o, n, part, "l_quantity").repartition(tasks, "l_orderkey")  # serves all that follows
    sorted_lines = Window.partitionBy("l_orderkey").orderBy("l_linenumber", F.asc_nulls_last("l_partkey"), F.asc_nulls_last("l_quantity"))
    placed = dealt.withColumn("first", F.row_number().over(sorted_lines) == 1).withColumn("above", F.lag(n).over(sorted_lines))
    lines = placed.filter(F.col("first") | ~n.eqNullSafe(F.col("above")))  # a number's least part and quantity
    line = lambda row, *cells: F.struct(row.alias("row"), F.array(*cells).alias("cells"))
    kind = F.when(n % 3 == 0, "技术标（60分）").otherwise("商务标（30分）")
    body = line(n * 2 + 1, n.cast("string"), F.concat(F.lit("part-"), part), F.concat(F.col("l_quantity").cast("int"), F.lit("分")), F.lit("按细则"))
    head = line(n * 2, kind, F.lit(""), F.lit(""), F.lit(""))
    header = line(F.lit(0), *map(F.lit, ("序号", "评分项", "分值", "评分标准")))
    rows = F.array(F.when(F.col("first"), header), F.when(n % 2 == 1, head), body)
    return lines.select(o.alias("doc_id"), F.explode(rows).alias("r")).filter("r is not null").select("doc_id", "r.*", F.lit("t-0001").alias("table_id"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber AS n, min({'a': l_partkey, 'b': l_quantity}) AS x FROM lineitem GROUP BY ALL)
SELECT l_orderkey AS doc_id, (n * 2 + 1)::INTEGER AS row_no, 'part-' || x.a AS name, floor(x.b)::DOUBLE AS max_score,
  coalesce(last_value(CASE WHEN n % 2 = 1 THEN CASE WHEN n % 3 = 0 THEN 'technical' ELSE 'commercial' END END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY n), 'technical') AS category FROM l""")
def score_rows(spark, sf_dir):
    """FX-9, WN-8, SF-19, SF-20."""
    return scores.classic_rows(score_rows_of(spark, sf_dir)).select("doc_id", F.col("row").cast("int").alias("row_no"), "name", "max_score", "category")


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem)
SELECT l_orderkey AS doc_id, CASE WHEN n % 3 = 0 THEN 'technical' ELSE 'commercial' END AS category, max(CASE WHEN n % 3 = 0 THEN 60 ELSE 30 END)::DOUBLE AS declared_total FROM l WHERE n % 2 = 1 GROUP BY 1, 2""")
def declared_totals(spark, sf_dir):
    """FX-9: totals of category rows."""
    return scores.declared_totals(score_rows_of(spark, sf_dir))


@query("""
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_quantity ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_tax, l_discount) AS n FROM lineitem) WHERE n = 1""")
def score_dedupe(spark, sf_dir):
    """DD-1: the first line of each part, supplier and quantity."""
    lines = read(spark, sf_dir, "lineitem").withColumn("by", F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax", "l_discount"))
    return scores.first_of(lines, ["l_partkey", "l_suppkey", "l_quantity"], "by").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")


@query("""
WITH c AS (SELECT l_orderkey, sum(l_quantity) FILTER (l_returnflag <> 'R') AS t, count(*) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY 1),
d AS (SELECT o_orderkey, t, coalesce(n, 0)::BIGINT AS n, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN coalesce(t, 0) + 1 ELSE coalesce(t, 0) END AS dt FROM orders LEFT JOIN c ON l_orderkey = o_orderkey)
SELECT o_orderkey AS doc_id, dt AS declared_total, t AS computed_total, n AS item_count, CASE WHEN dt IS NULL OR t IS NULL THEN 'unverifiable' WHEN abs(dt - t) <= 0.01 THEN 'passed' ELSE 'failed' END AS state,
  CASE WHEN dt IS NULL OR t IS NULL THEN NULL ELSE abs(dt - t) <= 0.01 END AS ok FROM d""")
def score_sum_check(spark, sf_dir):
    """AG-1, AG-2, JN-19, R-7: declared totals, some wrong and some missing, against the lines."""
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_quantity", "l_returnflag")
    totals = scores.computed_totals(items, ["doc_id"], "l_quantity", F.col("l_returnflag") != "R")
    o = F.col("doc_id")
    right = F.coalesce("computed_total", F.lit(0.0))
    declared = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")).join(totals, "doc_id", "left").select("doc_id", F.when(o % 11 == 0, None).when(o % 7 == 0, right + 1).otherwise(right).alias("declared_total"))
    return scores.sum_check(declared, totals, ["doc_id"])


@query("""
SELECT p_brand, arg_min(p_partkey % 3 <> 0, p_partkey) AS sums_to_100, count(p_partkey // 3) = count(DISTINCT p_partkey // 3) AS ids_unique FROM part GROUP BY 1""")
def weight_sums(spark, sf_dir):
    """AG-3, SF-24: one weight triple a brand, for a third of them a point too much; ids that some parts of a brand share."""
    k, size = F.col("p_partkey"), F.col("p_size") % 50
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy(k))
    price = 80 - size + F.when(k % 3 == 0, 1).otherwise(0)
    said = F.when(n == 1, F.concat(size.cast("string"), F.lit("：20 : "), price.cast("string"))).otherwise("0:0:0")
    found = read(spark, sf_dir, "part").select("p_brand", F.floor(k / 3).alias("item_id"), scoring.weights(said).alias("w"))
    return scores.weight_check(found.select("p_brand", "item_id", "w.*"), "p_brand")


@query("SELECT p_partkey, (p_size)::DOUBLE AS technical, 20.0::DOUBLE AS commercial, (p_partkey % 100)::DOUBLE AS price FROM part")
def weight_triples(spark, sf_dir):
    """SF-24."""
    said = F.concat(F.lit("权重 "), "p_size", F.lit("：20 : "), F.col("p_partkey") % 100, F.lit("（技:商:价）"))
    return read(spark, sf_dir, "part").select("p_partkey", scoring.weights(said).alias("w")).select("p_partkey", "w.*")


def grid_table_rows(spark, sf_dir):
    """Parts as grid rows of their brand: two parents with totals, names with a score, a minus or
    none, blank names below, scores in rules."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    parent = F.when(k % 2 == 0, "技术部分（60分）").otherwise("扣分项（-20分）")
    name = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.concat("p_type", F.lit("（"), size, F.lit("分）"))).when(k % 5 == 2, F.concat("p_type", F.lit("（-"), size, F.lit("分）"))).otherwise(F.col("p_type"))
    content = F.when(k % 3 == 0, F.concat(F.lit("优得"), size, F.lit("分"))).when(k % 3 == 1, F.concat(F.lit("附合同"), k.cast("string"))).otherwise("")
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.lit("t").alias("table_id"), F.lit("technical").alias("category"), k.cast("int").alias("row"), parent.alias("parent"), name.alias("name"), content.alias("content"))


@query(r"""
WITH r AS (SELECT p_brand AS doc_id, p_partkey AS row, p_partkey % 2 = 0 AS even, p_size, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN p_type || '（' || p_size || '分）' WHEN 2 THEN p_type || '（-' || p_size || '分）' ELSE p_type END AS name,
  CASE p_partkey % 3 WHEN 0 THEN '优得' || p_size || '分' WHEN 1 THEN '附合同' || p_partkey ELSE '' END AS content FROM part),
n AS (SELECT * EXCLUDE (name), coalesce(last_value(name IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row), '') AS name FROM r),
s AS (SELECT *, coalesce(nullif(regexp_extract(name, '（(-?\d+)分）', 1), ''), CASE WHEN even THEN '60' ELSE '-20' END) AS shown FROM n),
g AS (SELECT doc_id, even, name, min(row)::INTEGER AS first_row, arg_min(abs(shown::DOUBLE), row) AS max_score, bool_or(starts_with(shown, '-') OR NOT even) AS penalty, substr(coalesce(string_agg(content, ' / ' ORDER BY row) FILTER (content <> ''), ''), 1, 800) AS rule FROM s GROUP BY 1, 2, 3)
SELECT doc_id, CASE WHEN even THEN '技术部分' ELSE '扣分项' END AS grp, substr(regexp_replace(name, '（-?\d+分）', '', 'g'), 1, 40) AS name, first_row, max_score::DOUBLE AS max_score, penalty, CASE WHEN regexp_matches(rule, '优|良|一般|差|好|中档|较差|档次') THEN 'graded' ELSE 'binary' END AS rule_type,
  md5(substr(rule, 1, 500)) AS rule_md5, CASE WHEN contains(rule, '合同') THEN '合同' ELSE '' END AS proofs FROM g WHERE max_score > 0""")
def grid_groups(spark, sf_dir):
    """AG-10, FX-9, WN-9, SF-22, PF-16: parts as grid rows of their brand."""
    rows = grid_table_rows(spark, sf_dir)
    out = scores.grid_groups(rows.filter(scoring.is_grid_table(F.lit("序号评审内容及分值"), F.lit(3))))
    return out.select("doc_id", F.col("group").alias("grp"), "name", "first_row", "max_score", "penalty", "rule_type", F.md5("rule_text").alias("rule_md5"), F.array_join("proofs", ",").alias("proofs"))


@query("""
SELECT p_brand AS doc_id, 60.0::DOUBLE AS declared_total FROM part GROUP BY 1 HAVING bool_or(p_partkey % 2 = 0)""")
def grid_totals(spark, sf_dir):
    """AG-10: what the parents of a brand's grid declare."""
    return scores.grid_totals(grid_table_rows(spark, sf_dir)).select("doc_id", "declared_total")


@query("""
WITH c AS (SELECT o_custkey AS doc_id, round(sum(o_totalprice % 7 - 1), 2) AS computed, list_sort(list('S-' || o_orderkey) FILTER (round(o_totalprice % 7 - 1, 2) <= 0)) AS bad FROM orders GROUP BY 1)
SELECT doc_id, CASE WHEN len(coalesce(bad, [])) > 0 THEN 'failed' ELSE 'passed' END AS state, coalesce(array_to_string(bad, ','), '') AS bad_items FROM c""")
def score_bad_items(spark, sf_dir):
    """AG-2: items without a positive score fail their key, whatever the sum."""
    items = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("S-"), "o_orderkey").alias("score_id"), F.round(F.col("o_totalprice") % 7 - 1, 2).alias("score"))
    computed = scores.computed_totals(items, ["doc_id"], "score", named="score_id")
    checked = scores.sum_check(computed.select("doc_id", F.col("computed_total").alias("declared_total")), computed, ["doc_id"])
    return checked.select("doc_id", "state", F.array_join("bad_items", ",").alias("bad_items"))


@query("""
SELECT p_partkey, p_size::DOUBLE AS score, p_partkey % 3 = 0 AS penalty FROM part""")
def grid_scores(spark, sf_dir):
    """SF-22: scores in brackets, with a minus sign, and penalties scored in the text."""
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.concat(F.lit("扣分项（-"), "p_size", F.lit("分）"))).when(k == 1, F.concat(F.lit("信誉（ "), "p_size", F.lit(" 分 ）"))).otherwise("方案")
    parent = F.when(k == 2, F.concat(F.lit("技术(" ), "p_size", F.lit("分)"))).otherwise("")
    return read(spark, sf_dir, "part").select("p_partkey", scoring.paren_score(name, parent, F.lit("")).alias("s")).select("p_partkey", "s.*")


@query("""
WITH t AS (SELECT s_nationkey AS doc_id, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS ord FROM supplier),
f AS (SELECT *, s_suppkey // 500 AS n_cols, s_suppkey % 2 = 0 AS blank, ord % 5 <> 0 AS next_page FROM t),
g AS (SELECT *, CASE WHEN lag(next_page) OVER w AND lag(n_cols) OVER w = n_cols AND (lag(blank) OVER w OR s_suppkey % 4 = 1) THEN NULL ELSE s_suppkey END AS head FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, s_suppkey AS table_id, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM g""")
def table_islands(spark, sf_dir):
    """WN-11: suppliers of a nation as tables; every fifth is followed by a page without one."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    t = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.row_number().over(w).alias("ord"), F.col("s_suppkey").alias("table_id"))
    page = F.col("ord") + F.floor((F.col("ord") - 1) / 5)
    found = t.select("doc_id", "ord", "table_id", page.alias("first_page"), page.alias("last_page"), F.floor(F.col("table_id") / 500).alias("n_cols"), (F.col("table_id") % 4 == 1).alias("first_row_blank"), (F.col("table_id") % 2 == 0).alias("last_row_blank"))
    return scores.table_islands(found).select("doc_id", "table_id", "island")


@query("""
SELECT doc_id, ord, lot_hint FROM (SELECT conv_id AS doc_id, turn::INTEGER AS ord, role, last_value(CASE WHEN role = 'user' THEN 'hint ' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lot_hint FROM conversations) WHERE role = 'assistant'""")
def lot_hints(spark, sf_dir):
    """WN-10: assistant turns as tables, user turns as short paragraphs."""
    c = read(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "assistant", "table").when(F.col("role") == "user", "paragraph").otherwise("heading")
    b = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ord"), kind.alias("type"), F.concat(F.lit(" hint "), "turn").alias("text"))
    return scores.lot_hints(b).select("doc_id", "ord", "lot_hint")


@query("""
SELECT s_suppkey, s_name AS lot, '低价优先' AS formula, 35.0::DOUBLE AS technical, 25.0::DOUBLE AS commercial, 40.0::DOUBLE AS price, s_nationkey::DOUBLE AS down, 1.05::DOUBLE AS plus, -0.97::DOUBLE AS minus FROM supplier""")
def price_matrix(spark, sf_dir):
    """SF-23, PF-16."""
    header = F.array(*map(F.lit, ("序号", "分标名称", "权重设置", "价格公式", "下浮系数", "正向系数", "负向系数")))
    cells = F.array(F.col("s_suppkey").cast("string"), F.col("s_name"), F.lit("35：25：40"), F.lit("低价优先"), F.col("s_nationkey").cast("string"), F.lit("1.05"), F.lit("-0.97"))
    found = read(spark, sf_dir, "supplier").filter(scoring.is_price_matrix(F.array_join(header, ""))).select("s_suppkey", scoring.price_matrix(cells, header).alias("m"))
    return found.select("s_suppkey", "m.lot", "m.formula", "m.weights.*", "m.down", "m.plus", "m.minus")


@query("""
SELECT p_partkey, 2.0::DOUBLE AS unit_score, p_size::DOUBLE AS max_score_cap, (p_partkey % 9 + 1)::INTEGER AS years, (p_size * 10000)::DOUBLE AS amount_min, (p_partkey % 5 + 1)::INTEGER AS count_min, '优:16-20,良:12-15' AS grades FROM part""")
def rule_numbers(spark, sf_dir):
    """SF-21."""
    said = F.concat(F.lit("近"), F.col("p_partkey") % 9 + 1, F.lit("年完成"), F.col("p_partkey") % 5 + 1, F.lit("项，合同金额不低于"), "p_size", F.lit("万元，每项得2分，最多得"), "p_size", F.lit("分；优16-20分，良12-15分"))
    r = scoring.rule_numbers(said)
    grades = F.array_join(F.transform("r.grades", lambda g: F.concat(g["tier"], F.lit(":"), g["min"], F.lit("-"), g["max"])), ",")
    return read(spark, sf_dir, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.unit_score", "r.max_score_cap", "r.years", F.col("r.amount_min").cast("double").alias("amount_min"), "r.count_min", grades.alias("grades"))


@query("""
SELECT c_custkey AS doc_id, (c_custkey % 7 + 1)::INTEGER AS years, (c_custkey % 4 + 1)::INTEGER AS count_min, CASE WHEN c_custkey % 2 = 0 THEN '中标通知书,合同' ELSE '' END AS proofs FROM customer WHERE c_custkey % 3 <> 0""")
def performance_requirements(spark, sf_dir):
    """SF-27, SF-28, DD-2: each requirement said twice; a third has no span of years."""
    k = F.col("c_custkey")
    span = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("近"), k % 7 + 1, F.lit("年内")))
    said = F.concat(F.lit("投标人"), span, F.lit("完成类似业绩"), k % 4 + 1, F.lit("项"), F.when(k % 2 == 0, "，附中标通知书和合同").otherwise(""), F.lit("。"))
    b = read(spark, sf_dir, "customer").select(k.alias("doc_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"), said.alias("text"))
    return requirements.performances(b).select("doc_id", "p.years", "p.count_min", F.array_join("p.proofs", ",").alias("proofs"))


@query("""
SELECT c_custkey AS doc_id, p AS position, (c_custkey % 5 + 1)::INTEGER AS n, CASE WHEN p = '技术负责人' THEN '高级工程师' END AS title FROM customer, (VALUES ('技术负责人'), ('安全员')) v(p)""")
def team_members(spark, sf_dir):
    """JN-7, JN-8, DD-4, SF-32."""
    n = F.col("c_custkey") % 5 + 1
    said = F.concat(F.lit("技术负责人"), n, F.lit("名，须为高级工程师；另配备安全员"), n, F.lit("人，持证上岗；资料员若干"))
    b = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("ord"), said.alias("text"))
    return requirements.team(b).select("doc_id", "position", F.col("m.count").alias("n"), "m.title")


@query("""
SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN '一级建造师' ELSE '二级注册建造师' END AS builder, true AS no_ongoing, 3 AS years, '施工组织设计,安全文明施工,文明施工' AS must_include, 120 AS page_limit FROM customer""")
def leaders_and_plans(spark, sf_dir):
    """SF-29, SF-30, DD-3."""
    k = F.col("c_custkey")
    said = F.concat(F.lit("项目经理须具有"), F.when(k % 2 == 0, "一级建造师").otherwise("二级注册建造师"), F.lit("证书，近3年内有业绩，无在建项目；施工组织设计应含安全文明施工，不超过120页"))
    b = read(spark, sf_dir, "customer").select(k.alias("doc_id"), F.lit(0).alias("ord"), said.alias("text"))
    lead = requirements.leaders(b).select("doc_id", "p.builder", "p.no_ongoing", "p.years")
    return lead.join(requirements.plans(b).select("doc_id", F.array_join("must_include", ",").alias("must_include"), "page_limit"), "doc_id")


@query("""
SELECT c_custkey AS doc_id, 'finance' AS type, '提供近年审计报告' AS "constraint" FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'credit', '未列入失信被执行人；' || '信用中国查询结果' FROM customer""")
def commercial_requirements(spark, sf_dir):
    """JN-9, FX-12, SF-31, AG-15."""
    said = F.concat(F.lit("未列入失信被执行人。"), F.when(F.col("c_custkey") % 2 == 0, "提供近年审计报告。").otherwise("其他要求略述。"), F.lit("信用中国查询结果。"))
    b = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("ord"), said.alias("text"))
    return requirements.commercial(b)


@query("""
SELECT p_brand AS doc_id, 'S-' || p_partkey AS score_id, 'R-' || CASE WHEN p_partkey % 2 = 0 THEN 'performance' ELSE 'leader' END || ',R-team' AS refs FROM part""")
def requirement_links(spark, sf_dir):
    """JN-6: a score item's name stands for two requirement types."""
    part = read(spark, sf_dir, "part")
    items = part.select(F.col("p_brand").alias("doc_id"), F.concat(F.lit("S-"), "p_partkey").alias("score_id"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "类似业绩").otherwise("项目经理"), F.lit("与人员配备")).alias("name"))
    asked = part.select(F.col("p_brand").alias("doc_id")).distinct().select("doc_id", F.explode(F.array(*map(F.lit, ("performance", "leader", "team", "plan")))).alias("type")).withColumn("req_id", F.concat(F.lit("R-"), "type"))
    return requirements.linked(items, asked)[0].select("doc_id", "score_id", F.array_join("requirement_refs", ",").alias("refs"))


@query("""
WITH r AS (SELECT o_custkey AS doc_id, count(*)::BIGINT AS n_evidence, min(o_orderkey) AS first_ord,
  list_reduce(list(CASE o_orderkey % 4 WHEN 0 THEN ['a'] WHEN 1 THEN ['a', 'b'] WHEN 2 THEN ['b', 'c'] ELSE ['c'] END ORDER BY o_orderkey),
    lambda k, x: CASE WHEN len(list_filter(x, lambda e: NOT list_contains(k, e))) > 0 THEN x ELSE k END) AS f FROM orders GROUP BY 1)
SELECT doc_id, n_evidence, first_ord, array_to_string(f, ',') AS fields FROM r""")
def team_superset_dedupe(spark, sf_dir):
    """DD-5, DD-6, SO-5: sets of fields of which some hold others and some do not."""
    k = F.col("o_orderkey") % 4
    some = F.when(k == 0, F.array(F.lit("a"))).when(k == 1, F.array(F.lit("a"), F.lit("b"))).when(k == 2, F.array(F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("c")))
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), some.alias("fields"), F.col("o_orderkey").cast("string").alias("evidence"))
    kept = requirements.superset_dedupe(rows, ["doc_id"], "fields", "ord", "evidence")
    return kept.select("doc_id", F.size("evidence_ids").cast("long").alias("n_evidence"), F.col("ord").alias("first_ord"), F.array_join("fields", ",").alias("fields"))


@query("""
WITH s AS (SELECT s_suppkey AS doc_id, s_suppkey % 5 + 1 AS k, s_suppkey % 2 = 0 AS zoned FROM supplier)
SELECT doc_id, 'R-00' || n AS req_id, type, subject, refs, keys FROM (
  SELECT doc_id, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS n, unnest(['performance', 'leader', 'team', 'team', 'plan', 'credit', 'price', 'performance']) AS type,
    unnest(['投标人', '项目负责人', '安全员', '技术负责人', '技术标编制', '投标人', '投标报价', '投标人']) AS subject,
    unnest(['S-1', '', 'S-2', 'S-2', '', '', 'S-3', 'S-1']) AS refs,
    unnest(['count_min,proofs,years', 'builder,no_ongoing,social_security', 'certificates,count,title', CASE WHEN k % 2 = 0 THEN 'cert_no,count' ELSE 'count,title' END, 'dark_bid,fonts,must_include,page_limit', '', 'formula', 'count_min,proofs,unit_score,years']) AS keys FROM s)""")
def requirement_build(spark, sf_dir):
    """FX-11, JN-2, JN-7, DD-5, SF-29 to SF-31: blocks, a team table and score rules of a supplier; half of them have zones."""
    k, n = F.col("s_suppkey") % 2, (F.col("s_suppkey") % 5 + 1).cast("string")
    said = (
        F.concat(F.lit("投标人近5年内完成类似业绩"), n, F.lit("项，附合同。")),
        F.lit("项目经理须具有一级建造师证书并缴纳社保，无在建项目。"),
        F.lit("施工组织设计应含应急预案，不超过120页；正文字体用宋体。技术标为暗标。控制在80页以内。"),
        F.lit("未列入失信被执行人。"),
    )
    blocks = F.array(*(F.struct(F.lit(i).alias("ord"), t.alias("text")) for i, t in enumerate(said)))
    second = F.when(F.col("s_suppkey") % 5 % 2 == 1, F.concat(F.lit("技术负责人"), n, F.lit("名，建造师证书编号：京1234567"))).otherwise(F.concat(F.lit("技术负责人"), n, F.lit("名，助理工程师")))
    cells = (("岗位", "人数", "要求"), ("安全员", F.concat(n, F.lit("名")), "持安全员C证"), ("技术负责人", F.concat(n, F.lit("名")), "经验"))
    rows = F.array(*(F.struct(F.lit(i).alias("row"), F.array(*(F.lit(c) if isinstance(c, str) else c for c in row)).alias("cells")) for i, row in enumerate(cells)))
    rules = (
        ("S-1", "企业业绩", "commercial", F.concat(F.lit("近3年内承担同类业绩"), n, F.lit("项得2分，附验收报告"))),
        ("S-2", "人员配备", "technical", F.concat(F.lit("安全员"), n, F.lit("名，高级工程师，持安全员C证；"), second)),
        ("S-3", "报价", "price", F.lit("评标基准价为平均值")),
    )
    scores = F.array(*(F.struct(F.lit(i).alias("score_id"), F.lit(name).alias("name"), F.lit(c).alias("category"), rule.alias("rule_text")) for i, name, c, rule in rules))
    docs = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), blocks.alias("b"), rows.alias("r"), scores.alias("s"), k.alias("k"))
    each = lambda c: docs.select("doc_id", F.explode(c).alias("x")).select("doc_id", "x.*")
    zones = docs.filter("k = 0").select("doc_id", F.lit("scoring").alias("zone"), F.lit(0).alias("block_start"), F.lit(4).alias("block_end"))
    built = requirements.build(each("b"), each("s"), each("r").withColumn("table_id", F.lit("t")), zones)
    return built.select("doc_id", "req_id", "type", "subject", F.array_join("scoring_refs", ",").alias("refs"), F.array_join(F.array_sort(F.coalesce(F.map_keys("parsed"), F.array().cast("array<string>"))), ",").alias("keys"))


@query("""
SELECT p_partkey, p_partkey % 4 IN (0, 2) OR p_partkey % 5 = 0 AS scoring, p_partkey % 4 IN (1, 2) OR NOT (p_partkey % 4 IN (0, 2) OR p_partkey % 5 = 0) AS document FROM part""")
def usage_flags(spark, sf_dir):
    """PF-23, SF-47."""
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, "每项得２分").when(k == 1, "须提供合同复印件").when(k == 2, "加盖公章，优先考虑").otherwise("一般说明")
    return read(spark, sf_dir, "part").select("p_partkey", scoring.usage(said, F.when(F.col("p_partkey") % 5 == 0, "price").otherwise("team")).alias("u")).select("p_partkey", "u.*")


@query("""
SELECT lang, doc_id, 'STAR-' || lpad((row_number() OVER (PARTITION BY lang ORDER BY doc_id))::VARCHAR, greatest(2, length((row_number() OVER (PARTITION BY lang ORDER BY doc_id))::VARCHAR))::INTEGER, '0') AS clause_id, md5(substr(trim(text), 1, 300)) AS text_md5 FROM documents WHERE contains(text, '###')""")
def star_clauses(spark, sf_dir):
    """PF-18, WN-2, TK-7: a marker in documents, numbered within a language."""
    b = read(spark, sf_dir, "documents").select(F.col("lang").alias("doc_id"), F.col("doc_id").alias("ord"), "text")
    return requirements.star_clauses(b, "###", ()).select(F.col("doc_id").alias("lang"), F.col("ord").alias("doc_id"), "clause_id", F.md5("text").alias("text_md5"))


@query("""
SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 2 = 0 THEN 'invalid' ELSE 'rejection' END AS kind, CASE WHEN s_suppkey % 3 = 0 THEN '资格不符' ELSE '' END AS category, CASE WHEN s_suppkey % 2 = 0 THEN '投标文件无效的情形 ' ELSE '按否决投标处理 ' END || s_name AS text FROM supplier""")
def rejection_rows(spark, sf_dir):
    """FX-13, PF-17, SF-51, TK-8."""
    k = F.col("s_suppkey")
    body = F.concat(F.when(k % 2 == 0, "投标文件无效的情形 ").otherwise("按否决投标处理 "), "s_name")
    cells = F.array(k.cast("string"), F.when(k % 3 == 0, "资格不符").otherwise("一般"), body)
    header = F.array(*map(F.lit, ("序号", "情形事项", "否决规定")))
    rows = read(spark, sf_dir, "supplier").filter(scoring.is_rejection_table(F.array_join(header, ""), F.lit(2))).select(k.alias("doc_id"), F.lit("t").alias("table_id"), F.explode(F.array(F.struct(F.lit(0).alias("row"), header.alias("cells")), F.struct(F.lit(1).alias("row"), cells.alias("cells")))).alias("r"))
    return requirements.rejections(rows.select("doc_id", "table_id", "r.*", (F.col("r.row") == 0).alias("is_header"))).select("doc_id", "kind", "category", "text")


def scope_text(k):
    """R-10: voltages, facilities and works by key."""
    volt = F.when(k % 2 == 0, "±800kV ").otherwise("500千伏、1000 kV ")
    return F.concat(volt, F.when(k % 3 == 0, "换流站").when(k % 3 == 1, "变电站").otherwise("线路"), F.when(k % 5 < 2, "土建施工").otherwise("监理"))


SCOPE_SQL = """CASE WHEN k % 2 = 0 THEN '800KV' ELSE '1000KV,500KV' END AS voltages, CASE k % 3 WHEN 0 THEN '换流站' WHEN 1 THEN '变电站' ELSE '线路' END AS facilities, CASE WHEN k % 5 < 2 THEN '土建,施工' ELSE '监理' END AS works"""


@query(f"SELECT p_partkey, {SCOPE_SQL} FROM (SELECT p_partkey, p_partkey AS k FROM part)")
def scope_elements(spark, sf_dir):
    """SF-33, SF-34, SO-3."""
    s = scoring.scope(scope_text(F.col("p_partkey")))
    joined = lambda c: F.array_join(f"s.{c}", ",").alias(c)
    return read(spark, sf_dir, "part").select("p_partkey", s.alias("s")).select("p_partkey", joined("voltages"), joined("facilities"), joined("works"))


@query("""
WITH x AS (SELECT p.p_partkey, s.s_suppkey, s_suppkey % 4 = 0 AS years_asked, p_partkey % 6 = 0 AS no_year, p_partkey % 6 IN (1, 2, 3) AS recent FROM part p JOIN supplier s
  ON p.p_partkey % 2 = s.s_suppkey % 2 AND p.p_partkey % 3 = s.s_suppkey % 3 AND (p.p_partkey % 5 < 2) = (s.s_suppkey % 5 < 2) AND p_size >= 49),
v AS (SELECT *, CASE WHEN years_asked AND NOT no_year AND NOT recent THEN 'no_match' WHEN years_asked AND no_year THEN 'uncertain' ELSE 'match' END AS verdict FROM x)
SELECT p_partkey, s_suppkey, verdict, CASE WHEN verdict = 'uncertain' THEN 0.75 ELSE 0.9 END::DOUBLE AS confidence FROM v WHERE verdict <> 'no_match'""")
def performance_verdict(spark, sf_dir):
    """JN-18, SF-35: performances and criteria that share a scope, less those that turn each other down."""
    k = F.col("p_partkey")
    year = F.when(k % 6 == 0, "").when(k % 6 < 4, "，2020年竣工").otherwise("，1999年竣工")
    done = read(spark, sf_dir, "part").select(k.alias("performance_id"), scoring.performance_elements(F.concat(scope_text(k), F.lit("，合同金额"), "p_size", F.lit("万元"), year)).alias("e"))
    asked = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("criterion_id"), scoring.scope(scope_text(F.col("s_suppkey"))).alias("a"), F.lit(490_000.0).alias("amount_min"), F.when(F.col("s_suppkey") % 4 == 0, 5).alias("years"))
    return requirements.verdicts(done, asked, 2024).withColumnsRenamed({"performance_id": "p_partkey", "criterion_id": "s_suppkey"})


@query("""
WITH o AS (SELECT o_orderkey, (o_orderkey % 5 + 1)::INTEGER AS a, (o_orderkey % 5 + 1 + o_orderkey % 4)::INTEGER AS b, (o_orderkey % 3 + 20)::INTEGER AS c FROM orders)
SELECT o_orderkey, array_to_string(list_append(range(a, b + 1), c), ',') AS nums, o_orderkey % 7 <> 0 AS complete, CASE WHEN a < b THEN array_to_string([a, b], ',') ELSE a::VARCHAR END AS searched FROM o""")
def package_parse(spark, sf_dir):
    """SF-36, SF-37, SF-54, HL-6, R-9."""
    k = F.col("o_orderkey")
    a, b = k % 5 + 1, k % 5 + 1 + k % 4
    said = F.concat(F.lit("包"), a, F.lit(" 至 包0"), b, F.lit("、"), F.translate((k % 3 + 20).cast("string"), "0123456789", "０１２３４５６７８９"), F.when(k % 7 == 0, "，500千伏").otherwise(""))
    p, s = lot_names.packages(said), lot_names.searched_packages(said)
    return read(spark, sf_dir, "orders").select("o_orderkey", p.alias("p"), F.array_join(s, ",").alias("searched")).select("o_orderkey", F.array_join("p.nums", ",").alias("nums"), "p.complete", "searched")


@query("""
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'unknown' WHEN 1 THEN 'target' WHEN 2 THEN 'universal' WHEN 3 THEN 'other' WHEN 4 THEN 'unknown' WHEN 5 THEN 'other' WHEN 6 THEN 'unknown' ELSE 'unknown' END AS scope FROM orders""")
def scope_classify(spark, sf_dir):
    """SF-38 to SF-40, JN-20."""
    k = F.col("o_orderkey")
    forms = ("-", "甲::监理包2", "甲::包1-包3", "乙::包2", "包2", "甲::包5", "甲::除包2外", "甲::500千伏线路")
    lot = F.element_at(F.array(*map(F.lit, forms)), (k % 8 + 1).cast("int"))
    items = read(spark, sf_dir, "orders").select(k.alias("doc_id"), lot.alias("lot"))
    targets = items.select("doc_id", F.lit("甲::包02").alias("target_lot"))
    return lots.for_target(items, targets).select(F.col("doc_id").alias("o_orderkey"), "scope")


@query("""
WITH r AS (SELECT l_orderkey AS doc_id, l_returnflag || '::包' || l_linenumber AS lot, l_extendedprice, l_quantity, l_partkey, l_tax, l_discount FROM lineitem),
v AS (SELECT doc_id, lot, 'lot_price_limit' AS field_key, l_quantity::BIGINT::VARCHAR AS value, 0.95 AS c, [l_partkey::DOUBLE, l_extendedprice, l_tax, l_discount] AS ord FROM r UNION ALL SELECT doc_id, lot, 'scope', 'part ' || l_partkey, 0.85, [l_partkey::DOUBLE, l_extendedprice, l_tax, l_discount] FROM r)
SELECT doc_id, lot, field_key, arg_max(value, ord) AS value, max(c)::DOUBLE AS confidence FROM v GROUP BY ALL""")
def lot_fields_long(spark, sf_dir):
    """SF-43, AG-16, R-8: wide rows to long fields, the later row on ties."""
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.struct("l_partkey", "l_extendedprice", "l_tax", "l_discount").alias("ord"), F.col("l_returnflag").alias("fenbiao"), F.concat(F.lit("包"), "l_linenumber").alias("package_no"),
        F.col("l_quantity").cast("long").alias("lot_price_limit"), F.concat(F.lit("part "), "l_partkey").alias("scope"),
    )
    return lots.best_values(lots.table_fields(rows, {"lot_price_limit": 0.95, "scope": 0.85}), ["doc_id", "lot", "field_key"])


def lot_table_rows(spark, sf_dir):
    """R-8: three tables a supplier: lots with two prices, one in ten thousands; lots by name with
    a time span; and a table without lots."""
    k, n = F.col("s_suppkey"), (F.col("s_suppkey") + 1).cast("string")
    row = lambda *cells: F.array(*(c if not isinstance(c, str) else F.lit(c) for c in cells))
    prices = (
        row("分标名称", "包号", "包名称", "项目名称", "单项最高限价（万元）", "包最高限价（元）", "招标范围"),
        row(F.concat(F.lit("甲"), n), "包01", F.concat(F.lit("线路施工"), n), "—", n, F.concat(n, F.lit("000")), "全部"),
        row("", "包02", "变电 站", F.concat(F.lit("工程"), n), F.concat(n, F.lit("万元")), "面议", "/"),
        row("", "包03", "", "x", "1", "2", "y"),
    )
    spans = (
        row("标包划分", "计划开工日期", "计划竣工日期", "最高限价"),
        row(F.concat(F.lit("结算审核包"), (k % 90).cast("string")), "2026年03月1日", F.concat(F.lit("2027 年 "), (k % 12 + 1).cast("string"), F.lit("月")), "1,200元"),
        row("土建A包", "2026年3月", "待定", "无"),
    )
    other = (row("包名称", "备注"), row("包9", "x"))
    tables = F.array(*(F.struct(F.lit(t).alias("table_id"), F.lit(i).alias("row"), c.alias("cells")) for t, rows in (("t1", prices), ("t2", spans), ("t3", other)) for i, c in enumerate(rows)))
    return read(spark, sf_dir, "supplier").select(k.alias("doc_id"), F.explode(tables).alias("t")).select("doc_id", "t.*")


@query("""
WITH s AS (SELECT s_suppkey AS doc_id, (s_suppkey + 1)::VARCHAR AS n, s_suppkey AS k FROM supplier)
SELECT doc_id, lot, field_key, value, confidence::DOUBLE AS confidence FROM (
  SELECT doc_id, '甲' || n || '::包01' AS lot, unnest(['package_no', 'fenbiao', 'package_name', 'scope', 'price_limit', 'unit_price_limit', 'lot_price_limit']) AS field_key,
    unnest(['包01', '甲' || n, '线路施工' || n, '全部', n || '0000', n || '0000', n || '000']) AS value, unnest([0.9, 0.9, 0.9, 0.85, 0.95, 0.95, 0.95]) AS confidence FROM s
  UNION ALL SELECT doc_id, '包02', unnest(['package_no', 'package_name', 'project_name', 'price_limit', 'unit_price_limit']), unnest(['包02', '变电 站', '工程' || n, n || '0000', n || '0000']), unnest([0.9, 0.9, 0.9, 0.95, 0.95]) FROM s
  UNION ALL SELECT doc_id, '结算审核包' || (k % 90), unnest(['package_name', 'price_limit', 'duration']), unnest(['结算审核包' || (k % 90), '1200', '2026年3月至2027年' || (k % 12 + 1) || '月']), unnest([0.9, 0.95, 0.9]) FROM s
  UNION ALL SELECT doc_id, '土建A包', 'package_name', '土建A包', 0.9 FROM s)""")
def lot_tables(spark, sf_dir):
    """SF-42, SF-43, AG-16, HL-6."""
    return lots.best_values(lots.lot_tables(lot_table_rows(spark, sf_dir)), ["doc_id", "lot", "field_key"])


@query("""
WITH s AS (SELECT s_suppkey AS doc_id, s_suppkey::VARCHAR AS n, '包' || (s_suppkey % 90 + 1) AS lot FROM supplier)
SELECT doc_id, file_no, lot, field_key, value FROM (
  SELECT doc_id, 1 AS file_no, '施工' || lot AS lot, unnest(['project_name', 'quality_standard', 'duration', 'fund_source']) AS field_key, unnest(['东河大桥工程' || n, '合格' || n, '90天', '自筹' || n]) AS value FROM s
  UNION ALL SELECT doc_id, 2, '监理' || lot, 'site', '西区' || n FROM s)""")
def lot_file_fields(spark, sf_dir):
    """FX-8, JN-5, JN-21, SF-41: two lots' own files beside a general one; a table counts in the file that refers to it."""
    n, lot = F.col("s_suppkey").cast("string"), F.concat(F.lit("包"), (F.col("s_suppkey") % 90 + 1).cast("string"))
    block = lambda file, at, level, said, ref=None: F.struct(F.lit(file).alias("file_no"), F.lit(at).alias("ord"), F.lit(level).alias("level"), said.alias("text"), F.lit(ref).cast("string").alias("table_ref"))
    blocks = F.array(
        block(0, 0, 0, F.lit("资金来源：财政")), block(0, 1, 0, F.lit(""), "t1"),
        block(1, 2, 1, F.concat(F.lit("东河大桥工程"), n, F.lit("施工"), lot)), block(1, 3, 0, F.concat(F.lit("质量要求：合格"), n, F.lit("。项目名称：别的工程"))), block(1, 4, 0, F.lit(""), "t2"),
        block(2, 5, 0, F.concat(F.lit("建设地点：西区"), n)),
    )
    cell = lambda t, r, c, said: F.struct(F.lit(t).alias("table_id"), F.lit(r).alias("row"), F.lit(c).alias("col"), said.alias("text"))
    cells = F.array(cell("t1", 0, 0, F.lit("工期")), cell("t1", 0, 1, F.lit("10天")), cell("t2", 0, 0, F.lit("工期")), cell("t2", 0, 1, F.lit("90天")), cell("t2", 1, 0, F.lit("资金来源")), cell("t2", 1, 1, F.concat(F.lit("自筹"), n)))
    files = F.array(*(F.struct(F.lit(i).alias("file_no"), name.alias("source_file")) for i, name in enumerate((F.lit("公告.docx"), F.lit("技术文件.docx"), F.concat(F.lit("监理"), lot, F.lit("新.docx"))))))
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), blocks.alias("b"), cells.alias("c"), files.alias("f"))
    each = lambda k: rows.select("doc_id", F.explode(k).alias("x")).select("doc_id", "x.*")
    found = lots.file_fields(each("b"), each("c").withColumn("ord", F.lit(9)), lots.file_scopes(each("f"), each("b")))
    return found.select("doc_id", "file_no", "lot", "field_key", "value")


@query("""
WITH x AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, l_quantity::BIGINT AS value, CASE WHEN l_linenumber % 2 = 0 THEN '包1' WHEN l_linenumber % 3 = 0 THEN '甲::包1' ELSE '结算审核包1' END AS lot FROM lineitem)
SELECT doc_id, CASE WHEN lot = '甲::包1' THEN lot ELSE '结算审核包1' END AS lot, 'scope' AS field_key, arg_min(value, [CASE WHEN lot = '包1' THEN 1 ELSE 0 END, ord])::VARCHAR AS value
FROM (SELECT doc_id, ord, lot, min(value) AS value FROM x GROUP BY ALL) GROUP BY 1, 2""")
def lot_merge(spark, sf_dir):
    """JN-15: a lot's values under its first known name; what that name has itself stays."""
    k = F.col("l_linenumber")
    lot = F.when(k % 2 == 0, "包1").when(k % 3 == 0, "甲::包1").otherwise("结算审核包1")
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), k.alias("ord"), lot.alias("lot"), F.lit("scope").alias("field_key"), F.col("l_quantity").cast("long").alias("v"))
    values = lines.groupBy("doc_id", "ord", "lot", "field_key").agg(F.min("v").cast("string").alias("value")).withColumn("confidence", F.lit(0.9))
    known = values.select("doc_id").distinct().select("doc_id", F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("lot")) for i, n in enumerate(("结算审核包1", "包01"))))).alias("x")).select("doc_id", "x.*")
    return lots.merged_lots(values, known).select("doc_id", "lot", "field_key", "value")


@query("""
SELECT o_orderkey, lot FROM (SELECT o_orderkey, o_orderkey % 2 = 0 AS technical, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '包2' WHEN 2 THEN '包3' WHEN 3 THEN '包1-包3' ELSE '-' END AS lot FROM orders) WHERE technical AND lot <> '包3'""")
def score_selection(spark, sf_dir):
    """PF-19: technical items of a lot, of all lots or of lots unknown."""
    k = F.col("o_orderkey")
    lot = F.when(k % 5 == 0, "").when(k % 5 == 1, "包2").when(k % 5 == 2, "包3").when(k % 5 == 3, "包1-包3").otherwise("-")
    items = read(spark, sf_dir, "orders").select(k, lot.alias("lot"), F.when(k % 2 == 0, "technical").otherwise("price").alias("category"))
    return scores.selected(items, "technical", "包2").select("o_orderkey", "lot")


@query("""
WITH n AS (SELECT DISTINCT o_custkey AS doc_id, o_orderkey % 9 + 1 AS k, o_orderkey % 2 = 0 AS f FROM orders)
SELECT doc_id, arg_min(CASE WHEN f THEN '甲::包' || k ELSE '包0' || k END, [CASE WHEN f THEN 1 ELSE 0 END, k]) AS target_lot FROM n GROUP BY doc_id""")
def target_lot(spark, sf_dir):
    """TK-4, TK-5."""
    k = F.col("o_orderkey") % 9 + 1
    lot = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("甲::包"), k)).otherwise(F.concat(F.lit("包0"), k))
    return lots.target(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), lot.alias("lot")).distinct())


@query("""
SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN '监理包' || (c_custkey % 9) ELSE '包00' || (c_custkey % 9) END AS lot, CASE WHEN c_custkey % 9 < 5 THEN '包' || (c_custkey % 9) WHEN c_custkey % 2 = 0 THEN '监理包' || (c_custkey % 9) ELSE '包00' || (c_custkey % 9) END AS canonical FROM customer""")
def canonical_lots(spark, sf_dir):
    """JN-15."""
    k = F.col("c_custkey") % 9
    c = read(spark, sf_dir, "customer")
    names = c.select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("监理包"), k)).otherwise(F.concat(F.lit("包00"), k)).alias("lot"))
    return lots.canonical(names, c.filter(k < 5).select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("包"), k).alias("lot"))).select("doc_id", "lot", "canonical")


@query("""
SELECT l_returnflag AS lot, count(*)::BIGINT AS n_items, round(sum(l_quantity), 2)::DOUBLE AS total, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS categories FROM lineitem GROUP BY 1""")
def lot_summary(spark, sf_dir):
    """AG-4."""
    return lots.roll_up(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_linestatus").withColumnRenamed("l_returnflag", "lot")


@query("""
WITH t AS (SELECT c_custkey AS doc_id, ord, name, hint, root FROM customer, (VALUES (0, '封面', NULL, false), (1, '偏差表', 'commercial', false), (2, '价格文件', 'price', true), (3, '业绩说明', 'commercial', false), (4, '技术方案', 'technical', true), (5, '其他', NULL, false)) v(ord, name, hint, root)),
s AS (SELECT *, CASE WHEN hint IS NOT NULL AND (root OR ord = 1) THEN hint END AS sw FROM t)
SELECT doc_id, ord, name, coalesce(last_value(sw IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord), 'others') AS bucket FROM s""")
def outline_buckets(spark, sf_dir):
    """WN-14, SF-44."""
    titles = ("封面", "（一）偏差表", "一、价格文件", "1.1 业绩说明", "二、技术方案", "其他", "不适用。")
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(t).alias("title")) for i, t in enumerate(titles)))
    t = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(rows).alias("b")).select("doc_id", "b.*")
    return outline.buckets(t).select("doc_id", "ord", "name", "bucket")


@query("""
SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN '质量保证（10分）,服务' ELSE '施工方案,质量保证（10分）,服务' END AS added FROM customer""")
def outline_supplement(spark, sf_dir):
    """JN-14: names the outline covers are left out, and names that one added before covers."""
    names = ("施工方案", "质量保证（10分）", "质量", "服务", "服务 5分")
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(t).alias("name")) for i, t in enumerate(names)))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("technical").alias("bucket"))
    have = c.withColumn("joined", F.when(F.col("doc_id") % 2 == 0, "总体施工方案").otherwise(""))
    return outline.supplement(have, c.withColumn("b", F.explode(rows)).select("doc_id", "bucket", "b.*")).select("doc_id", F.array_join("added", ",").alias("added"))


@query("""
SELECT c_custkey AS doc_id, ord AS block_start, title FROM customer, (VALUES (3, '一、价格'), (4, '1.1 报价表')) v(ord, title)""")
def format_outline(spark, sf_dir):
    """SF-45: the sections below the format chapter."""
    said = ((1, "第一章 公告"), (0, "正文"), (1, "第六章 投标文件 格式"), (2, "一、价格"), (3, "1.1 报价表"), (1, "第七章 附件"), (2, "一、其他"))
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("level"), F.lit(t).alias("text")) for i, (n, t) in enumerate(said)))
    b = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(rows).alias("b")).select("doc_id", "b.*")
    return outline.format_subtree(structure.sections(b)).select("doc_id", "block_start", "title")


@query("""
SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n_items, round(sum(l_quantity), 2)::DOUBLE AS total FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def lot_rollup(spark, sf_dir):
    """Extension: totals by lot and category with subtotals."""
    return read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n_items"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query("""
SELECT p_partkey, p_size >= 10 AS score_table, p_partkey % 2 = 0 AS rejection_table FROM part""")
def table_classifiers(spark, sf_dir):
    """PF-15, PF-17: by header, then by the share of rows with scores."""
    header = F.lit("序号项目说明")
    return read(spark, sf_dir, "part").select(
        "p_partkey", scoring.is_score_table(header, F.lit(34), F.col("p_size")).alias("score_table"), scoring.is_rejection_table(F.when(F.col("p_partkey") % 2 == 0, "序号认定情形规定").otherwise(header), F.lit(3)).alias("rejection_table")
    )


def bundles(spark, sf_dir):
    """Blocks and tables of a supplier's document: a classic, a grid and a price table, and one that scores nothing."""
    k = F.col("s_suppkey")
    n = (k % 20 + 1).cast("string")
    said = ((1, "heading", "第一章 商务评分标准", None), (0, "paragraph", "施工包1", None), (0, "table", "", "t1"), (1, "heading", "第二章 其他", None), (0, "paragraph", "说明：", None), (0, "table", "", "t2"), (0, "table", "", "t3"), (0, "table", "", "t4"))
    block = lambda i, level, kind, text, ref: F.struct(F.lit(i).alias("ord"), F.lit(level).alias("level"), F.lit(kind).alias("type"), F.lit(text).alias("text"), F.lit(ref).cast("string").alias("table_id"))
    tables = {
        "t1": (("序号", "评分项", "分值", "评分标准"), ("商务标（40分）",), ("1", F.concat(F.lit("业绩"), k), n, "每项得2分，最多10分，附合同"), ("技术标（60分）",), ("2", "方案", "60分", "优得50-60分")),
        "t2": (("序号", "项目", "评审内容及分值", "项目内容"), ("1", "信誉（18分）", F.concat(F.lit("信用（"), n, F.lit("分）")), "甲级"), ("2", "信誉（18分）", "", "乙级"), ("3", "扣分", "不良（-5分）", "每次扣1分")),
        "t3": (("序号", "分标", "权重设置", "价格公式"), ("", "分标", "权重设置", "价格公式", "下浮系数", "正向系数"), ("1", F.col("s_name"), "30：20：50", "公式一", "0.5", "1")),
        "t4": (("奖项", "分值"), ("甲", "5分"), ("乙", "6分")),
    }
    cell = lambda c: F.lit(c) if isinstance(c, str) else c
    row = lambda t, i, cells: F.struct(F.lit(t).alias("table_id"), F.lit(i).alias("row"), F.array(*map(cell, cells)).alias("cells"))
    suppliers = read(spark, sf_dir, "supplier")
    of = lambda parts: suppliers.select(k.alias("doc_id"), F.explode(F.array(*parts)).alias("x")).select("doc_id", "x.*")
    return of([block(i, *b) for i, b in enumerate(said)]), of([row(t, i, r) for t, rows in tables.items() for i, r in enumerate(rows)])


ITEMS_SQL = """
WITH s AS (SELECT s_suppkey AS doc_id, s_name, (s_suppkey % 20 + 1)::DOUBLE AS n FROM supplier),
i AS (SELECT doc_id, 'C-001' AS score_id, 't1' AS table_id, 'commercial' AS category, '业绩' || doc_id AS name, n AS max_score, 'binary' AS rule_type, '施工包1' AS lot, 0.9 AS confidence, '合同' AS proofs FROM s
UNION ALL SELECT doc_id, 'T-001', 't1', 'technical', '方案', 60, 'graded', '施工包1', 0.9, '' FROM s
UNION ALL SELECT doc_id, 'T-002', 't2', 'technical', '信用', n, 'binary', '施工包1', 0.9, '' FROM s
UNION ALL SELECT doc_id, 'T-003', 't2', 'technical', '不良', 5, 'binary', '施工包1', 0.75, '' FROM s
UNION ALL SELECT doc_id, 'P-001', 't3', 'price', '投标报价评分（' || substr(s_name, 1, 24) || '）', 50, 'formula', s_name, 0.88, '' FROM s)
"""


@query(ITEMS_SQL + "SELECT doc_id, score_id, table_id, category, name, max_score::DOUBLE AS max_score, rule_type, lot, confidence::DOUBLE AS confidence, proofs FROM i")
def score_items_of_tables(spark, sf_dir):
    """FX-9, PF-15, JN-1, WN-10, TK-10: items of all table forms."""
    blocks, rows = bundles(spark, sf_dir)
    items, _ = score_items.extract(rows, blocks, structure.sections(blocks), structure.zones(blocks))
    return items.select("doc_id", "score_id", "table_id", "category", "name", "max_score", "rule_type", "lot", "confidence", F.array_join("proofs", ",").alias("proofs"))


@query(ITEMS_SQL + """
SELECT doc_id, category, lot, declared_total::DOUBLE AS declared_total, computed_total::DOUBLE AS computed_total, CASE WHEN abs(declared_total - computed_total) <= 0.01 THEN 'passed' ELSE 'failed' END AS state FROM (
  SELECT doc_id, category, lot, CASE category WHEN 'commercial' THEN 40 ELSE 78 END AS declared_total, round(sum(CASE WHEN name = '不良' THEN 0 ELSE max_score END), 2) AS computed_total FROM i WHERE category <> 'price' GROUP BY ALL)""")
def score_item_checks(spark, sf_dir):
    """AG-1, AG-2, FX-9: totals that category rows and grid parents declare against the items' sums; deductions do not count."""
    blocks, rows = bundles(spark, sf_dir)
    items, totals = score_items.extract(rows, blocks, structure.sections(blocks), structure.zones(blocks))
    return score_items.checks(items, totals).select("doc_id", "category", "lot", "declared_total", "computed_total", "state")


@query("SELECT s_suppkey AS doc_id, 8::BIGINT AS blocks, 4::BIGINT AS tables, 3::BIGINT AS fields_found, 5::BIGINT AS score_items, 0::BIGINT AS star_clauses, 0::BIGINT AS lots, 31::BIGINT AS fields_total FROM supplier")
def report_statistics(spark, sf_dir):
    """AP-9, AG-6: counts of the frames of whole reports; the fields are the weights of the price table."""
    from . import report

    out = report.analyse(*bundles(spark, sf_dir), as_of=F.lit("2026-06-01").cast("date"))
    return out["statistics"].drop("requirements")


@query("""
WITH x AS (SELECT p_partkey, p_size % 2 = 0 AS s, p_size % 3 = 0 AS d, CASE p_partkey % 4 WHEN 0 THEN 'performance' WHEN 1 THEN 'leader' WHEN 2 THEN 'team' ELSE 'own' END AS t FROM part)
SELECT p_partkey, CASE WHEN NOT s AND NOT d THEN '' ELSE concat_ws('/', CASE WHEN s THEN '评分要求' END, CASE WHEN d THEN '标书要求' END) || '-' || CASE WHEN d AND t IN ('leader', 'team') THEN '人员简历' WHEN t = 'performance' THEN '业绩要求' WHEN t = 'own' THEN 'own' ELSE '人员要求' END END AS label FROM x""")
def usage_labels(spark, sf_dir):
    """SF-47."""
    kind = F.when(F.col("p_partkey") % 4 == 0, "performance").when(F.col("p_partkey") % 4 == 1, "leader").when(F.col("p_partkey") % 4 == 2, "team").otherwise("own")
    return read(spark, sf_dir, "part").select("p_partkey", scoring.usage_label(F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0, kind).alias("label"))
