"""Requirements, their links to score items, star clauses and rejections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from . import structure

# Words of a score item's name and the requirement type they stand for.
LINKS = (
    ("业绩", "performance"), ("负责人", "leader"), ("项目经理", "leader"), ("人员", "team"), ("配备", "team"), ("方案", "plan"), ("组织设计", "plan"), ("资质", "qualification"), ("认证", "qualification"),
    ("财务", "finance"), ("信用", "credit"), ("荣誉", "honor"), ("奖项", "honor"), ("承诺", "commitment"), ("报价", "price"), ("价格", "price"),
)
# Words of commercial requirements by type, positions of a team, parts of a plan.
COMMERCIAL = {
    "qualification": ("ISO9001", "ISO14001", "ISO45001", "质量管理体系", "环境管理体系", "职业健康安全", "信用等级", "AAA"),
    "finance": ("审计报告", "财务报告", "财务状况", "资产负债", "营业收入", "纳税", "税收", "银行资信"),
    "credit": ("信用中国", "失信被执行人", "重大税收违法", "严重违法失信", "行贿犯罪", "失信名单"),
    "honor": ("优质工程", "鲁班奖", "詹天佑", "奖项", "荣誉", "示范工程"),
    "commitment": ("承诺函", "质保期", "保修", "服务承诺", "响应时间", "驻场"),
}
POSITIONS = tuple(scoring.CERTIFICATES)
TEAM_HEADS = ("岗位", "人员", "职务", "拟投入")
PLAN_PARTS = ("施工组织设计", "施工方案", "总体概述", "进度计划", "质量保证", "安全文明施工", "绿色施工", "应急预案", "组织机构", "资源配置", "文明施工", "环境保护", "劳动力计划")

ZONES = {
    "performance": ("scoring", "qualification", "evaluation_method"),
    "leader": ("scoring", "qualification", "instructions"),
    "team": ("scoring", "tech_requirements"),
    "plan": ("scoring", "format"),
    "commercial": ("scoring", "qualification", "evaluation_method"),
}


def sentence_rows(blocks: DataFrame) -> DataFrame:
    """SF-15: a row for each sentence of a block."""
    return blocks.select("doc_id", "ord", F.posexplode(text.sentences(F.col("text"))).alias("sentence_no", "sentence"))


def performances(blocks: DataFrame) -> DataFrame:
    """SF-27, SF-28, DD-2: performance requirements, the first of equal ones in a document."""
    read = sentence_rows(blocks).withColumn("p", scoring.performance(F.col("sentence"))).filter("p is not null")
    key = ["doc_id", "p.years", "p.amount_min", "p.count_min", F.array_sort("p.proofs")]
    first = Window.partitionBy(*key).orderBy("ord", "sentence_no")
    return read.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("doc_id", "ord", F.lit("performance").alias("type"), F.lit("投标人").alias("subject"), F.substring("sentence", 1, 300).alias("constraint"), "p")


def has_detail(member: Column) -> Column:
    return F.coalesce(member["count"].cast("string"), member["title"], member["cert_no"], F.get(member["certificates"], F.lit(0))).isNotNull()


def team(blocks: DataFrame, positions=POSITIONS) -> DataFrame:
    """JN-8, DD-4: a row for each position that a sentence names with a detail."""
    read = sentence_rows(blocks).withColumn("position", F.explode(text.contained(positions, F.col("sentence"))))
    seen = read.withColumn("m", scoring.team_member(F.col("sentence"), F.col("position"))).filter(has_detail(F.col("m")))
    first = Window.partitionBy("doc_id", "position", F.to_json("m")).orderBy("ord", "sentence_no")
    return seen.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def team_tables(rows: DataFrame, positions=POSITIONS) -> DataFrame:
    """JN-7: a row for each position that a row of a team table names.

    rows has doc_id, table_id, row and cells. A team table's header says so, or its rows name two
    positions or more.
    """
    table = Window.partitionBy("doc_id", "table_id")
    whole = rows.withColumn("said", F.array_join(F.transform("cells", lambda c: F.trim(c)), " ")).withColumn("named", text.contained(positions, F.col("said")))
    header = F.first("said").over(table.orderBy("row"))
    n_positions = F.size(F.array_distinct(F.flatten(F.collect_set("named").over(table))))
    kept = whole.withColumn("header", header).withColumn("n_positions", n_positions).filter(scoring.has_any(F.col("header"), TEAM_HEADS) | (F.col("n_positions") >= 2))
    each = kept.select("doc_id", "table_id", "row", "said", F.explode("named").alias("position"))
    title = scoring.found(F.col("said"), "([一-龥]{1,4}职称|高级工程师|中级工程师|助理工程师)")
    count = scoring.found(F.col("said"), r"(\d+)\s*(?:名|人)").try_cast("int")
    m = F.struct(count.alias("count"), title.alias("title"), F.lit(None).cast("string").alias("cert_no"), scoring.certificates(F.col("position"), F.col("said")).alias("certificates"))
    return each.withColumn("m", m)


def leader(sentence: Column) -> Column:
    """SF-29: what a sentence asks of the project leader; null if it is not on them."""
    parsed = F.struct(
        scoring.found(sentence, "([一二壹贰]级(?:注册)?建造师)").alias("builder"),
        scoring.found(sentence, "(高级工程师|中级工程师|初级工程师|高级职称|中级职称)").alias("title"),
        F.rlike(sentence, F.lit("在建|不得同时")).alias("no_ongoing"),
        scoring.found(sentence, scoring.YEAR_WINDOW).try_cast("int").alias("years"),
        F.rlike(sentence, F.lit("社保|养老保险")).alias("social_security"),
    )
    return F.when(F.rlike(sentence, F.lit("项目经理|项目负责人|总监理工程师")), parsed)


def leaders(blocks: DataFrame) -> DataFrame:
    """SF-29, DD-3: requirements of the project leader, one for each 50-character beginning."""
    read = sentence_rows(blocks).withColumn("p", leader(F.col("sentence"))).filter("p is not null")
    first = Window.partitionBy("doc_id", F.substring("sentence", 1, 50)).orderBy("ord", "sentence_no")
    return read.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def plans(blocks: DataFrame) -> DataFrame:
    """SF-30: one row a document: parts that a plan must include, in their fixed order, the last
    page limit, and the sentences on anonymity and on fonts, in order."""
    s = F.col("sentence")
    limit = scoring.found(s, r"(?:不超过|不得超过|控制在)\s*(\d{2,4})\s*(?:页|张)").try_cast("int")
    at = F.struct("ord", "sentence_no")
    of = lambda pattern, n: F.transform(F.array_sort(F.collect_list(F.when(F.rlike(s, F.lit(pattern)), F.struct("ord", "sentence_no", F.substring(s, 1, n).alias("s"))))), lambda x: x["s"])
    said = sentence_rows(blocks).groupBy("doc_id").agg(
        F.max_by(limit, F.when(limit.isNotNull(), at)).alias("page_limit"),
        of("暗标|不得出现.{0,40}(单位名称|姓名|标识|图章|印章)|身份标识", 150).alias("dark_bid"),
        of(r"(字体|字号).{0,30}(宋体|仿宋|黑体|楷体|小[一二三四]|\d+(\.\d+)?号)", 120).alias("fonts"),
    )
    parts = F.array_distinct(F.flatten(F.collect_set(text.contained(PLAN_PARTS, F.col("text")))))
    named = blocks.groupBy("doc_id").agg(parts.alias("parts")).select("doc_id", F.filter(F.array(*map(F.lit, PLAN_PARTS)), lambda x: F.array_contains("parts", x)).alias("must_include"))
    empty = F.array().cast("array<string>")
    both = named.join(said, "doc_id", "left")
    return both.select("doc_id", "must_include", "page_limit", F.coalesce("dark_bid", empty).alias("dark_bid"), F.coalesce("fonts", empty).alias("fonts"))


def commercial(blocks: DataFrame, words: dict = COMMERCIAL, shown: int = 5, width: int = 400) -> DataFrame:
    """JN-9, FX-12: sentences with a type's words, once each; the first ones of each document and
    type are its text."""
    rows = sentence_rows(blocks)
    kinds = F.array_compact(F.array(*(F.when(scoring.has_any(F.col("sentence"), w), F.lit(k)) for k, w in words.items())))
    hit = rows.withColumn("type", F.explode(kinds)).groupBy("doc_id", "type", "sentence").agg(F.min(F.struct("ord", "sentence_no")).alias("at"))
    ranked = hit.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "type").orderBy("at"))).filter(F.col("_n") <= shown)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "sentence"))), lambda x: x["sentence"]), "；")
    return ranked.groupBy("doc_id", "type").agg(F.substring(joined, 1, width).alias("constraint"))


def linked(scores: DataFrame, requirements: DataFrame, links=LINKS) -> tuple[DataFrame, DataFrame]:
    """JN-6: requirement ids per score item and score ids per requirement, where a word of the
    item's name stands for the requirement's type."""
    types = F.array_distinct(F.array_compact(F.array(*(F.when(F.contains("name", F.lit(w)), F.lit(t)) for w, t in links))))
    named = scores.select("doc_id", "score_id", F.explode(types).alias("type"))
    met = named.join(requirements.select("doc_id", "req_id", "type"), ["doc_id", "type"])
    return (
        met.groupBy("doc_id", "score_id").agg(F.array_sort(F.collect_set("req_id")).alias("requirement_refs")),
        met.groupBy("doc_id", "req_id").agg(F.array_sort(F.collect_set("score_id")).alias("scoring_refs")),
    )


def superset_dedupe(rows: DataFrame, keys: list[str], fields: str, order: str, evidence: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """DD-5, DD-6, SO-5: one entry a key, with the `kept` columns of the entry that stays, the
    order of the first, and all evidence.

    A fold in order: an entry with any field that the one so far lacks takes its place.
    """
    entry = F.struct(order, fields, evidence, F.struct(*kept).alias("kept") if kept else F.lit(None).alias("kept"))
    sorted_rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("all"))

    def step(acc, x):
        more = F.size(F.array_except(x[fields], acc[fields])) > 0
        taken = F.when(more, x).otherwise(acc)
        return F.struct(acc[order].alias(order), taken[fields].alias(fields), taken[evidence].alias(evidence), taken["kept"].alias("kept"))

    start = F.get("all", F.lit(0))
    folded = sorted_rows.withColumn("k", F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(1))), start, step))
    united = F.array_distinct(F.transform("all", lambda x: x[evidence]))
    return folded.select(*keys, F.col(f"k.{order}").alias(order), F.col(f"k.{fields}").alias(fields), united.alias("evidence_ids"), *(F.col(f"k.kept.{c}").alias(c) for c in kept))


DIMENSIONS = ("facilities", "voltages", "works")


#: Lists that the criteria of one kind are dealt into.
LISTS = 64


def verdicts(done: DataFrame, asked: DataFrame, as_of_year: int) -> DataFrame:
    """JN-18: verdict and confidence of the performances that a criterion does not turn down.

    done has performance_id and e (`scoring.performance_elements`), asked criterion_id, a
    (`scoring.scope`), amount_min and years. A verdict hangs on these alone, so it is made once for
    each pair of kinds, which are equal elements and equal demands. The pairs of rows, a share of all
    there can be, then only name it: performances are dealt over all tasks and meet the criteria of a
    kind in lists of ids, so no task or row holds the pairs of a kind.
    """
    demand = ("a", "amount_min", "years")
    kind = F.to_json(F.struct(*demand)).alias("kind")
    judged = kind_verdicts(done.select("e").distinct(), asked.select(*demand).distinct(), as_of_year).select("e", kind, "verdict", "confidence")
    part = F.pmod(F.xxhash64("criterion_id"), F.lit(LISTS)).cast("int").alias("part")
    lists = asked.select("criterion_id", kind, part).groupBy("kind", "part").agg(F.collect_list(F.struct("criterion_id")).alias("ids"))
    tasks = int(done.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turned = done.join(judged, "e").select("performance_id", "kind", "verdict", "confidence").repartition(tasks, "performance_id")
    each = turned.select("*", F.explode(F.sequence(F.lit(0), F.lit(LISTS - 1))).alias("part"))
    return each.join(lists, ["kind", "part"]).select("performance_id", F.inline("ids"), "verdict", "confidence")


def kind_verdicts(done: DataFrame, asked: DataFrame, as_of_year: int) -> DataFrame:
    """JN-18: e, a, amount_min, years, verdict and confidence of the pairs that are no `no_match`.

    In each dimension that a criterion names a pair must share an element, or the performance says
    nothing of it; so pairs meet in a join on an element of every named dimension at once, and those
    that do not meet are no match. Subdivision, amount and years turn pairs down within the join,
    before a verdict is made.
    """
    none, any_ = F.array(F.lit("")), F.array(F.lit("*"))
    names = [F.size(F.col(f"a.{d}")) > 0 for d in DIMENSIONS]
    mask = F.concat(*(F.when(n, "1").otherwise("0") for n in names))
    wanted = asked.withColumn("mask", mask)
    for d, named in zip(DIMENSIONS, names):
        wanted = wanted.withColumn(f"by_{d}", F.explode(F.when(named, F.array_distinct(F.concat(F.col(f"a.{d}"), none))).otherwise(any_)))
    shown = done.withColumn("mask", F.explode(F.array(*(F.lit(f"{m:03b}") for m in range(8)))))
    for i, d in enumerate(DIMENSIONS):
        have = F.when(F.size(F.col(f"e.{d}")) > 0, F.array_distinct(F.col(f"e.{d}"))).otherwise(none)
        shown = shown.withColumn(f"by_{d}", F.explode(F.when(F.substring("mask", i + 1, 1) == "1", have).otherwise(any_)))
    keys = ["mask", *(f"by_{d}" for d in DIMENSIONS)]
    e, a = shown.alias("p"), wanted.alias("q")
    fits = F.col("q.a.subdivision").isNull() | F.col("p.e.subdivision").isNull() | (F.col("p.e.subdivision") == F.col("q.a.subdivision"))
    fits &= F.col("amount_min").isNull() | F.col("p.e.amount").isNull() | (F.col("p.e.amount") >= F.col("amount_min"))
    fits &= F.col("years").isNull() | (F.size(F.col("p.e.years")) == 0) | (F.array_max(F.col("p.e.years")) >= as_of_year - F.col("years") - 1)
    met = e.join(a, [*(F.col(f"p.{k}") == F.col(f"q.{k}") for k in keys), fits]).select("e", "a", "amount_min", "years", *(F.col(f"p.{k}").alias(k) for k in keys))
    once = F.lit(True)  # a pair that shares several elements counts once
    for d in DIMENSIONS:
        shared = F.coalesce(F.get(F.array_intersect(F.col(f"e.{d}"), F.col(f"a.{d}")), F.lit(0)), F.lit(""))
        once &= F.col(f"by_{d}").isin("*", "") | (F.col(f"by_{d}") == shared)
    v = scoring.verdict(F.col("e"), F.col("a"), F.col("amount_min"), F.col("years"), F.lit(as_of_year))
    return met.filter(once).select("e", "a", "amount_min", "years", F.explode(F.array(v)).alias("v")).select("e", "a", "amount_min", "years", "v.*").filter("verdict <> 'no_match'")


def star_clauses(blocks: DataFrame, marker: str = "★", meta: tuple[str, ...] = ("标注", "标有", "带★"), width: int = 300) -> DataFrame:
    """PF-18, WN-2, TK-7: blocks with the marker that do not explain it, numbered."""
    hits = blocks.filter(F.contains("text", F.lit(marker)))
    if meta:
        hits = hits.filter(~scoring.has_any(F.col("text"), meta))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    return hits.select("doc_id", "ord", F.format_string("STAR-%02d", n).alias("clause_id"), F.substring(F.trim("text"), 1, width).alias("text"))


def rejections(rows: DataFrame) -> DataFrame:
    """FX-13, SF-51, TK-8: body rows of rejection tables: the longest cell is the text.

    rows has doc_id, table_id, row, cells and is_header.
    """
    cells = F.transform("cells", lambda c: F.trim(c))
    joined = F.array_join(F.filter(cells, lambda c: c != ""), " ")
    longest = F.aggregate(cells, F.lit(""), lambda a, c: F.when(F.length(c) > F.length(a), c).otherwise(a))
    category = F.coalesce(*(F.when(F.contains(joined, F.lit(w)), F.lit(w)) for w in scoring.REJECTION_CATEGORIES), F.lit(""))
    body = rows.filter(~F.col("is_header")).filter(F.length(joined) >= 8)
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("table_id", "row"))
    return body.select("doc_id", "table_id", "row", F.format_string("RJ-%03d", n).alias("rej_id"), scoring.rejection_kind(joined).alias("kind"), category.alias("category"), longest.alias("text"))


def _placed(rows: DataFrame, branch: int, at: Column, kind: str | Column, subject: str | Column, said: Column, confidence: float, parsed: Column | None = None, refs: Column | None = None) -> DataFrame:
    """Requirements of a branch in one shape; parsed has the entries of the map of what was read."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    read = F.array().cast("array<struct<key:string,value:string>>") if parsed is None else F.map_entries(parsed)
    return rows.select(
        "doc_id",
        F.struct(F.lit(branch).alias("branch"), at.cast("string").alias("at")).alias("place"),
        lit(kind).alias("type"),
        lit(subject).alias("subject"),
        F.substring(said, 1, 300).alias("constraint"),
        read.alias("parsed"),
        F.lit(confidence).alias("confidence"),
        (F.array().cast("array<string>") if refs is None else refs).alias("own_refs"),
    )


def _at(*parts: str) -> Column:
    """A text that sorts like the numbers and texts it is made of."""
    return F.concat_ws("|", *(F.coalesce(F.lpad(F.col(p).try_cast("long").cast("string"), 12, "0"), F.col(p).cast("string")) for p in parts))


def _map(struct: Column, *names: str) -> Column:
    """The fields of a struct that have a value, as JSON; null, false and empty ones have none."""
    shown = lambda n: F.regexp_extract(F.to_json(F.struct(struct[n].alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.map_filter(F.create_map(*(x for n in names for x in (F.lit(n), shown(n)))), lambda k, v: ~v.isin("", "false", "[]"))


MEMBER = ("count", "title", "cert_no", "certificates")
LEADER = ("builder", "title", "no_ongoing", "years", "social_security")
PERFORMANCE = ("years", "count_min", "amount_min", "proofs", "unit_score")


def from_scores(scores: DataFrame) -> DataFrame:
    """FX-11, SF-29: requirements inside the rules of score items of ten characters and more."""
    rules = scores.filter(F.length("rule_text") >= 10).select("doc_id", "score_id", F.posexplode(text.sentences(F.col("rule_text"))).alias("sentence_no", "sentence"))
    s, refs, at = F.col("sentence"), F.array("score_id"), _at("score_id", "sentence_no")
    p = rules.withColumn("p", scoring.performance(s)).filter("p is not null")
    out = _placed(p, 7, at, "performance", "投标人", s, 0.82, _map(F.col("p"), *PERFORMANCE), refs)
    m = rules.withColumn("position", F.explode(text.contained(POSITIONS, s))).withColumn("m", scoring.team_member(s, F.col("position"))).filter(has_detail(F.col("m")))
    out = out.unionByName(_placed(m, 7, at, "team", F.col("position"), s, 0.78, _map(F.col("m"), *MEMBER), refs))
    lead = rules.withColumn("p", leader(s)).filter("p is not null and (p.builder is not null or p.title is not null or p.no_ongoing)")
    return out.unionByName(_placed(lead, 7, at, "leader", "项目负责人", s, 0.82, _map(F.col("p"), "builder", "title", "no_ongoing"), refs))


def price_rules(scores: DataFrame) -> DataFrame:
    """SF-31: the rules of price items."""
    rows = scores.filter("category = 'price' and rule_text <> ''")
    return _placed(rows, 6, _at("score_id"), "price", "投标报价", F.col("rule_text"), 0.85, F.create_map(F.lit("formula"), F.col("rule_text")), F.array("score_id"))


def build(blocks: DataFrame, scores: DataFrame, rows: DataFrame | None = None, zones: DataFrame | None = None) -> DataFrame:
    """FX-11: all requirements of documents in branch order, with ids, uses and score links.

    scores has doc_id, score_id and name, and category and rule_text if rules are to be read; rows
    has the tables' doc_id, table_id, row and cells; zones is what `structure.zones` returns. A
    branch reads its zones' blocks, all blocks of a document without them. Entries of one position
    are one requirement.
    """
    near = lambda branch: blocks if zones is None else structure.within_or_all(blocks, zones.filter(F.col("zone").isin(*ZONES[branch])))
    bidder = "投标人"
    out = _placed(performances(near("performance")), 0, _at("ord"), "performance", bidder, F.col("constraint"), 0.85, _map(F.col("p"), *PERFORMANCE))
    out = out.unionByName(_placed(leaders(near("leader")), 1, _at("ord", "sentence_no"), "leader", "项目负责人", F.col("sentence"), 0.85, _map(F.col("p"), *LEADER)))
    if rows is not None:
        out = out.unionByName(_placed(team_tables(rows), 2, _at("table_id", "row"), "team", F.col("position"), F.col("said"), 0.88, _map(F.col("m"), *MEMBER)))
    out = out.unionByName(_placed(team(near("team")), 3, _at("ord", "sentence_no"), "team", F.col("position"), F.col("sentence"), 0.75, _map(F.col("m"), *MEMBER)))
    plan = plans(near("plan")).filter("size(must_include) + size(dark_bid) + size(fonts) > 0 or page_limit is not null")
    out = out.unionByName(_placed(plan, 4, F.lit("0"), "plan", "技术标编制", F.concat_ws("；", F.array_join("must_include", "、"), F.array_join("dark_bid", "；"), F.array_join("fonts", "；")), 0.85, _map(F.struct("must_include", "page_limit", "dark_bid", "fonts"), "must_include", "page_limit", "dark_bid", "fonts")))
    order = F.create_map(*(F.lit(x) for i, k in enumerate(COMMERCIAL) for x in (k, str(i))))
    out = out.unionByName(_placed(commercial(near("commercial")), 5, F.element_at(order, F.col("type")), F.col("type"), bidder, F.col("constraint"), 0.8))
    if "rule_text" in scores.columns:
        out = out.unionByName(price_rules(scores)).unionByName(from_scores(scores))
    entries = out.filter("type = 'team'").withColumn("fields", F.transform("parsed", lambda e: e["key"])).withColumn("evidence", F.to_json("place"))
    members = superset_dedupe(entries, ["doc_id", "type", "subject"], "fields", "place", "evidence", ("constraint", "parsed", "confidence", "own_refs"))
    united = out.filter("type <> 'team'").unionByName(members.select(*out.columns))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("place", "type", "subject", "constraint"))
    numbered = united.withColumn("req_id", F.format_string("R-%03d", n)).withColumn("use", scoring.usage(F.col("constraint"), F.col("type")))
    refs = F.array_distinct(F.concat("own_refs", F.coalesce("scoring_refs", F.array().cast("array<string>"))))
    linked_rows = numbered.join(linked(scores, numbered)[1], ["doc_id", "req_id"], "left")
    return linked_rows.select("doc_id", "req_id", "type", "subject", "constraint", F.map_from_entries("parsed").alias("parsed"), "confidence", F.col("use.scoring").alias("for_scoring"), F.col("use.document").alias("for_document"), refs.alias("scoring_refs"))
