"""Score items of all tables of a document: which tables score, their form, category and lot, and
the items and declared totals that their rows give.

A table's own facts (header, rows that look like scores) come from one aggregate; they are joined
to its rows once, and each form is then a branch of the same frame. A table is a price matrix, else a
score table in grid or classic form, else none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from . import scores, structure

# What a table's place in a row is not named by, what a price rule without a score is
# announced by, confidences, and the letter of a category's ids.
SERIAL = "^(?:[一二三四五六七八九十]{1,3}|[0-9]{1,3})$"
PRICE_RULES = "投标报价评分标准|评标价格计算公式|价格评分标准"
CONFIDENCE = {"classic": 0.9, "grid": 0.9, "penalty": 0.75, "matrix": 0.88, "formula": 0.7}
PREFIXES = {"technical": "T", "commercial": "C", "price": "P"}
SCORE_ZONES = ("scoring", "evaluation_method")
ITEM = ("doc_id", "table_id", "place", "row", "category", "name", "max_score", "rule_type", "rule_text", "numbers", "extra", "formula", "proofs", "snippet", "confidence", "lot")
LAST = 1 << 30


def table_facts(rows: DataFrame) -> DataFrame:
    """PF-15, PF-16: doc_id, table_id, header, sub_header, form and table_category of each table."""
    cells = F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))))
    scored = F.exists("cells", lambda c: F.rlike(c, F.lit(scoring.SCORE_IN_TEXT)))
    at = lambda k: F.max(F.when(F.col("row") == k, F.col("cells")))
    joined = lambda *names: F.concat_ws("", *(F.array_join(n, "") for n in names))
    facts = rows.withColumn("cells", cells).groupBy("doc_id", "table_id").agg(at(0).alias("header"), at(1).alias("second"), at(2).alias("third"), F.count(F.lit(1)).alias("n_rows"), F.count_if(scored).alias("n_scored"))
    head = joined("header")
    form = (
        F.when(scoring.is_price_matrix(joined("header", "second")), "matrix")
        .when(~scoring.is_score_table(head, F.col("n_rows"), F.col("n_scored")), None)
        .when(scoring.is_grid_table(head, F.col("n_rows")), "grid").otherwise("classic")
    )
    guess = scoring.category(F.concat_ws(" ", *(F.array_join(n, "") for n in ("header", "second", "third"))))
    return facts.select("doc_id", "table_id", "header", F.coalesce("second", "header").alias("sub_header"), form.alias("form"), guess.alias("guess"))


def placed_tables(facts: DataFrame, blocks: DataFrame | None, tree: DataFrame | None, zones: DataFrame | None) -> DataFrame:
    """JN-1, WN-10, TK-10: the facts with category, lot and place, the order in which tables count.

    The category is that of the innermost section's title, else of the first rows, else technical. The
    lot is the last short paragraph before the table. Tables in a score zone come first.
    blocks has doc_id, ord, type, text and table_id of the table that a block stands for.
    """
    kept = facts.filter("form is not null")
    default = F.lit("technical")
    if blocks is None:
        return kept.select("*", F.coalesce("guess", default).alias("category"), F.lit("").alias("lot"), F.row_number().over(Window.partitionBy("doc_id").orderBy("table_id")).alias("place")).drop("guess")
    hints = scores.lot_hints(blocks).groupBy("doc_id", "table_id").agg(F.min_by(F.struct("ord", "lot_hint"), "ord").alias("h"))
    known = kept.join(hints, ["doc_id", "table_id"], "left").select(*kept.columns, F.coalesce("h.ord", F.lit(LAST)).alias("ord"), F.coalesce("h.lot_hint", F.lit("")).alias("lot"))
    if tree is not None:
        known = structure.deepest_section(known, tree).withColumn("guess", F.coalesce(scoring.category(F.col("title")), "guess")).drop("title", "level")
    near = known.select("doc_id", "ord").limit(0).withColumn("in_zone", F.lit(True)) if zones is None else structure.within(known.select("doc_id", "ord"), zones.filter(F.col("zone").isin(*SCORE_ZONES))).select("doc_id", "ord").distinct().withColumn("in_zone", F.lit(True))
    order = Window.partitionBy("doc_id").orderBy(F.coalesce("in_zone", F.lit(False)).desc(), "ord", "table_id")
    return known.join(near, ["doc_id", "ord"], "left").withColumn("place", F.row_number().over(order)).withColumn("category", F.coalesce("guess", default)).drop("guess", "in_zone", "ord")


def _items(rows: DataFrame, **made: Column) -> DataFrame:
    nothing = {"extra": F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), "formula": F.lit(None).cast("string")}
    given = nothing | made
    return rows.select("doc_id", "table_id", "place", "row", *(given[c].alias(c) for c in ITEM[4:-1]), "lot")


def _formula(rule: Column, category: Column) -> Column:
    return F.when((category == "price") & F.rlike(rule, F.lit(scoring.FORMULA)), rule)


def classic(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FX-9, WN-8: items of classic tables, and the totals that their category rows declare.

    The first short cell of a row that has a category word names the category of the rows from there
    on; a row of at most two filled cells then only declares, its score the category's total. In
    other rows the first short cell that is no serial and no score is the name, the longest other
    one the rule. A row without a score that announces a price rule is a formula item.
    """
    own = F.get(F.filter(F.transform("cells", lambda c: F.when((c != "") & (F.length(c) <= 14), F.struct(scoring.category(c).alias("category"), c.alias("cell")))), lambda x: x["category"].isNotNull()), F.lit(0))
    before = Window.partitionBy("doc_id", "table_id").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("filled", F.filter("cells", lambda c: c != "")).withColumn("own", own)
    seen = seen.withColumn("category", F.coalesce(F.last("own.category", ignorenulls=True).over(before), "category")).filter(F.size("filled") > 0)
    only = F.col("own").isNotNull() & (F.size("filled") <= 2)
    total = scoring.found(F.col("own.cell"), r"[（(]?\s*(\d{1,3})\s*分\s*[）)]?").try_cast("double")
    declared = seen.filter(only).select("doc_id", "table_id", "row", F.col("own.category").alias("category"), "lot", total.alias("total")).filter("total is not null")

    scored = seen.filter(~F.coalesce(only, F.lit(False))).withColumn("score", scoring.score_cell(F.col("cells"), F.col("header"))).withColumn("joined", F.array_join("filled", " "))
    announced = F.col("score").isNull() & F.rlike("joined", F.lit(PRICE_RULES))
    cut = F.substring("joined", 1, 500)
    formulas = _items(
        scored.filter(announced), category=F.lit("price"), name=F.lit("投标报价评分"), max_score=F.lit(0.0), rule_type=F.lit("formula"), rule_text=cut, numbers=scoring.rule_numbers(F.lit("")), formula=cut, proofs=scoring.proofs(F.lit("")), snippet=F.substring("joined", 1, 200), confidence=F.lit(CONFIDENCE["formula"]),
        extra=F.create_map(F.lit("formula_blob"), F.lit("true")),
    )
    number = F.regexp_extract
    same = lambda c: F.coalesce(number(c, r"^\s*(\d{1,3}(?:\.\d{1,2})?)\s*分?\s*$", 1).try_cast("double") == F.col("score.score"), F.lit(False))
    said = F.filter(F.transform("cells", lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda x: (x["c"] != "") & (x["i"] != F.col("score.col")) & ~F.rlike(x["c"], F.lit(SERIAL)) & ~same(x["c"]))
    named = scored.filter(F.col("score.score") > 0).withColumn("said", said).withColumn("named", F.get(F.filter("said", lambda x: F.length(x["c"]) <= 30), F.lit(0)))
    longest = F.aggregate(F.filter("said", lambda x: F.col("named").isNull() | (x["i"] != F.col("named.i"))), F.lit(""), lambda best, x: F.when(F.length(x["c"]) > F.length(best), x["c"]).otherwise(best))
    ruled = named.withColumn("rule", longest)
    unnamed = F.when(F.col("rule") != "", F.substring("rule", 1, 20)).otherwise(F.format_string("评分项(%s r%d)", "table_id", "row"))
    rule, kind = F.col("rule"), F.col("category")
    items = _items(
        ruled, category=kind, name=F.substring(F.coalesce("named.c", unnamed), 1, 40), max_score=F.col("score.score"), rule_type=scoring.rule_type(rule, kind), rule_text=F.substring(rule, 1, 500), numbers=scoring.rule_numbers(rule),
        formula=_formula(rule, kind), proofs=scoring.proofs(rule), snippet=F.substring(F.array_join("filled", " | "), 1, 200), confidence=F.lit(CONFIDENCE["classic"]),
    )
    return items.unionByName(formulas), declared.drop("row")


def grid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FX-9, AG-10: items of grid tables and the totals of their parents."""
    at = lambda k: F.get("cells", F.lit(k))
    read = rows.filter("row > 0").select("doc_id", "table_id", "place", "lot", "category", "row", at(1).alias("parent"), at(2).alias("name"), at(3).alias("content"))
    tables = read.select("doc_id", "table_id", "place", "lot").distinct()
    groups = scores.grid_groups(read.select("doc_id", "table_id", "category", "row", "parent", "name", "content")).join(tables, ["doc_id", "table_id"]).withColumnRenamed("first_row", "row")
    rule, kind = F.col("rule_text"), F.col("category")
    marks = F.map_filter(F.create_map(F.lit("group"), "group", F.lit("penalty"), F.when(F.col("penalty"), "true")), lambda k, v: v.isNotNull() & (v != ""))
    items = _items(
        groups, category=kind, name=F.col("name"), max_score=F.col("max_score"), rule_type=F.col("rule_type"), rule_text=rule, numbers=scoring.rule_numbers(rule), extra=marks, formula=_formula(rule, kind), proofs=F.col("proofs"),
        snippet=F.concat_ws(" | ", "group", "name", F.substring(rule, 1, 120)), confidence=F.when(F.col("penalty"), CONFIDENCE["penalty"]).otherwise(CONFIDENCE["grid"]),
    )
    totals = scores.grid_totals(read.select("doc_id", "table_id", "category", "row", "parent", "name", "content")).join(tables, ["doc_id", "table_id"])
    return items, totals.select("doc_id", "table_id", "category", "lot", F.col("declared_total").alias("total"))


def matrix(rows: DataFrame) -> DataFrame:
    """FX-9, SF-23: a price item for each row of a price matrix that has weights."""
    read = rows.withColumn("m", scoring.price_matrix(F.col("cells"), F.col("sub_header"))).filter("m is not null").withColumn("joined", F.array_join(F.filter("cells", lambda c: c != ""), " "))
    number = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\.0$", ""), F.lit(""))
    formula = F.format_string("%s；下浮系数=%s；正向系数=%s；负向系数=%s", F.coalesce(F.nullif("m.formula", F.lit("")), F.lit("价格公式")), number("m.down"), number("m.plus"), number("m.minus"))
    pairs = [("price_weight", "m.weights.price"), ("tech_weight", "m.weights.technical"), ("commercial_weight", "m.weights.commercial"), ("下浮系数", "m.down"), ("正向系数", "m.plus"), ("负向系数", "m.minus")]
    extra = F.map_filter(F.create_map(*(x for k, c in pairs for x in (F.lit(k), F.col(c).cast("string")))), lambda k, v: v.isNotNull())
    return _items(
        read.withColumn("lot", F.col("m.lot")), category=F.lit("price"), name=F.concat(F.lit("投标报价评分（"), F.substring("m.lot", 1, 24), F.lit("）")), max_score=F.col("m.weights.price"), rule_type=F.lit("formula"), rule_text=F.substring("joined", 1, 500),
        numbers=scoring.rule_numbers(F.lit("")), extra=extra, formula=formula, proofs=scoring.proofs(F.lit("")), snippet=F.substring("joined", 1, 200), confidence=F.lit(CONFIDENCE["matrix"]),
    )


def joined_islands(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """WN-11: the rows with tables that continue the one before as one, under the first one's id.

    tables is what `scores.table_islands` reads.
    """
    heads = scores.table_islands(tables).select("doc_id", "table_id", "ord", "island")
    placed = rows.drop("ord").join(heads, ["doc_id", "table_id"], "left")
    order = Window.partitionBy("doc_id", "island").orderBy("ord", "table_id", "row")
    named = placed.withColumn("island", F.coalesce("island", "table_id"))
    return named.withColumn("row", F.row_number().over(order) - 1).drop("table_id", "ord").withColumnRenamed("island", "table_id")


def extract(rows: DataFrame, blocks: DataFrame | None = None, tree: DataFrame | None = None, zones: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """FX-9: the score items of all tables, and the totals that tables declare.

    Items have score_id, numbered within document and category in the tables' order, status and
    evidence place, and ITEM's columns but place; of equal category, name, score and lot the first
    stays (DD-1). Totals have doc_id, table_id, category, lot and total. rows has doc_id, table_id, row (from
    0) and cells.
    """
    placed = placed_tables(table_facts(rows), blocks, tree, zones)
    trimmed = rows.select("doc_id", "table_id", "row", F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))).alias("cells"))
    known = trimmed.join(placed, ["doc_id", "table_id"])
    of = lambda form: known.filter(F.col("form") == form)
    (one, told), (two, summed) = classic(of("classic")), grid(of("grid"))
    every = one.unionByName(two).unionByName(matrix(of("matrix")))
    letter = F.create_map(*(F.lit(x) for kv in PREFIXES.items() for x in kv))[F.col("category")]
    order = Window.partitionBy("doc_id", "category").orderBy("place", "row")
    named = every.withColumn("score_id", F.format_string("%s-%03d", letter, F.row_number().over(order))).withColumn("status", F.lit("pending_review"))
    first = named.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "category", "name", "max_score", "lot").orderBy("place", "row"))).filter("_n = 1")
    return first.drop("_n", "place"), told.unionByName(summed)


def checks(items: DataFrame, totals: DataFrame) -> DataFrame:
    """AG-1, AG-2: declared totals of each document, category and lot against the items' sums."""
    declared = totals.groupBy("doc_id", "category", "lot").agg(F.round(F.sum("total"), 2).alias("declared_total"))
    active = ~F.coalesce(F.col("extra")["penalty"] == "true", F.lit(False))
    return scores.sum_check(declared, scores.computed_totals(items, ["doc_id", "category", "lot"], "max_score", active), ["doc_id", "category", "lot"])
