"""Score tables: rows to items, grid groups, cross-page tables, dedup and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lots, scoring


def classic_rows(rows: DataFrame) -> DataFrame:
    """FX-9, WN-8: items of score tables with category rows between.

    rows has doc_id, table_id, row, cells; row 0 is the header. A short cell with a category word
    declares the category of the rows below; a row of at most two filled cells declares only.
    """
    text = F.col("text")
    said = rows.withColumn("text", F.array_join("cells", ""))  # tells of most rows at once that they declare nothing
    declares = scoring.category(text).isNotNull()
    declared = F.get(F.array_compact(F.transform("cells", lambda c: F.when((c != "") & (F.length(F.trim(c)) <= 14), scoring.category(c)))), F.lit(0))
    n_filled = F.size(F.filter("cells", lambda c: F.trim(c) != ""))
    strict = F.when(F.contains(text, F.lit("分")), scoring.strict_score(F.col("cells")))
    read = said.select("doc_id", "table_id", "row", "cells", "text", F.when(declares, declared).alias("declared"), F.when(declares, n_filled).alias("n_filled"), strict.alias("strict"))
    only = (F.trim(text) == "") | (F.col("declared").isNotNull() & (F.col("n_filled") <= 2))
    item = (F.col("row") > 0) & ~only
    # what is sorted: of the cells only the name, the rule and those that may be the score, of the header those over scores
    plain = F.when(item & F.col("strict").isNull(), F.transform("cells", lambda c: F.when(scoring.is_number(F.trim(c)), F.trim(c))))
    over = F.when(F.col("row") == 0, F.transform("cells", lambda c: F.when(scoring.is_score_header(c), c)))
    name, rule = F.when(item, F.trim(F.get("cells", F.lit(1)))), F.when(item, F.substring(F.get("cells", F.size("cells") - 1), 1, 500))
    narrow = read.select("doc_id", "table_id", "row", "declared", item.alias("item"), "strict", plain.alias("plain"), over.alias("over"), name.alias("name"), rule.alias("rule_text"))
    before = Window.partitionBy("doc_id", "table_id").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    seen = narrow.select("*", *(F.last(c, ignorenulls=True).over(before).alias(a) for c, a in (("declared", "category"), ("over", "header"))))
    score = F.coalesce("strict", scoring.score_cell(F.col("plain"), F.col("header"))["score"])
    items = seen.filter("item").withColumn("max_score", score).filter("max_score is not null")
    return items.select("doc_id", "table_id", "row", F.coalesce("category", F.lit("technical")).alias("category"), "name", "max_score", "rule_text")


def declared_totals(rows: DataFrame) -> DataFrame:
    """Totals that category rows declare, the first of each category."""
    filled = F.filter(F.transform("cells", lambda c: F.trim(c)), lambda c: c != "")
    short = rows.select("doc_id", "row", F.explode(F.array(filled)).alias("said")).filter(F.size("said") <= 2)
    named = F.filter(F.transform("said", lambda c: F.struct(F.when(F.length(c) <= 14, scoring.category(c)).alias("category"), c.alias("cell"))), lambda x: x["category"].isNotNull())
    total = scoring.found(F.col("c.cell"), r"[（(]?\s*(\d{1,3})\s*分\s*[）)]?").try_cast("double")
    read = short.select("doc_id", "row", F.explode(F.array(F.get(named, F.lit(0)))).alias("c")).filter("c is not null").select("doc_id", "row", "c.category", total.alias("total")).filter("total is not null")
    return read.groupBy("doc_id", "category").agg(F.min_by("total", "row").alias("declared_total"))


def grid_rows(rows: DataFrame) -> DataFrame:
    """WN-9: grid rows with something in them, the name filled down, and their scores."""
    said = lambda c: F.trim(F.coalesce(c, F.lit("")))
    before = Window.partitionBy("doc_id", "table_id").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.select(*(c for c in rows.columns if c not in ("parent", "name", "content")), *(said(c).alias(c) for c in ("parent", "name", "content"))).filter("parent <> '' or name <> '' or content <> ''")
    name = F.coalesce(F.last(F.nullif("name", F.lit("")), ignorenulls=True).over(before), F.lit(""))
    return kept.withColumn("name", name).withColumn("s", scoring.paren_score(F.col("name"), F.col("parent"), F.col("content")))


def grid_groups(rows: DataFrame) -> DataFrame:
    """AG-10, FX-9: items of grid tables: rows of equal parent and name.

    rows has doc_id, table_id, row, parent, name, content and category. The score is the first
    row's, else the first in the rule; items without a positive one go. Names and groups lose
    their score marks.
    """
    rule = F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("content") != "", F.struct("row", "content")))), lambda t: t["content"]), " / "), 1, 800)
    keys = ["doc_id", "table_id", "category", "parent", "name"]
    groups = grid_rows(rows).groupBy(*keys).agg(F.min("row").alias("first_row"), F.min_by("s.score", "row").alias("score"), rule.alias("rule"), F.bool_or("s.penalty").alias("penalty"))
    in_rule = scoring.found(F.substring("rule", 1, 60), scoring.SCORE_IN_TEXT).try_cast("double")
    bare = lambda c: F.regexp_replace(c, scoring.SCORE_MARK, "")
    scored = groups.withColumn("max_score", F.coalesce("score", in_rule)).filter("max_score > 0")
    return scored.select(
        *keys[:3],
        bare(F.col("parent")).alias("group"),
        F.substring(bare(F.col("name")), 1, 40).alias("name"),
        "first_row",
        "max_score",
        "penalty",
        scoring.rule_type(F.col("rule"), F.col("category")).alias("rule_type"),
        F.substring("rule", 1, 500).alias("rule_text"),
        scoring.proofs(F.col("rule")).alias("proofs"),
    )


def grid_totals(rows: DataFrame) -> DataFrame:
    """AG-10: the total that the parents of a grid table declare, each parent once; negative ones
    declare nothing."""
    declared = scoring.found(F.col("parent"), scoring.PAREN_SCORE).try_cast("double")
    parents = grid_rows(rows).select("doc_id", "table_id", "category", "parent", declared.alias("d")).filter("d >= 0").distinct()
    return parents.groupBy("doc_id", "table_id", "category").agg(F.round(F.sum("d"), 2).alias("declared_total"))


def table_islands(tables: DataFrame) -> DataFrame:
    """WN-11: tables that continue the one before: consecutive pages, equal columns, and a blank
    in the last row before or the first row after. Adds island, the head's table_id.

    tables has doc_id, ord, table_id, first_page, last_page, n_cols, first_row_blank, last_row_blank.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    joins = (F.lag("last_page").over(w) == F.col("first_page") - 1) & (F.lag("n_cols").over(w) == F.col("n_cols")) & (F.lag("last_row_blank").over(w) | F.col("first_row_blank"))
    flagged = tables.withColumn("_head", F.when(F.coalesce(joins, F.lit(False)), None).otherwise(F.col("table_id")))
    return flagged.withColumn("island", F.last("_head", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_head")


def lot_hints(blocks: DataFrame) -> DataFrame:
    """WN-10: for each table block the last short paragraph before it without a final colon."""
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    short = (F.col("type") == "paragraph") & F.length(F.trim("text")).between(1, 20) & ~F.rlike(F.trim("text"), F.lit("[：:]$"))
    return blocks.withColumn("lot_hint", F.last(F.when(short, F.trim("text")), ignorenulls=True).over(before)).filter("type = 'table'")


def first_of(rows: DataFrame, keys: list, by: str) -> DataFrame:
    """DD-1 to DD-4: the first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).filter("_n = 1").drop("_n")


def computed_totals(items: DataFrame, keys: list[str], score: str, active: Column | None = None, named: str | None = None) -> DataFrame:
    """AG-1: sum and count of the active items of each key; with `named`, bad_items has the names
    of the active items whose score is not positive."""
    counts = F.lit(True) if active is None else active
    more = [] if named is None else [F.array_sort(F.collect_list(F.when(counts & (F.col(score) <= 0), F.col(named)))).alias("bad_items")]
    return items.groupBy(*keys).agg(F.round(F.sum(F.when(counts, F.col(score))), 2).alias("computed_total"), F.count_if(counts).alias("item_count"), *more)


def sum_check(declared: DataFrame, computed: DataFrame, keys: list[str], tolerance: float = 0.01) -> DataFrame:
    """AG-2, JN-19: passed, failed or unverifiable (ok is null) per declared key; an item without a
    positive score fails its key."""
    both = declared.join(computed, keys, "left")
    gap = F.abs(F.col("declared_total") - F.col("computed_total"))
    bad = F.coalesce(F.size("bad_items") > 0, F.lit(False)) if "bad_items" in computed.columns else F.lit(False)
    state = F.when(bad, "failed").when(F.col("declared_total").isNull() | F.col("computed_total").isNull(), "unverifiable").when(gap <= tolerance, "passed").otherwise("failed")
    return both.withColumn("item_count", F.coalesce("item_count", F.lit(0).cast("long"))).withColumn("state", state).withColumn("ok", F.when(state != "unverifiable", state == "passed"))


def weight_check(items: DataFrame, key: str) -> DataFrame:
    """AG-3: whether weights sum to 100 and ids are unique, per key."""
    total = F.sum("technical") + F.sum("commercial") + F.sum("price")
    return items.groupBy(key).agg((F.abs(total - 100) <= 0.01).alias("sums_to_100"), (F.count("item_id") == F.count_distinct("item_id")).alias("ids_unique"))


def selected(items: DataFrame, category: str | None = None, lot: str | None = None) -> DataFrame:
    """PF-19: items of a category, and of a lot or of what may apply to it."""
    out = items if category is None else items.filter(F.col("category") == category)
    return out if lot is None else out.filter(lots.applies(F.col("lot"), F.lit(lot)) != "other")
