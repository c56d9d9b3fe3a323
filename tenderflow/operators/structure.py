"""Section trees, zones and interval joins over a document's blocks.

Levels are few, so a block's end and parent come from running windows, one aggregate a level,
instead of a self-join of a document's headings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import holders, pairs

LEVELS = range(1, 10)
ZONE_WINDOW = 150

# Words that open a zone, first ones first.
ZONE_WORDS = {
    "notice": ("招标公告", "投标邀请", "招标邀请书"),
    "instructions": ("投标人须知前附表", "投标人须知"),
    "instructions_front": ("投标人须知前附表", "前附表"),
    "evaluation_method": ("评标办法前附表", "评标办法", "评审办法", "评标程序"),
    "scoring": ("评分细则", "评分标准", "评分表", "评分办法", "技术评分", "商务评分", "分值表"),
    "qualification": ("资格审查", "资格要求", "投标人资格", "资格条件"),
    "tech_requirements": ("技术要求", "技术标准", "技术规范"),
    "contract": ("合同条款", "合同主要条款"),
    "format": ("投标文件格式", "格式要求"),
}


def _of_own_level(made):
    out = F
    for level in LEVELS:
        out = out.when(F.col("level") == level, made(level))
    return out


def heading_ends(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds next_same: the next heading of the block's level or higher, null without one."""
    later = Window.partitionBy(key).orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("next_same", _of_own_level(lambda n: F.min(F.when(F.col("level").between(1, n), F.col("ord"))).over(later)))


def sections(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """WN-4: key, ord, level, title, block_start, block_end, parent of each heading.

    blocks has ord (from 0), level (0 for no heading) and text. A section ends at the next heading
    of its level or higher; its parent is the last heading before it of a smaller level.
    """
    n = F.max("ord").over(Window.partitionBy(key)) + 1
    heads = heading_ends(blocks.withColumn("n_blocks", n).filter("level > 0"), key)
    earlier = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    parent = _of_own_level(lambda k: F.max(F.when(F.col("level") < k, F.col("ord"))).over(earlier))
    return heads.select(key, "ord", "level", F.col("text").alias("title"), F.col("ord").alias("block_start"), F.coalesce("next_same", "n_blocks").alias("block_end"), parent.alias("parent"))


def section_paths(tree: DataFrame, depth: int = 9, key: str = "doc_id") -> DataFrame:
    """WN-5, WN-6: depth and path `a > b > c` of each section down to a depth.

    An ancestor of level k is the last heading of that level before the section, if no heading of
    a smaller level came after it: one running window of a maximum a level, no joins.
    """
    earlier = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    seen = tree.select(key, "ord", "level", "title", *(F.max(F.when(F.col("level") == k, F.struct("ord", "title"))).over(earlier).alias(f"last_{k}") for k in LEVELS))
    at = lambda k: F.coalesce(F.col(f"last_{k}.ord"), F.lit(-1))
    above, newest = [], F.lit(-1)
    for k in LEVELS:
        above.append(F.when((F.col("level") > k) & (at(k) > newest), F.col(f"last_{k}.title")))
        newest = F.greatest(newest, at(k))
    placed = seen.withColumn("above", F.array_compact(F.array(*above)))
    made = placed.select(key, "ord", F.concat_ws(" > ", "above", "title").alias("path"), (F.size("above") + 1).alias("depth"))
    return made.filter(F.col("depth") <= depth)


def zones(blocks: DataFrame, words: dict = ZONE_WORDS, key: str = "doc_id", window: int = ZONE_WINDOW) -> DataFrame:
    """JN-4, WN-3: the zones of each document.

    The first word in a zone's order that occurs wins; for a word, section titles come before
    other blocks and earlier blocks before later ones. A zone from a title is its section; from a
    block it ends at the next heading of level 2 or the block's own, or after `window` blocks.
    """
    n = F.max("ord").over(Window.partitionBy(key)) + 1
    later = Window.partitionBy(key).orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    ends = heading_ends(blocks.withColumn("n_blocks", n), key).withColumn("next_two", F.min(F.when(F.col("level").between(1, 2), F.col("ord"))).over(later))
    is_title = F.col("level") > 0
    window_end = F.least(F.col("ord") + window, F.col("n_blocks"))
    end = F.when(is_title, F.coalesce("next_same", "n_blocks")).otherwise(F.coalesce("next_two", window_end))
    entries = [F.struct(F.lit(z).alias("zone"), F.lit(k).alias("prio"), F.lit(w).alias("word")) for z, ws in words.items() for k, w in enumerate(ws)]
    any_word = "|".join(dict.fromkeys(w for ws in words.values() for w in ws))
    hits = (
        ends.filter(F.rlike("text", F.lit(any_word)))
        .select(key, "ord", "text", is_title.alias("is_title"), F.greatest(end, F.col("ord") + 1).alias("block_end"), F.explode(F.array(*entries)).alias("e"))
        .filter(F.contains("text", F.col("e.word")))
    )
    first = F.min_by(F.struct(F.col("ord").alias("block_start"), "block_end", F.substring("text", 1, 40).alias("title")), F.struct("e.prio", ~F.col("is_title"), "ord"))
    return hits.groupBy(key, F.col("e.zone").alias("zone")).agg(first.alias("z")).select(key, "zone", "z.*")


def within(blocks: DataFrame, intervals: DataFrame, key: str = "doc_id") -> DataFrame:
    """PF-1, JN-2: blocks in half-open intervals of their document; overlaps give a row each."""
    return pairs(blocks, intervals, key)


def within_or_all(blocks: DataFrame, intervals: DataFrame, key: str = "doc_id") -> DataFrame:
    """JN-3: blocks in the intervals, once each; all blocks of a document of which they hold none."""
    marked = pairs(blocks.select(key, "ord"), intervals.select(key, "block_start", "block_end"), key, how="left_semi").distinct().withColumn("_in", F.lit(True))
    joined = blocks.join(marked, [key, "ord"], "left")
    some = F.max("_in").over(Window.partitionBy(key))
    return joined.withColumn("_some", some).filter(F.col("_in") | F.col("_some").isNull()).drop("_in", "_some").select(*blocks.columns)


def deepest_section(items: DataFrame, tree: DataFrame, key: str = "doc_id") -> DataFrame:
    """JN-1: each item (with ord) with title and level of the innermost section around it."""
    held = holders(items, tree, ["title", "level"], key, level=F.col("level"), levels=LEVELS)
    return held.select(*items.columns, "holder.title", "holder.level")


def zone_pages(zones: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """AG-17: zones with their first and last page; page 0 is no page."""
    inside = within(blocks.select(key, "ord", "page_no"), zones, key)
    page = F.when(F.col("page_no") > 0, F.col("page_no"))
    names = [c for c in zones.columns if c != key]
    return inside.groupBy(key, *names).agg(F.min(page).alias("page_start"), F.max(page).alias("page_end"))


def zone_first(tables: DataFrame, zones: DataFrame, key: str = "doc_id") -> DataFrame:
    """TK-10: tables (with ord) numbered from 1: those in a zone first, each group by ord."""
    near = within(tables.select(key, "ord"), zones, key).select(key, "ord").distinct().withColumn("in_zone", F.lit(True))
    marked = tables.join(near, [key, "ord"], "left").withColumn("in_zone", F.coalesce("in_zone", F.lit(False)))
    return marked.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(~F.col("in_zone"), "ord")))
