"""Bid outlines: buckets of titles and names that score items add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbering

FORMAT_TITLE = "投标文件(格式|组成|构成|编制格式)"


def format_subtree(tree: DataFrame) -> DataFrame:
    """SF-45: the sections inside the first section, in reading order, that holds the formats."""
    first = tree.filter(F.rlike(F.regexp_replace("title", r"\s+", ""), F.lit(FORMAT_TITLE))).groupBy("doc_id").agg(F.min_by(F.struct("block_start", "block_end", "level"), "block_start").alias("f"))
    return tree.join(first, "doc_id").filter((F.col("block_start") > F.col("f.block_start")) & (F.col("block_start") < F.col("f.block_end"))).drop("f")


def buckets(titles: DataFrame) -> DataFrame:
    """WN-14, SF-44: the bucket of each title: that of the last numbered root with a hint, or
    the first hint before any. titles has doc_id, ord, title."""
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    split = numbering.split_outline_number(F.col("title"))
    read = titles.filter(~numbering.is_junk_title(F.col("title"))).withColumn("no", split["no"]).withColumn("name", split["name"])
    hinted = read.withColumn("hint", numbering.bucket_hint(F.col("name"))).withColumn("first_hint", F.min(F.when(F.col("hint").isNotNull(), F.col("ord"))).over(before))
    switch = F.col("hint").isNotNull() & (F.rlike("title", F.lit("^[一二三四五六七八九十]+、")) | (F.col("ord") == F.col("first_hint")))
    return hinted.withColumn("bucket", F.coalesce(F.last(F.when(switch, F.col("hint")), ignorenulls=True).over(before), F.lit("others"))).drop("hint", "first_hint")


def supplement(outline: DataFrame, scores: DataFrame) -> DataFrame:
    """JN-14: names of score items that the outline of their bucket does not cover, in order.

    A name added covers later ones, so names are folded in order per document and bucket.
    outline has doc_id, bucket, joined; scores doc_id, bucket, ord, name.
    """
    token = F.regexp_replace("name", r"[（(].*?[)）]|[0-9０-９分值\.．\s]", "")
    listed = scores.withColumn("token", token).groupBy("doc_id", "bucket").agg(F.sort_array(F.collect_list(F.struct("ord", "name", "token"))).alias("names"))
    start = F.struct(F.coalesce("joined", F.lit("")).alias("text"), F.array().cast("array<string>").alias("added"))

    def step(acc, s):
        covered = (s["token"] != "") & F.contains(acc["text"], s["token"])
        return F.when(covered, acc).otherwise(F.struct(F.concat(acc["text"], s["name"]).alias("text"), F.array_append(acc["added"], s["name"]).alias("added")))

    return listed.join(outline, ["doc_id", "bucket"], "left").select("doc_id", "bucket", F.aggregate("names", start, step, lambda a: a["added"]).alias("added"))


def reusable(cached_lot: Column, asked_lot: Column, n_lots: Column, single_lot: Column) -> Column:
    """DM-8: whether a stored outline serves the lot that is asked for: no lot asked, the same
    lot, or a report that has one lot only and fits; else the view is unavailable."""
    cached, asked, single = (F.coalesce(c, F.lit("")) for c in (cached_lot, asked_lot, single_lot))
    return F.when(asked == "", True).when(cached != "", cached == asked).otherwise((n_lots <= 1) & ((single == "") | (single == asked) | F.contains(asked, single)))


def bid_outline(tree: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AP-3: titles of the format chapter by bucket, and the names that score items add.

    scores has doc_id, bucket, ord, name.
    """
    placed = buckets(format_subtree(tree).select("doc_id", "ord", "title"))
    joined = placed.groupBy("doc_id", "bucket").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), "").alias("joined"))
    return placed, supplement(joined, scores)
