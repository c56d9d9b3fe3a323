"""Evidence: registry, context, provenance and page anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import quotes
from .intervals import holders

SNIPPET = 200


def register(rows: DataFrame, order: list[str]) -> DataFrame:
    """DM-3, TK-7: evidence ids in order within a document, snippets cut."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    return rows.withColumn("evidence_id", F.format_string("e-%s-%05d", F.col("doc_id").cast("string"), n)).withColumn("snippet", F.substring("snippet", 1, SNIPPET))


def row_context(rows: DataFrame, key: str, by: str, shown: str, reach: int = 3) -> DataFrame:
    """WN-12: each row with the rows around it, joined, and its place among them."""
    w = Window.partitionBy(key).orderBy(by).rowsBetween(-reach, reach)
    before = Window.partitionBy(key).orderBy(by).rowsBetween(-reach, -1)
    return rows.withColumn("context", F.array_join(F.collect_list(shown).over(w), "|")).withColumn("at", F.count(F.lit(1)).over(before))


def value_cell(cells: DataFrame, hits: DataFrame) -> DataFrame:
    """WN-17: the first filled cell at or after the hit row, then before it, in row order."""
    near = cells.join(hits, ["doc_id", "table_id"]).filter(F.trim("text") != "")
    return near.groupBy("doc_id", "table_id", "hit_row").agg(F.min_by(F.struct("row", "col", "text"), F.struct(F.col("row") < F.col("hit_row"), "row", "col")).alias("c")).select("doc_id", "table_id", "hit_row", "c.*")


def with_sources(evidence: DataFrame, blocks: DataFrame, tables: DataFrame, prefix: int = 15) -> DataFrame:
    """JN-10: source files by block id, else by table id, else the document's first file whose
    text has the beginning of the snippet.

    blocks has doc_id, block_id and source_file, and for the third step ord and text; evidence
    then has a snippet.
    """
    by_block = blocks.select("doc_id", "block_id", F.col("source_file").alias("_b"))
    by_table = tables.select("doc_id", "table_id", F.col("source_file").alias("_t"))
    joined = evidence.join(by_block, ["doc_id", "block_id"], "left").join(by_table, ["doc_id", "table_id"], "left")
    named = joined.withColumn("source_file", F.coalesce("_b", "_t")).drop("_b", "_t")
    if not {"ord", "text"} <= set(blocks.columns):
        return named
    said = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    files = blocks.filter("source_file is not null and text <> ''").groupBy("doc_id", "source_file").agg(F.min("ord").alias("_ord"), F.array_join(said, "\n").alias("_text")).withColumnRenamed("source_file", "_file")
    begin = F.substring(F.coalesce("snippet", F.lit("")), 1, prefix)
    open_rows = named.filter("source_file is null").drop("source_file")
    met = open_rows.select("doc_id", begin.alias("_begin")).filter("_begin <> ''").distinct().join(files, "doc_id").filter(F.contains("_text", F.col("_begin")))
    first = met.groupBy("doc_id", "_begin").agg(F.min_by("_file", "_ord").alias("source_file"))
    found = open_rows.withColumn("_begin", begin).join(first, ["doc_id", "_begin"], "left").drop("_begin")
    return named.filter("source_file is not null").unionByName(found)


def first_pages(probes: DataFrame, pages: DataFrame, width: int = 24, least: int = 6) -> DataFrame:
    """JN-11: the first page of a document whose text has a probe's beginning, white space aside.

    probes has block_id and text, and doc_id if they are to be found in their own documents only;
    pages has doc_id, page_no and text.
    """
    keys = [c for c in ("doc_id", "block_id") if c in probes.columns]
    cut = F.substring(text.dense(F.col("text")), 1, width)
    asked = probes.select(*keys, F.xxhash64(*keys).alias("id"), cut.alias("said")).filter(F.length("said") >= least)
    paged = pages.select("doc_id", "page_no", F.xxhash64("doc_id", "page_no").alias("id"), F.col("text").alias("said"))
    met = quotes.held(paged, asked).join(paged.select("doc_id", "page_no", F.col("id").alias("text_id")), "text_id")
    return met.join(asked.select(F.col("id").alias("quote_id"), *keys), [*keys[:-1], "quote_id"]).groupBy("doc_id", "block_id").agg(F.min("page_no").alias("page_no"))


def to_main(evidence: DataFrame, spans: DataFrame) -> DataFrame:
    """JN-22: offsets of a part moved to the main text; rows outside all parts are left out.

    spans has doc_id, start, end and main_start; the parts of a document do not overlap.
    """
    placed = holders(evidence, spans, ["start", "main_start"], at="char_start", start="start", end="end")
    moved = F.col("char_start") - F.col("holder.start") + F.col("holder.main_start")
    return placed.filter("holder is not null").withColumn("main_char_start", moved).drop("holder")
