"""Ordered text blocks: offsets, ids, full texts and the union of a document's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_order(*keys: str, by: str = "ord"):
    return Window.partitionBy(*keys).orderBy(by)


def char_offsets(blocks: DataFrame, key: str = "doc_id", by: str = "ord") -> DataFrame:
    """WN-1: char_start and char_end of each block in the text of newline-joined blocks."""
    before = in_order(key, by=by).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.coalesce("text", F.lit("")))
    start = F.coalesce(F.sum(size + 1).over(before), F.lit(0)).cast("long")
    return blocks.withColumn("char_start", start).withColumn("char_end", start + size)


def full_texts(blocks: DataFrame, key: str = "doc_id", by: str = "ord") -> DataFrame:
    """AG-13: key and full_text, the blocks in order with newlines between."""
    said = F.struct(F.col(by).alias("o"), F.coalesce("text", F.lit("")).alias("t"))
    return blocks.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(said)), lambda b: b["t"]), "\n").alias("full_text"))


def numbered(rows: DataFrame, name: str, form: str, keys: list[str], by: list[str]) -> DataFrame:
    """WN-2: sequence ids such as b-00001 within keys."""
    return rows.withColumn(name, F.format_string(form, F.row_number().over(Window.partitionBy(*keys).orderBy(*by))))


def merge_files(blocks: DataFrame, key: str = "doc_id", file: str = "file_no", by: str = "ord") -> DataFrame:
    """SO-2, DM-7: one sequence of blocks per document from its files, a marker block before each
    file, ids and offsets anew. Files without blocks have a marker only."""
    marker = blocks.select(key, file, "source_file").distinct().select(key, file, F.lit(-1).alias(by), "source_file", F.lit("marker").alias("type"), F.col("source_file").alias("text"))
    both = blocks.select(key, file, F.col(by).cast("int").alias(by), "source_file", F.lit("paragraph").alias("type"), "text").unionByName(marker)
    place = (F.row_number().over(Window.partitionBy(key).orderBy(file, by)) - 1).alias("ord")
    return char_offsets(both.select(key, file, place, "source_file", "type", "text"), key)


def file_ranges(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """WN-15: [block_start, block_end) of each file from its marker block."""
    n = F.max("ord").over(Window.partitionBy(key)) + 1
    marked = blocks.withColumn("n_blocks", n).filter("type = 'marker'")
    return marked.select(key, "source_file", F.col("ord").alias("block_start"), F.coalesce(F.lead("ord").over(in_order(key)), "n_blocks").alias("block_end"))
