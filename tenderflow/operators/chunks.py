"""Small-to-big chunks: paragraphs packed in order into children of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import structure

CHILD_CHARS = 480
PARENT_CHARS = 4400


def packed(rows: DataFrame, keys: list[str], order: str, said: str, budget: int, newline: int) -> DataFrame:
    """Texts of each key in chunks: chunk (from 0), n, first, last (of `order`) and text.

    A text joins the open chunk while their size, with `newline` for each break, stays within the
    budget. Each text's chunk follows from the sizes alone: a fold that emits what it closes and
    holds the open chunk only, so it is linear in the number of texts.
    """
    n = F.length(said)
    sizes = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), n.alias("n")))).alias("all"))

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for texts in batch["all"].to_pylist():
                size, heads = None, []
                for t in texts:
                    fits = size is not None and size + newline + t["n"] <= budget
                    if not fits:
                        heads.append(t["at"])
                    size = size + newline + t["n"] if fits else t["n"]
                made.append(heads)
            heads = pa.array(made, pa.list_(batch.schema.field("all").type.value_type.field("at").type))
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), heads], [*keys, "heads"])

    kinds = [f"{k} {sizes.schema[k].dataType.simpleString()}" for k in keys]
    at_type = rows.schema[order].dataType.simpleString()
    heads = sizes.mapInArrow(starts, ", ".join([*kinds, f"heads array<{at_type}>"])).select(*keys, F.posexplode("heads").alias("chunk", order), F.lit(True).alias("head"))
    place = Window.partitionBy(*keys).orderBy(order)
    marked = rows.join(heads, [*keys, order], "left").withColumn("chunk", F.last("chunk", ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, said))), lambda x: x[said]), "\n")
    return marked.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.max(order).alias("last"), joined.alias("text"))


def pack_lines(docs: DataFrame, budget: int = CHILD_CHARS) -> DataFrame:
    """Chunks of whole texts: doc_id, chunk_no, n_lines and text.

    Blank lines are skipped. A line joins the chunk while their text with the newline between
    stays within the budget; a longer line is a chunk of its own.
    """
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line")).filter(F.trim("line") != "")
    return packed(lines, ["doc_id"], "at", "line", budget, 1).select("doc_id", F.col("chunk").alias("chunk_no"), F.col("n").alias("n_lines"), "text")


def section_chunks(blocks: DataFrame, tree: DataFrame, budget: int = CHILD_CHARS, parent: int = PARENT_CHARS) -> DataFrame:
    """WN-7, WN-2: for each section a parent, child -1, with its text cut to `parent` characters,
    and children of at most `budget` characters of blocks; nested sections repeat their text.

    blocks has doc_id, ord and text, tree what `structure.sections` returns. Gives doc_id, section,
    child, text, first_ord, last_ord, chunk_id and parent_id.
    """
    spans = tree.select("doc_id", F.col("ord").alias("section"), "block_start", "block_end")
    inside = structure.within(blocks.filter("text <> ''").select("doc_id", "ord", "text"), spans).select("doc_id", "section", "ord", "text")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    parents = inside.groupBy("doc_id", "section").agg(F.lit(-1).alias("child"), F.substring(whole, 1, parent).alias("text"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))
    children = packed(inside, ["doc_id", "section"], "ord", "text", budget, 0).select("doc_id", "section", F.col("chunk").alias("child"), "text", F.col("first").alias("first_ord"), F.col("last").alias("last_ord"))
    number = F.format_string("c-%05d", F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "child")))
    numbered = parents.unionByName(children).withColumn("chunk_id", number)
    above = F.first("chunk_id").over(Window.partitionBy("doc_id", "section").orderBy("child"))
    return numbered.withColumn("parent_id", F.when(F.col("child") >= 0, above))


def block_windows(blocks: DataFrame, width: int = 2 * CHILD_CHARS) -> DataFrame:
    """WN-7: chunks of documents without sections: windows of `width` blocks."""
    n = F.floor(F.col("ord") / width).cast("int").alias("chunk_no")
    said = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    return blocks.groupBy("doc_id", n).agg(F.array_join(said, "\n").alias("text"), F.count(F.lit(1)).alias("n_blocks"))


def pages_of(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """AG-12: sorted distinct pages of the blocks in each chunk's [block_start, block_end)."""
    inside = structure.within(blocks.select("doc_id", "ord", "page_no"), chunks.select("doc_id", "chunk_no", "block_start", "block_end"))
    return inside.groupBy("doc_id", "chunk_no").agg(F.array_sort(F.collect_set("page_no")).alias("page_nos"))
