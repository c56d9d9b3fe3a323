"""Content lists of an OCR service as blocks and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_rows

ITEM = "array<struct<type:string,text:string,text_level:int,page_idx:int,table_body:string>>"


def blocks(lists: DataFrame) -> DataFrame:
    """SRC-11: blocks of rows of doc_id and json; pages count from 1, titles are level 1."""
    items = lists.select("doc_id", F.posexplode(F.from_json("json", ITEM)).alias("ord", "i"))
    level = F.when((F.col("i.type") == "title") | (F.col("i.text_level") > 0), F.coalesce("i.text_level", F.lit(1))).otherwise(0)
    kind = F.when(level > 0, "heading").when(F.col("i.type") == "table", "table").otherwise("paragraph")
    return items.select("doc_id", "ord", kind.alias("type"), F.coalesce("i.text", F.lit("")).alias("text"), level.alias("level"), (F.coalesce("i.page_idx", F.lit(0)) + 1).alias("page_no"), "i.table_body")


def cells(found: DataFrame) -> DataFrame:
    """Cells of the tables among the blocks."""
    rows = found.filter("type = 'table'").select("doc_id", "ord", F.posexplode(html_rows(F.coalesce("table_body", F.lit("")))).alias("row", "cells"))
    return rows.select("doc_id", F.format_string("t-%04d", "ord").alias("table_id"), "row", F.posexplode("cells").alias("col", "text"))


def latest_gold(rows: DataFrame) -> DataFrame:
    """SRC-17: the last value of each document and field; rows has doc_id, field_key, value, ord."""
    return rows.groupBy("doc_id", "field_key").agg(F.max_by("value", "ord").alias("value"))


def files_of_parts(parts: DataFrame) -> DataFrame:
    """SRC-18: bytes of base64 parts of an allowed kind."""
    allowed = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1)).isin("docx", "pdf", "xlsx", "doc", "zip")
    return parts.filter(allowed).withColumn("content", F.try_to_binary("data", F.lit("base64"))).filter("content is not null").drop("data")
