"""File intake: hashes, routes, text layers, archives and pages of stored reports."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_CHARS = 30
IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp")
MOST_PER_PAGE = 200


def scan(spark: SparkSession, path: str, pattern: str = "*.{docx,pdf,xlsx,doc,zip}") -> DataFrame:
    """SRC-6: files below a folder, each path once; the content is read only where it is used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def allowed_path(path: str, folders: list[str]) -> str:
    """SRC-19: the resolved path of a local file below one of the folders, else an error.

    Paths of other stores have a scheme and are left to their own permissions.
    """
    if "://" in path and not path.startswith("file://"):
        return path
    real = os.path.realpath(path.removeprefix("file://"))
    if not any(os.path.commonpath([real, os.path.realpath(f)]) == os.path.realpath(f) for f in folders):
        raise PermissionError(f"{path} is in none of the allowed folders")
    return real


def combined_id(hashes: Column) -> Column:
    """AG-14: a document's id from the hashes of its files."""
    return F.substring(F.sha2(F.array_join(hashes, "|"), 256), 1, 12)


def route(ext: Column, head: Column | None = None) -> Column:
    """SRC-2, UX-4: the parser for a file by its first bytes, then its extension."""
    by_name = F.when(ext.isin("html", "htm"), "html").when(ext == "pdf", "pdf_text").when(ext == "docx", "docx").when(ext == "xlsx", "xlsx").when(ext == "doc", "doc").when(ext.isin(*IMAGES), "pdf_scan").otherwise("unsupported")
    if head is None:
        return by_name
    return F.when((ext == "docx") & (F.substring(head, 1, 4) == F.unhex(F.lit("D0CF11E0"))), "doc").otherwise(by_name)


def intake(found: DataFrame) -> DataFrame:
    """SRC-1, SRC-4: one row per distinct content: doc_id, path, sha256, route and length."""
    from ..functions.text import extension, file_name

    rows = found.select("path", "length", F.sha2("content", 256).alias("sha256"), route(extension(F.col("path")), F.substring("content", 1, 4)).alias("route"))
    first = rows.groupBy("sha256").agg(F.min(F.struct("path", "route", "length")).alias("f"))
    return first.select(combined_id(F.array("sha256")).alias("doc_id"), "sha256", "f.*", file_name(F.col("f.path")).alias("file_name"))


def recent(spark: SparkSession, path: str, schema: str, pattern: str = "*.json", most: int = 100) -> DataFrame:
    """SRC-16, TK-9: the newest stored JSON files, `most` of them, as path, modified and the schema's
    fields; files that are no such JSON are passed over."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    text = F.col("content").cast("string")
    said = F.from_json(F.when(F.try_parse_json(text).isNotNull(), text), schema)
    read = found.select("path", F.col("modificationTime").alias("modified"), said.alias("r")).filter("r is not null")
    return read.orderBy(F.desc("modified"), "path").limit(most).select("path", "modified", "r.*")


def text_layer(pages: DataFrame, threshold: int = MIN_CHARS) -> DataFrame:
    """SRC-3: whether a document's pages have text: the mean length of those that have any."""
    n = F.length(F.coalesce("text", F.lit("")))
    listed = lambda ok: F.array_sort(F.collect_list(F.when(ok, F.col("page_no"))))
    out = pages.groupBy("doc_id").agg(F.coalesce(F.avg(F.when(n > 0, n)), F.lit(0.0)).alias("avg_chars"), listed(n == 0).alias("empty_pages"), listed((n > 0) & (n < threshold)).alias("low_text_pages"))
    return out.withColumn("has_text_layer", F.col("avg_chars") >= threshold)


def page(rows: DataFrame, order: list[str], page: int = 1, size: int = 50) -> DataFrame:
    """TK-6: one page of rows, with the number of all; page from 1, size from 1 to 200."""
    page, size = max(1, page), min(max(1, size), MOST_PER_PAGE)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset((page - 1) * size).limit(size).join(F.broadcast(total))
