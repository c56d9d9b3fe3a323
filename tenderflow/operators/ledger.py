"""Processing ledgers: state of keys from events, summaries and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def state(events: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """DM-1: the last status and the last given reason of each key; a registration does not
    overwrite a status that was set."""
    told = F.col("status") != "PENDING"
    status = F.coalesce(F.max_by(F.when(told, F.col("status")), F.when(told, F.col(seq))), F.lit("PENDING"))
    reason = F.max_by("reason", F.when(F.col("reason").isNotNull(), F.col(seq)))
    return events.groupBy(*keys).agg(status.alias("status"), reason.alias("reason"))


def summary(ledger: DataFrame, *keys: str) -> DataFrame:
    """AG-5, AG-6: counts by status and the gate: nothing pending; true for an empty ledger."""
    count = lambda s: F.count_if(F.col("status") == s)
    return ledger.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), count("DONE").alias("done"), count("EXCLUDED_WITH_REASON").alias("excluded"), count("FAILED_REVIEW").alias("failed"), count("PENDING").alias("pending"),
        F.coalesce(F.bool_and(F.col("status") != "PENDING"), F.lit(True)).alias("gate"),
    )


def pages_failed(documents: DataFrame) -> DataFrame:
    """SRC-13: a failed entry for each page of documents that nothing could read."""
    return documents.select("doc_id", F.explode(F.sequence(F.lit(1), "n_pages")).alias("page")).select("doc_id", F.concat(F.lit("page:"), "page").alias("key"), F.lit("page").alias("kind"), F.lit("FAILED_REVIEW").alias("status"), F.lit("no OCR backend").alias("reason"))


def quality_warnings(documents: DataFrame) -> DataFrame:
    """DM-6: a warning for each document whose route loses quality; others give no row."""
    note = F.when(F.col("route") == "pdf_scan", "scanned: pages without an OCR backend fail").when(F.col("route") == "doc", "old word file: convert to docx first")
    return documents.select("doc_id", "route", note.alias("warning")).filter("warning is not null")


def font_levels(spans: DataFrame) -> DataFrame:
    """SRC-8, AG-9: heading levels of text blocks from font sizes.

    The body size is the one most characters have; sizes more than 12 % larger are ranked from
    the largest; only texts of at most 60 characters are headings. spans has doc_id, ord, size, text.
    """
    by_size = spans.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("n"))
    body = by_size.groupBy("doc_id").agg(F.max_by("size", F.struct("n", "size")).alias("body"))
    larger = by_size.join(body, "doc_id").filter(F.col("size") > 1.12 * F.col("body"))
    ranked = larger.withColumn("level", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size")))).select("doc_id", "size", "level")
    return spans.join(ranked, ["doc_id", "size"], "left").withColumn("level", F.when(F.length("text") <= 60, F.coalesce("level", F.lit(0))).otherwise(0))
