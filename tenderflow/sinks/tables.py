"""Stage tables, gold rows and the nine frames of a summary workbook."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lots, numerals


def write_gold(gold: DataFrame, path: str) -> None:
    """SNK-3: a JSON line per document."""
    gold.write.mode("overwrite").json(path)


def lot_sheet(values: DataFrame, targets: DataFrame, columns: list[str]) -> DataFrame:
    """SNK-2, TK-5, AP-4: a row per lot, fields as columns, the target first, limits in 万."""
    wide = values.groupBy("doc_id", "lot").pivot("field_key", columns).agg(F.first("value"))
    money = [c for c in columns if c.endswith("price_limit")]
    shown = wide.withColumns({c: numerals.to_ten_thousands(F.col(c)) for c in money})
    return shown.join(targets, "doc_id", "left").withColumn("is_target", F.coalesce(lots.same_lot(F.col("lot"), F.col("target_lot")), F.lit(False))).orderBy("doc_id", ~F.col("is_target"), lots.lot_order(F.col("lot")))


def workbook(fields: DataFrame, lot_values: DataFrame, targets: DataFrame, requirements: DataFrame, outline: DataFrame, rejections: DataFrame, scores: DataFrame, lot_columns: list[str]) -> dict[str, DataFrame]:
    """SNK-2, AG-15: the sheets as frames; values that are missing say so."""
    grouped = requirements.groupBy("doc_id", "type").agg(F.array_join(F.sort_array(F.collect_list("constraint")), "\n").alias("text"))
    sheet = lambda category: scores.filter(F.col("category") == category)
    found = F.coalesce("value_normalized", F.lit("未提供"))
    return {
        "cover": fields.groupBy("doc_id").agg(F.count_if(F.col("status") == "found").alias("n_found"), F.count(F.lit(1)).alias("n_fields")),
        "basics": fields.withColumn("shown", found),
        "lots": lot_sheet(lot_values, targets, lot_columns),
        "qualifications": grouped,
        "outline": outline,
        "rejections": rejections,
        "commercial": sheet("commercial"),
        "technical": sheet("technical"),
        "price": sheet("price"),
    }
