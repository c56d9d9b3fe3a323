"""Review queues, decisions, gold rows and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import containment

THRESHOLD = 0.7
MOST_CANDIDATES = 6


def item_id(doc_id: Column, field_key: Column, values: Column) -> Column:
    """DD-7: an id from document, field and the sorted candidate values."""
    return F.substring(F.sha2(F.concat_ws("|", doc_id.cast("string"), field_key, F.array_join(F.array_sort(F.array_distinct(values)), ",")), 256), 1, 20)


def open_items(fields: DataFrame, conflicts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """PF-20: found fields of low confidence or with a conflict, and why.

    fields has doc_id, field_key, value, confidence, status, candidate_values.
    """
    clash = conflicts.select("doc_id", "field_key").distinct().withColumn("_conflict", F.lit(True))
    reasons = F.array_compact(F.array(F.when(F.col("confidence") < threshold, "low_confidence"), F.when(F.col("_conflict"), "conflict")))
    read = fields.filter("status = 'found'").join(clash, ["doc_id", "field_key"], "left").withColumn("reasons", reasons).filter(F.size("reasons") > 0)
    return read.select(item_id(F.col("doc_id"), F.col("field_key"), F.col("candidate_values")).alias("item_id"), "doc_id", "field_key", F.col("value").alias("primary_value"), "confidence", F.array_join("reasons", ",").alias("reasons"), F.slice("candidate_values", 1, MOST_CANDIDATES).alias("candidates"), F.lit("open").alias("status"))


def upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """JN-13, SNK-4: resolved items stay as they are; all others are replaced by new ones."""
    resolved = existing.filter("status = 'resolved'")
    fresh = new.join(resolved.select("item_id"), "item_id", "left_anti")
    old = existing.filter("status <> 'resolved'").join(new.select("item_id"), "item_id", "left_anti")
    return resolved.unionByName(old, True).unionByName(fresh, True)


def resolve(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """DM-2: items with decisions applied; `error` says why a decision is not valid.

    accept takes the primary value, correct needs a value, reject leaves none.
    """
    joined = items.join(decisions.select("item_id", "action", F.col("value").alias("_value")), "item_id", "full_outer")
    error = (
        F.when(F.col("doc_id").isNull(), "unknown item").when(F.col("action").isNull(), None).when(~F.col("action").isin("accept", "correct", "reject"), "unknown action")
        .when((F.col("action") == "correct") & (F.coalesce("_value", F.lit("")) == ""), "correct needs a value")
    )
    done = F.col("action").isNotNull() & error.isNull()
    value = F.when(F.col("action") == "accept", F.col("primary_value")).when(F.col("action") == "correct", F.col("_value")).otherwise(F.lit(""))
    return joined.withColumn("error", error).withColumn("decision", F.when(done, value)).withColumn("status", F.when(done, "resolved").otherwise(F.col("status"))).drop("_value")


def gold(items: DataFrame) -> DataFrame:
    """SNK-3: doc_id and fields, a map of each resolved field to its values; none for a reject."""
    values = F.when(F.col("action") == "reject", F.array().cast("array<string>")).otherwise(F.array("decision"))
    entries = items.filter("status = 'resolved'").groupBy("doc_id", "field_key").agg(F.max_by(values, "item_id").alias("v"))
    return entries.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_key", "v")))).alias("fields"))


def precision_recall(pairs: DataFrame, gold_flag: Column, found_flag: Column, *keys: str) -> DataFrame:
    """AG-11, JN-17: counts, precision, recall and F1, zero where nothing was found."""
    tp, fp, fn = F.count_if(gold_flag & found_flag), F.count_if(~gold_flag & found_flag), F.count_if(gold_flag & ~found_flag)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = pairs.groupBy(*keys).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.select(*keys, "tp", "fp", "fn", F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(ratio(2 * p * r, p + r), 3).alias("f1"))


def name_recall(gold_names: DataFrame, found_names: DataFrame, *keys: str) -> DataFrame:
    """JN-16: gold names that a found name of the key contains or is contained in."""
    inside, _ = containment.hits(gold_names, found_names, keys)
    _, around = containment.hits(found_names, gold_names, keys)
    hit = inside.unionByName(around).distinct().withColumn("hit", F.lit(True))
    return gold_names.join(hit, [*keys, "name"], "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gold"), F.count("hit").alias("n_hit"))
