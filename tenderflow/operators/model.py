"""A stage that asks a model for what the rules did not find, and believes only what it can quote.

The model is the caller's function: it gets a list of requests and gives an answer text for each.
It runs in Arrow batches on the executors; a batch that fails is asked again row by row, and a row
that fails every time carries its error, so no answer is lost with another. Answers are JSON. A
value counts if its quote stands in the document, the quote has the value (white space aside), and
the value is one of its field's kind; its place is that of the quote in the text as it is. All
else goes to the ledger with the reason.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import fields, structure
from .rules import BUILT_IN, Rules

# Characters of a zone, or of a document without one, that a request shows; the
# confidence of a quoted answer; how much of a score's quote must be found.
CONTEXT = 6000
CONFIDENCE = 0.72
PREFIX = 15
ATTEMPTS = 3
ANSWER = "map<string, struct<value: string, quote: string>>"
FORMULAS = "struct<formulas: array<struct<name: string, expression: string, baseline: string>>, quote: string>"
#: What \\s and (?U) match in Java.
SPACES = np.array([*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
Ask = Callable[[list[dict]], Sequence[str]]


def requests(blocks: DataFrame, found: DataFrame, zones: DataFrame | None = None, keys: Sequence[str] | None = None, rules: Rules = BUILT_IN) -> DataFrame:
    """FX-7: doc_id, field_keys and context of each document that misses one of the keys.

    The context is the beginning of each zone that a missing field prefers, in the order of the
    text, or of the document where there is none. blocks has doc_id, ord and text.
    """
    asked = [*(keys or rules.packs)]
    missing = fields.required_missing(found, blocks, asked)
    wanted = missing.groupBy("doc_id").agg(F.sort_array(F.collect_list("field_key")).alias("field_keys"))
    said = lambda rows, *by: rows.groupBy("doc_id", *by).agg(F.min("ord").alias("first"), F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda b: b["text"]), "\n"), 1, CONTEXT).alias("said"))
    begun = blocks.withColumn("_before", F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = said(begun.filter(F.col("_before") < CONTEXT).select("doc_id", "ord", "text"))
    if zones is None:
        return wanted.join(whole, "doc_id").select("doc_id", "field_keys", F.col("said").alias("context"))
    liked = F.explode(F.array(*(F.struct(F.lit(k).alias("field_key"), F.lit(z).alias("zone")) for k in asked for z in rules.packs[k].zones)))
    of_field = blocks.sparkSession.range(1).select(liked.alias("p")).select("p.*")
    near = missing.join(F.broadcast(of_field), "field_key").select("doc_id", "zone").distinct().join(zones, ["doc_id", "zone"])
    shown = said(structure.within(blocks.select("doc_id", "ord", "text"), near.select("doc_id", "zone", "title", "block_start", "block_end")), "zone", "title")
    headed = F.concat(F.lit("【"), F.coalesce("title", "zone"), F.lit("】\n"), "said")
    contexts = shown.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "zone", headed.alias("said")))), lambda z: z["said"]), "\n\n").alias("zoned"))
    joined = wanted.join(contexts, "doc_id", "left").join(whole, "doc_id", "left")
    return joined.select("doc_id", "field_keys", F.coalesce("zoned", "said", F.lit("")).alias("context"))


def answers(asked: DataFrame, ask: Ask, attempts: int = ATTEMPTS) -> DataFrame:
    """UX-6: the requests' doc_id (or other columns but the last two) with answer or error.

    Every request has one row. `ask` must be a function that Spark can send to executors.
    """
    names = asked.columns

    def one(request: dict) -> tuple[str | None, str | None]:
        error = None
        for _ in range(attempts):
            try:
                return str(ask([request])[0]), None
            except Exception as e:  # any failure of the caller's model is this row's error
                error = f"{type(e).__name__}: {e}"
        return None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            if not rows:
                continue
            try:
                made = [(str(a), None) for a in ask(rows)]
                if len(made) != len(rows):
                    raise ValueError("an answer for each request is needed")
            except Exception:  # some row of the batch: ask for each alone
                made = [one(r) for r in rows]
            told, errors = (pa.array(list(x), pa.string()) for x in zip(*made))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names if c not in ("field_keys", "context")), told, errors], [*(c for c in names if c not in ("field_keys", "context")), "answer", "error"])

    kinds = ", ".join(f"`{c}` {asked.schema[c].dataType.simpleString()}" for c in names if c not in ("field_keys", "context"))
    return asked.mapInArrow(run, f"{kinds}, answer string, error string")


def raw_spans(rows: DataFrame) -> DataFrame:
    """SF-49: rows with text, dense_at (from 1) and n of a match without white space, with char_start
    and char_end of it in the text as it is, instead of these.

    The i-th visible character of a text stands where the count of visible ones reaches i: one
    lookup in the places of the visible characters.
    """
    names = [c for c in rows.columns if c not in ("text", "dense_at", "n")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for said, at, n in zip(batch["text"].to_pylist(), batch["dense_at"].to_pylist(), batch["n"].to_pylist()):
                places = np.flatnonzero(~np.isin(np.frombuffer(said.encode("utf-32-le"), np.uint32), SPACES))
                spans.append((int(places[at - 1]), int(places[at + n - 2]) + 1))
            starts, ends = zip(*spans) if spans else ((), ())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], [*names, "char_start", "char_end"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, char_start long, char_end long")


def quoted(answered: DataFrame, texts: DataFrame, asked: DataFrame, rules: Rules = BUILT_IN) -> DataFrame:
    """SF-48, SF-49, FX-7: a row for each document and field that was asked for and answered, or that
    failed: doc_id, field_key, kind, value_raw, value_normalized, quote, char_start, char_end,
    confidence and reason, null for what is accepted.

    answered is what `answers` gives, texts has doc_id and text, asked doc_id and field_keys. Fields
    that were not asked for are passed over; fields without an answer have no row.
    """
    each = answered.join(asked.select("doc_id", "field_keys"), "doc_id").withColumn("json", text.loose_json(F.col("answer"))).withColumn("said", F.from_json("json", ANSWER))
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("said").isNull(), "answer is no JSON object")
    failed = each.withColumn("reason", reason).filter("reason is not null").select("doc_id", F.explode("field_keys").alias("field_key"), "reason")
    entries = each.filter("said is not null").select("doc_id", "field_keys", F.explode("said").alias("field_key", "v")).filter(F.array_contains("field_keys", F.col("field_key")))
    shown = entries.select("doc_id", "field_key", fields.kind_of(F.col("field_key"), rules).alias("kind"), F.trim("v.value").alias("value_raw"), F.trim("v.quote").alias("quote")).filter("value_raw <> '' and quote <> ''")
    placed = shown.join(texts.select("doc_id", "text"), "doc_id").withColumn("dense_at", text.quote_at(F.col("quote"), F.col("text"))).withColumn("n", F.length(text.dense(F.col("quote"))))
    held = placed.withColumn("reason", F.when(F.col("dense_at") == 0, "quote is not in the text").when(text.quote_at(F.col("value_raw"), F.col("quote")) == 0, "value is not in the quote"))
    good = raw_spans(held.filter("reason is null").drop("reason"))
    value = F.when(fields.is_value(F.col("kind"), F.col("value_raw")), fields.cleaned(F.col("kind"), F.col("value_raw")))
    typed = good.withColumn("value_normalized", F.explode(F.array(value))).withColumn("reason", F.when(F.col("value_normalized").isNull(), "value is none of its kind"))
    nothing = {"char_start": F.lit(None).cast("long"), "char_end": F.lit(None).cast("long"), "value_normalized": F.lit(None).cast("string")}
    refused = held.filter("reason is not null").withColumns(nothing)
    empty = failed.withColumns({c: F.lit(None).cast("string") for c in ("kind", "value_raw", "quote")} | nothing)
    columns = ["doc_id", "field_key", "kind", "value_raw", "value_normalized", "quote", "char_start", "char_end", "reason"]
    every = typed.select(*columns).unionByName(refused.select(*columns)).unionByName(empty.select(*columns))
    return every.withColumn("confidence", F.when(F.col("reason").isNull(), CONFIDENCE))


def candidates(checked: DataFrame) -> DataFrame:
    """Accepted answers as candidates of `fields.merged`; they stand after all blocks."""
    return checked.filter("reason is null").select("doc_id", F.lit((1 << 31) - 1).alias("ord"), "field_key", "kind", "value_raw", "value_normalized", F.lit("llm").alias("source"), "confidence")


def failures(checked: DataFrame) -> DataFrame:
    """Ledger rows of what was refused or not answered."""
    return checked.filter("reason is not null").select("doc_id", F.concat(F.lit("field:"), "field_key").alias("key"), F.lit("field").alias("kind"), F.lit("FAILED_REVIEW").alias("status"), "reason")


def refined(items: DataFrame, answered: DataFrame, texts: DataFrame) -> DataFrame:
    """FX-10, SF-50: score items with the formulas that a model read out of their rules.

    items has doc_id, score_id, status, formula and confidence. A pending item whose answer has formulas
    and a quote whose first PREFIX characters stand in the text becomes confirmed, with its quote's
    place; an answer with another quote leaves a note. answered has doc_id, score_id and answer.
    """
    said = answered.select("doc_id", "score_id", F.from_json(text.loose_json(F.col("answer")), FORMULAS).alias("a")).filter(F.col("a.quote").isNotNull() & (F.trim("a.quote") != "") & (F.size("a.formulas") > 0))
    placed = said.join(texts.select("doc_id", "text"), "doc_id").select("doc_id", "score_id", "a.formulas", F.trim("a.quote").alias("quote"), text.quote_prefix_at(F.trim("a.quote"), F.col("text"), PREFIX).alias("at"))
    joined = items.join(placed, ["doc_id", "score_id"], "left")
    pending = (F.col("status") == "pending_review") & F.col("at").isNotNull()
    good = pending & (F.col("at") > 0)
    shown = F.substring(F.array_join(F.transform("formulas", lambda f: F.concat(F.coalesce(f["name"], F.lit("")), F.lit("："), F.coalesce(f["expression"], F.lit("")))), "；"), 1, 500)
    made = {
        "formula": F.when(good, shown).otherwise(F.col("formula")),
        "confidence": F.when(good, CONFIDENCE).otherwise(F.col("confidence")),
        "note": F.when(pending & (F.col("at") == 0), "quote is not in the text"),
        "char_start": F.when(good, (F.col("at") - 1).cast("long")),
        "char_end": F.when(good, (F.col("at") - 1 + F.length("quote")).cast("long")),
    }
    return joined.withColumns(made).withColumn("status", F.when(good, "confirmed").otherwise(F.col("status"))).drop("formulas", "quote", "at")


def as_json(said: dict) -> str:
    """An answer text of field -> (value, quote), for functions that stand for a model."""
    return json.dumps({k: {"value": v, "quote": q} for k, (v, q) in said.items()}, ensure_ascii=False)
