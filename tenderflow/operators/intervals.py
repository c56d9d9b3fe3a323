"""Joins of points with half-open intervals of their key, linear in what goes in and comes out.

Disjoint or nested intervals need no join: points and interval starts stand in one ordered window,
and the last start before a point, of each nesting level, is the one that may hold it. Intervals
that overlap at will meet points in bins of the coordinate: an equi join on key and bin, which
also spreads a key of many points over tasks. A bin has BIN places, so of the pairs that a bin
makes at most two bins' worth an interval fall away.

An interval is block_start <= place < block_end; one that is empty or has a null end holds nothing,
and a null place is in none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 64


def _binned(intervals: DataFrame, start: str, end: str, width: int) -> DataFrame:
    some = intervals.filter(F.col(start) < F.col(end))
    return some.withColumn("_bin", F.explode(F.sequence(F.expr(f"{start} div {width}"), F.expr(f"({end} - 1) div {width}"))))


def pairs(points: DataFrame, intervals: DataFrame, key: str = "doc_id", at: str = "ord", start: str = "block_start", end: str = "block_end", how: str = "inner", width: int = BIN) -> DataFrame:
    """A row for each point and interval that holds it; `how` may be inner or left_semi.

    Both sides' columns are kept, the key once; other names must differ.
    """
    spans = _binned(intervals, start, end, width).withColumnRenamed(key, "_key")
    placed = points.withColumn("_bin_of", F.expr(f"{at} div {width}"))
    met = (F.col(key) == F.col("_key")) & (F.col("_bin_of") == F.col("_bin")) & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    return placed.join(spans, met, how).drop("_key", "_bin", "_bin_of")


def holders(points: DataFrame, intervals: DataFrame, keep: Sequence[str], key: str = "doc_id", at: str = "ord", start: str = "block_start", end: str = "block_end", level: Column | None = None, levels: Sequence[int] = (0,)) -> DataFrame:
    """The points with `holder`, a struct of the interval's columns `keep`, null without one: the
    interval of the largest level that holds the point.

    Intervals of one level must not overlap (of several that start at one place the longest
    counts); `level` numbers them, by default all are of one.
    """
    place = lambda c: F.col(c).cast("long")
    span = F.struct(place(end).alias("to"), F.struct(*keep).alias("kept"))
    nest = F.lit(0) if level is None else level
    spans = intervals.filter(F.col(start) < F.col(end)).select(F.col(key).alias("_key"), place(start).alias("_at"), F.lit(0).alias("_kind"), span.alias("_span"), nest.cast("int").alias("_nest"))
    no_span = F.lit(None).cast(spans.schema["_span"].dataType)
    rows = points.select(F.col(key).alias("_key"), place(at).alias("_at"), F.lit(1).alias("_kind"), no_span.alias("_span"), F.lit(None).cast("int").alias("_nest"), F.struct(*points.columns).alias("_point"))
    both = spans.withColumn("_point", F.lit(None).cast(rows.schema["_point"].dataType)).unionByName(rows)
    before = Window.partitionBy("_key").orderBy("_at", "_kind", "_span.to").rowsBetween(Window.unboundedPreceding, 0)
    last = {n: F.last(F.when((F.col("_kind") == 0) & (F.col("_nest") == n), F.col("_span")), ignorenulls=True).over(before) for n in levels}
    seen = both.select("_kind", "_at", "_point", *(c.alias(f"_in_{n}") for n, c in last.items())).filter("_kind = 1")
    innermost = F.coalesce(*(F.when(F.col(f"_in_{n}.to") > F.col("_at"), F.col(f"_in_{n}.kept")) for n in sorted(levels, reverse=True)))
    return seen.select("_point.*", innermost.alias("holder"))
