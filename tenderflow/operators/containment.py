"""Which names contain which, within a key, without comparing all pairs of the key.

A name of up to GRAM characters is contained where a name has it as a gram: a semi join of grams,
exact for either side. A longer name has its rarest gram, by the counts of the other side's names, and
meets only the names that have that gram too; then the names are compared. A name one of whose grams
no other side's name has is in none.

The empty name is in every name; null is in none and holds none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def grams(name: Column, size: int) -> Column:
    """The distinct substrings of a length, in an array."""
    if not size:
        return F.array(F.lit(""))
    cut = F.transform(F.sequence(F.lit(1), F.length(name) - size + 1), lambda i: F.substr(name, i, F.lit(size)))
    return F.when(F.length(name) >= size, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def hits(shorts: DataFrame, longs: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Keys and name of the short ones that a long name of the key contains, and of the long ones
    that contain a short one; each once. Both frames have the keys and name."""
    keys = [*keys]
    ours, theirs = (rows.select(*keys, "name").filter("name is not null").distinct() for rows in (shorts, longs))
    tiny, rest = ours.filter(F.length("name") <= GRAM), ours.filter(F.length("name") > GRAM)
    parts = theirs.select(*keys, "name", F.explode(F.flatten(F.array(*(grams(F.col("name"), n) for n in range(GRAM + 1))))).alias("gram"))
    exact = tiny.join(parts.select(*keys, F.col("gram").alias("name")).distinct(), [*keys, "name"], "left_semi")
    holding = parts.join(tiny.select(*keys, F.col("name").alias("gram")), [*keys, "gram"], "left_semi").select(*keys, "name")

    known = theirs.select(*keys, F.explode(grams(F.col("name"), GRAM)).alias("gram")).groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("n"))
    asked = rest.select(*keys, F.col("name").alias("short"), F.explode(grams(F.col("name"), GRAM)).alias("gram")).join(known, [*keys, "gram"], "left")
    rarest = asked.groupBy(*keys, "short").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.bool_and(F.col("n").isNotNull()).alias("all")).filter("all").drop("all")
    anchors = theirs.select(*keys, F.col("name").alias("long"), F.explode(grams(F.col("name"), GRAM)).alias("gram"))
    met = rarest.join(anchors, [*keys, "gram"]).filter(F.contains("long", F.col("short")))
    return exact.unionByName(met.select(*keys, F.col("short").alias("name")).distinct()), holding.unionByName(met.select(*keys, F.col("long").alias("name"))).distinct()
