"""Lot names: package expressions, identity, sameness and applicability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import half_digits

# Package forms, ranges, separators and restricting words.
PACKAGE = (r"包\s*0*(\d+)\s*号?", r"第\s*0*(\d+)\s*包", r"(\d+)\s*号包", r"标段\s*0*(\d+)")
RANGE = r"包\s*0*(\d+)\s*[-~～至到]\s*(?:包\s*)?0*(\d+)"
SEPARATOR = r"[、,，;；\s]+"
RESTRICTS = r"除[^\n，。;；]{0,12}外|不含|不适用|仅限|只限"


def _int_array() -> Column:
    return F.array().cast("array<int>")


def packages(lot: Column) -> Column:
    """SF-36: struct<nums, complete>: sorted package numbers, and whether all digits were read.

    Ranges are read first on the whole text; what is left is split at separators. A bare number
    counts once a package form came before it.
    """
    s = half_digits(lot)
    lows, highs = (F.transform(F.regexp_extract_all(s, F.lit(RANGE), F.lit(i)), lambda x: x.cast("int")) for i in (1, 2))
    ranges = F.arrays_zip(lows.alias("a"), highs.alias("z"))
    spans = F.flatten(F.transform(ranges, lambda r: F.when(r["z"] >= r["a"], F.sequence(r["a"], r["z"])).otherwise(_int_array())))
    whole = F.forall(ranges, lambda r: r["z"] >= r["a"])
    parts = F.filter(F.split(F.regexp_replace(s, RANGE, " "), SEPARATOR), lambda p: p != "")
    start = F.struct(spans.alias("nums"), (F.size(spans) > 0).alias("open"), whole.alias("complete"))

    def step(acc: Column, p: Column) -> Column:
        number = F.coalesce(*(F.regexp_extract(p, f"^(?:{form})$", 1).try_cast("int") for form in PACKAGE))
        bare = F.regexp_extract(p, r"^0*(\d+)$", 1).try_cast("int")
        made = lambda n, o, c: F.struct(n.alias("nums"), o.alias("open"), c.alias("complete"))
        return (
            F.when(number.isNotNull(), made(F.array_append(acc["nums"], number), F.lit(True), acc["complete"]))
            .when(bare.isNotNull() & acc["open"], made(F.array_append(acc["nums"], bare), F.lit(True), acc["complete"]))
            .when(F.rlike(p, F.lit(r"\d")), made(acc["nums"], acc["open"], F.lit(False)))
            .otherwise(acc)
        )

    return F.aggregate(parts, start, step, lambda a: F.struct(F.array_sort(F.array_distinct(a["nums"])).alias("nums"), a["complete"].alias("complete")))


def searched_packages(lot: Column) -> Column:
    """SF-37: sorted numbers of every package form anywhere in the text."""
    found = (F.transform(F.regexp_extract_all(half_digits(lot), F.lit(form), F.lit(1)), lambda x: x.cast("int")) for form in PACKAGE)
    return F.array_sort(F.array_distinct(F.concat(*found)))


def sub_bid(lot: Column) -> Column:
    """SF-38: struct<fenbiao, bare> of `sub-bid::package`."""
    s = F.coalesce(lot, F.lit(""))
    at = F.instr(s, "::")
    made = lambda a, b: F.struct(a.alias("fenbiao"), b.alias("bare"))
    return F.when(at > 0, made(F.trim(F.substr(s, F.lit(1), at - 1)), F.trim(F.substr(s, at + 2)))).otherwise(made(F.lit(""), F.trim(s)))


def identity(name: Column) -> Column:
    """SF-38: the package number a name carries, else null."""
    return F.regexp_extract(half_digits(name), r"包\s*0*(\d+)", 1).try_cast("int")


def same_lot(a: Column, b: Column) -> Column:
    """SF-39: equal names, or equal package numbers in equal sub-bids."""
    x, y = sub_bid(a), sub_bid(b)
    numbers = F.coalesce(identity(x["bare"]) == identity(y["bare"]), F.lit(False))
    given = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return given & ((a == b) | ((x["fenbiao"] == y["fenbiao"]) & numbers))


def applies(lot: Column, target: Column) -> Column:
    """SF-40: universal, target, other or unknown; only `other` may be left out."""
    s = F.trim(F.coalesce(lot, F.lit("")))
    x, y = sub_bid(s), sub_bid(target)
    read, wanted = packages(x["bare"]), identity(y["bare"])
    several = F.size(read["nums"]) > 1
    hit = F.array_contains(read["nums"], F.coalesce(wanted, F.lit(-1)))
    fits = F.when(several, "universal").otherwise("target")
    return (
        F.when((s == "") | (s == "-") | F.rlike(half_digits(s), F.lit(RESTRICTS)), "unknown")
        .when(same_lot(s, target), F.when(read["complete"] & several, "universal").otherwise("target"))
        .when((x["fenbiao"] != "") & (y["fenbiao"] != "") & (x["fenbiao"] != y["fenbiao"]), "other")
        .when(x["fenbiao"] != y["fenbiao"], "unknown")
        .when(wanted.isNull() | (F.size(read["nums"]) == 0), "unknown")
        .when(hit, fits)
        .when(read["complete"], "other")
        .when(F.array_contains(searched_packages(x["bare"]), wanted), "universal")
        .otherwise("unknown")
    )


def lot_order(lot: Column) -> Column:
    """TK-4: plain lots before sub-bids, then sub-bid, number, name."""
    s = sub_bid(lot)
    return F.struct((s["fenbiao"] != "").alias("composite"), s["fenbiao"], F.coalesce(identity(s["bare"]), F.lit(10**9)).alias("number"), F.coalesce(lot, F.lit("")).alias("name"))
