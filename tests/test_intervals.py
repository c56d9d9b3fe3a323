"""Interval joins against plain loops, and on a long document."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tenderflow.operators import evidence, intervals, structure


@pytest.fixture(scope="module")
def some():
    rng = random.Random(3)
    points = [(rng.choice("ab"), i, f"t{i}") for i in range(400)] + [("c", 5, "x"), ("c", None, "y"), (None, 5, "z")]
    spans = [(rng.choice("ab"), n, a := rng.randrange(-3, 400), a + rng.choice((0, 1, 5, 70, 300))) for n in range(60)] + [("a", 99, 5, None), ("d", 98, 0, 10), (None, 97, 0, 10)]
    return points, spans


@pytest.mark.parametrize("width", [1, 7, 64, 1000])
def test_pairs(spark, some, width):
    points, spans = some
    p = spark.createDataFrame(points, "doc_id string, ord int, text string")
    s = spark.createDataFrame(spans, "doc_id string, n int, block_start int, block_end int")
    want = sorted((d, o, n) for d, o, _ in points for e, n, a, z in spans if d == e and d and o is not None and z is not None and a <= o < z)
    assert sorted((r.doc_id, r.ord, r.n) for r in intervals.pairs(p, s, width=width).collect()) == want
    once = sorted({(d, o) for d, o, _ in want})
    assert sorted((r.doc_id, r.ord) for r in intervals.pairs(p, s, how="left_semi", width=width).collect()) == once
    left = structure.within_or_all(p.filter("doc_id is not null and ord is not null"), s).collect()
    assert sorted((r.doc_id, r.ord) for r in left) == sorted([*once, ("c", 5)])


def test_holders(spark):
    rng = random.Random(5)
    spans, points = [], []
    for doc in "ab":
        at = 0
        while at < 300:
            n = rng.randrange(1, 30)
            spans.append((doc, 1, at, at + n))
            inner = at + rng.randrange(n)
            spans.append((doc, 3, inner, inner + rng.randrange(0, at + n - inner + 1)))
            at += n + rng.randrange(3)
        points += [(doc, i, f"{doc}{i}") for i in range(-5, 320)]
    p, s = spark.createDataFrame(points, "doc_id string, ord int, title string"), spark.createDataFrame(spans, "doc_id string, level int, block_start int, block_end int")
    got = {r.title: r.holder and tuple(r.holder) for r in intervals.holders(p, s, ["level", "block_start"], level=F.col("level"), levels=(1, 2, 3)).collect()}
    want = {t: max(((n, a) for e, n, a, z in spans if d == e and a <= o < z), default=None) for d, o, t in points}
    assert got == want


def test_offsets_outside_all_parts_go(spark):
    found = spark.createDataFrame([("a", 5), ("a", 15), ("a", 25), ("b", 5)], "doc_id string, char_start long")
    spans = spark.createDataFrame([("a", 0, 10, 100), ("a", 20, 30, 500)], "doc_id string, start long, end long, main_start long")
    assert sorted(map(tuple, evidence.to_main(found, spans).collect())) == [("a", 5, 105), ("a", 25, 505)]


def test_a_long_document(spark):
    began = time.time()
    blocks = spark.range(100_000).selectExpr("'d' doc_id", "cast(id as int) ord", "case when id % 10 = 0 then cast(1 + (id div 10) % 4 as int) else 0 end level", "concat('s', id) text")
    tree = structure.sections(blocks)
    inner = structure.deepest_section(blocks.filter("level = 0").select("doc_id", "ord"), tree)
    assert inner.filter(F.col("title") == F.concat(F.lit("s"), F.col("ord") - F.col("ord") % 10)).count() == 90_000
    inside = structure.within(blocks.select("doc_id", "ord"), tree.select("doc_id", F.col("ord").alias("section"), "block_start", "block_end"))
    assert inside.count() == sum(r.n for r in tree.select((F.col("block_end") - F.col("block_start")).alias("n")).collect())
    for plan in (inner, inside):
        assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()
    assert time.time() - began < 60
