"""Containment of names against all pairs, and within one large key."""

import random
import time

from tenderflow.operators import containment, review

NAMES = "k string, name string"


def test_hits(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("ab评分") for _ in range(n))
    shorts = [(rng.choice("xy"), word(rng.randrange(0, 7))) for _ in range(200)] + [("x", None), ("z", "a"), (None, "a")]
    longs = [(rng.choice("xy"), word(rng.randrange(0, 12))) for _ in range(60)] + [("x", None), ("w", "abc"), (None, "abc")]
    inside, around = containment.hits(spark.createDataFrame(shorts, NAMES), spark.createDataFrame(longs, NAMES), ["k"])
    want = {(k, s, t) for k, s in shorts for j, t in longs if k and k == j and s is not None and t is not None and s in t}
    assert sorted(map(tuple, inside.collect())) == sorted({(k, s) for k, s, _ in want})
    assert sorted(map(tuple, around.collect())) == sorted({(k, t) for k, _, t in want})


def test_one_key_of_many_names(spark):
    began = time.time()
    gold = spark.range(100_000).selectExpr("'k' k", "concat('item ', lpad(id, 7, '0')) name")
    found = spark.range(100_000).selectExpr("'k' k", "concat('the item ', lpad(id * 2, 7, '0'), ' of all') name")
    frame = review.name_recall(gold, found, "k")
    row = frame.first()
    assert (row.n_gold, row.n_hit) == (100_000, 50_000)
    assert time.time() - began < 120 and "NestedLoop" not in frame._jdf.queryExecution().executedPlan().toString()
