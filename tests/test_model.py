"""The injected model stage: requests, failing answers, quotes and their places."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tenderflow.functions import text
from tenderflow.operators import fields, model, structure


def test_requests(spark):
    blocks = spark.createDataFrame([("a", 0, 1, "招标公告"), ("a", 1, 0, "x" * 7000), ("a", 2, 1, "其他"), ("b", 0, 0, "y" * 5000), ("b", 1, 0, "z" * 5000), ("c", 0, 0, "w")], "doc_id string, ord int, level int, text string")
    found = spark.createDataFrame([("c", "site", "found"), ("a", "agency", "found"), ("b", "site", "not_found")], "doc_id string, field_key string, status string")
    got = {r.doc_id: r for r in model.requests(blocks, found, structure.zones(blocks), ["site", "agency"]).collect()}
    assert {d: list(r.field_keys) for d, r in got.items()} == {"a": ["site"], "b": ["agency", "site"], "c": ["agency"]}
    assert got["a"].context == "【招标公告】\n" + ("招标公告\n" + "x" * 7000)[:6000]
    assert got["b"].context == ("y" * 5000 + "\n" + "z" * 5000)[:6000]
    assert model.requests(blocks, found, keys=["site"]).filter("doc_id = 'a'").first().context == ("招标公告\n" + "x" * 7000)[:6000]


def test_a_failing_row_does_not_cost_the_others(spark):
    def moody(asked):
        """Fails for every batch of several and for one document always."""
        if len(asked) > 1:
            raise RuntimeError("one at a time")
        if asked[0]["doc_id"] == 3:
            raise ValueError("never")
        return [json.dumps({"doc": asked[0]["doc_id"], "keys": asked[0]["field_keys"]})]

    asked = spark.createDataFrame([(i, ["site"], "text") for i in range(6)], "doc_id long, field_keys array<string>, context string").coalesce(1)
    got = {r.doc_id: (r.answer, r.error) for r in model.answers(asked, moody).collect()}
    assert got[3] == (None, "ValueError: never") and len(got) == 6
    assert got[2] == ('{"doc": 2, "keys": ["site"]}', None)


def test_quoted(spark):
    asked = spark.createDataFrame([(i, ["site", "price_limit"], "") for i in range(6)], "doc_id long, field_keys array<string>, context string")
    texts = spark.createDataFrame([(i, "前言。建设 地点\n是 东城区 路；限价 五百万元整。") for i in range(6)], "doc_id long, text string")
    said = {
        0: model.as_json({"site": ("东城区路", "建设地点是东城区路"), "price_limit": ("五百万元", "限价五百万元整"), "agency": ("甲", "前言")}),
        1: model.as_json({"site": ("西城区", "建设地点是西城区")}),
        2: model.as_json({"site": ("西城区", "建设地点")}),
        3: "no json",
        4: model.as_json({"price_limit": ("东城区路", "东城区路"), "site": ("", "建设")}),
    }
    rows = [(i, said.get(i), None if i in said else "TimeoutError: late") for i in range(6)]
    answered = spark.createDataFrame(rows, "doc_id long, answer string, error string")
    checked = model.quoted(answered, texts, asked)
    got = {(r.doc_id, r.field_key): r for r in checked.collect()}
    whole = texts.first().text
    site = got[0, "site"]
    assert (site.value_normalized, site.reason, site.confidence) == ("东城区路", None, 0.72)
    assert whole[site.char_start : site.char_end] == "建设 地点\n是 东城区 路"
    assert got[0, "price_limit"].value_normalized == "5000000" and (0, "agency") not in got
    reasons = {k: r.reason for k, r in got.items() if r.reason}
    assert reasons == {
        (1, "site"): "quote is not in the text", (2, "site"): "value is not in the quote", (4, "price_limit"): "value is none of its kind",
        **{(3, k): "answer is no JSON object" for k in ("site", "price_limit")}, **{(5, k): "TimeoutError: late" for k in ("site", "price_limit")},
    }
    assert model.failures(checked).count() == len(reasons)
    assert fields.merged(model.candidates(checked)).count() == 2


def test_raw_places(spark):
    rng = random.Random(6)
    rows = []
    for i in range(1000):
        said = "".join(rng.choice("ab  \n　中 é😀") for _ in range(rng.randrange(5, 60)))
        dense = re.sub(r"\s+", "", said)
        if dense:
            a = rng.randrange(len(dense))
            rows.append((i, said, dense[a : a + rng.randrange(1, 8)]))
    frame = spark.createDataFrame(rows, "id int, text string, quote string")
    placed = frame.withColumn("dense_at", text.quote_at(F.col("quote"), F.col("text"))).withColumn("n", F.length("quote"))
    got = {r.id: (r.char_start, r.char_end) for r in model.raw_spans(placed.drop("quote")).collect()}
    for i, said, quote in rows:
        places = [k for k, c in enumerate(said) if not c.isspace()]
        at = re.sub(r"\s+", "", said).find(quote)
        assert got[i] == (places[at], places[at + len(quote) - 1] + 1)


@pytest.mark.parametrize("quote, status", [("价格得分按公式计算，得分等于基准", "confirmed"), ("别的公式", "pending_review")])
def test_refined_scores(spark, quote, status):
    items = spark.createDataFrame([("d", "T-1", "pending_review", None, 0.5), ("d", "T-2", "confirmed", "f", 0.9)], "doc_id string, score_id string, status string, formula string, confidence double")
    said = json.dumps({"formulas": [{"name": "得分", "expression": "a/b"}, {"name": "乙", "expression": "c"}], "quote": quote + "价除以报价"})
    answered = spark.createDataFrame([("d", "T-1", said), ("d", "T-2", said)], "doc_id string, score_id string, answer string")
    texts = spark.createDataFrame([("d", "一、价格得分按公式计算，得分等于基准价。")], "doc_id string, text string")
    one, two = sorted(model.refined(items, answered, texts).collect(), key=lambda r: r.score_id)
    assert one.status == status and (two.status, two.formula, two.confidence, two.note) == ("confirmed", "f", 0.9, None)
    assert (one.formula, one.confidence, one.char_start) == (("得分：a/b；乙：c", 0.72, 2) if status == "confirmed" else (None, 0.5, None))
    assert (one.note is None) == (status == "confirmed")
