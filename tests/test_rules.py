"""Rules as data: round trip, checks, and a field that no source code knows."""

import pytest

from tenderflow.operators import fields, rules, structure

ADDED = [
    rules.Row("pack", "elevator_count", "number", "电梯数量", False, ["notice"], 0, 0.9, "电梯数量[：:]([A-Z0-9]{4,10})"),
    rules.Row("label", "elevator_count", regex="电梯数量$"),
    rules.Row("zone", "notice", place=9, regex="电梯公告"),
]


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "rules")
    rows = rules.BUILT_IN.rows()
    assert rules.store(rules.frame(spark, rows), path) == 1
    loaded = rules.load(spark, path)
    assert loaded.packs == rules.BUILT_IN.packs and loaded.labels == rules.BUILT_IN.labels and loaded.zones == rules.BUILT_IN.zones
    assert rules.store(rules.frame(spark, [*rows, *ADDED]), path) == 2
    assert "elevator_count" in rules.load(spark, path).packs and "elevator_count" not in rules.load(spark, path, 1).packs
    with pytest.raises(FileNotFoundError):
        rules.load(spark, path, 3)


def test_an_added_field_is_found(spark):
    made = rules.compiled(spark, [*rules.BUILT_IN.rows(), *ADDED])
    blocks = spark.createDataFrame([("d", 0, 1, "电梯公告"), ("d", 1, 0, "电梯数量：AB12。项目名称：某工程，"), ("d", 2, 0, "电梯数量：——")], "doc_id string, ord int, level int, text string")
    cells = spark.createDataFrame([("d", 5, "t", 0, 0, "电梯数量："), ("d", 5, "t", 0, 1, "CD34")], "doc_id string, ord int, table_id string, row int, col int, text string")
    zones = structure.zones(blocks, made.zones)
    assert [(r.zone, r.block_start) for r in zones.collect()] == [("notice", 0)]
    near = structure.within(blocks.select("doc_id", "ord"), zones).selectExpr("doc_id", "ord", "'elevator_count' field_key")
    found = fields.all_candidates(blocks, near, cells, made).filter("field_key = 'elevator_count'").collect()
    assert sorted((r.source, r.value_normalized, r.confidence) for r in found) == [("full", "AB12", 0.7), ("table", "CD34", 0.95), ("zone", "AB12", 0.81)]


@pytest.mark.parametrize(
    "row, what",
    [
        (rules.Row("pack", "x", "text", "w", False, [], 0, 0.5, "(a"), "does not compile"),
        (rules.Row("pack", "x", "text", "w", False, [], 0, 0.5, "a"), "no group"),
        (rules.Row("pack", "x", "text", "(", False, [], 0, 0.5, "(a)"), "words"),
        (rules.Row("pack", "x", "colour", "w", False, [], 0, 0.5, "(a)"), "kind"),
        (rules.Row("pack", "x", "text", "w", False, [], 0, 1.5, "(a)"), "confidence"),
        (rules.Row("pack", "x", "text", "w", False, ["nowhere"], 0, 0.5, "(a)"), "zones"),
        (rules.Row("pack", "site", "text", "other", False, [], 9, 0.5, "(a)"), "differs"),
        (rules.Row("pack", "site", *("text", "地点", False, ["notice", "instructions_front"], 0, 0.5, "(a)")), "taken"),
        (rules.Row("label", "x", regex="a"), "no pack"),
        (rules.Row("label", "site", place=3, regex="["), "does not compile"),
        (rules.Row("zone", "x"), "missing"),
        (rules.Row("other", "x", regex="a"), "missing"),
    ],
)
def test_wrong_rules_are_told(spark, row, what):
    with pytest.raises(rules.RuleError, match=what):
        rules.compiled(spark, [*rules.BUILT_IN.rows(), row])
