"""The verbs of the command line on small tables."""

import json

import pytest

from tenderflow.__main__ import STORED, main
from tenderflow.sinks import stages


def test_usage(capsys):
    for args in ([], ["nothing"], ["report", "a"], ["evaluate", "a", "b", "c", "d"]):
        assert main(args) == 2
    assert "python -m tenderflow" in capsys.readouterr().out


def test_query(spark, capsys):
    assert main(["query"], spark) == 2 and main(["query", "intake_content_dedupe", "/root/testdata/sf0.001", "3"], spark) == 0
    assert "n_docs" in capsys.readouterr().out


def test_report_of_what_changed(spark, tmp_path, monkeypatch, capsys):
    import tenderflow.__main__ as command

    monkeypatch.setattr(command, "STORED", STORED[:1])
    rows = spark.createDataFrame([(1, "t", 0, ["评分项", "分值"])], "doc_id long, table_id string, row int, cells array<string>")
    rows.write.parquet(str(tmp_path / "rows"))
    for step, sites in enumerate((("东区", "西区"), ("东区", "北区"))):
        blocks = spark.createDataFrame([(d, 0, 0, f"建设地点：{site}大街。") for d, site in enumerate(sites)], "doc_id long, ord int, level int, text string")
        blocks.write.parquet(str(tmp_path / f"blocks{step}"))
        for _ in range(2):
            assert main(["report", str(tmp_path / f"blocks{step}"), str(tmp_path / "rows"), str(tmp_path / "out")], spark) == 0
    told = [line for line in capsys.readouterr().out.splitlines() if line.startswith("all_fields")]
    assert told == ["all_fields: version 1", "all_fields: nothing new", "all_fields: version 2", "all_fields: nothing new"]
    docs = command.hashed(blocks)
    got = stages.rows(docs, str(tmp_path / "out" / "all_fields"), "1").filter("field_key = 'site'").collect()
    assert {(r.doc_id, r.value_normalized, r.version) for r in got} == {(0, "东区大街", 1), (1, "北区大街", 2)}


def test_review(spark, tmp_path, capsys):
    items = [("i1", "d", "site", "东区", "open", None, None), ("i2", "d", "agency", "甲", "open", None, None)]
    spark.createDataFrame(items, "item_id string, doc_id string, field_key string, primary_value string, status string, candidates string, reasons string").write.parquet(str(tmp_path / "queue"))
    spark.createDataFrame([("i1", "correct", "西区"), ("i2", "correct", "")], "item_id string, action string, value string").write.parquet(str(tmp_path / "said"))
    assert main(["review", "list", str(tmp_path / "queue")], spark) == 0
    assert main(["review", "resolve", str(tmp_path / "queue"), str(tmp_path / "said"), str(tmp_path / "done")], spark) == 1
    assert main(["review", "export", str(tmp_path / "done"), str(tmp_path / "gold")], spark) == 0
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "gold")).collect()] == [{"doc_id": "d", "fields": {"site": ["西区"]}}]
    assert "correct needs a value" in capsys.readouterr().out


@pytest.mark.parametrize("least, code", [("0.6", 0), ("0.7", 1)])
def test_gate(spark, tmp_path, least, code):
    kind = "doc_id string, field_key string, value string"
    spark.createDataFrame([("d", "a", "1"), ("d", "b", "2"), ("d", "x", "9")], kind).write.parquet(str(tmp_path / "found"))
    spark.createDataFrame([("d", "a", "1"), ("d", "b", "3"), ("d", "c", "4"), ("d", "x", "9")], kind).write.parquet(str(tmp_path / "gold"))
    assert main(["evaluate", str(tmp_path / "found"), str(tmp_path / "gold"), "0"], spark) == 0
    assert main(["evaluate", str(tmp_path / "found"), str(tmp_path / "gold"), str(float(least) - 0.03)], spark) == code  # f1 is 0.571


def test_paths_outside_the_allowed_folders(spark, tmp_path):
    spark.conf.set("spark.tenderflow.allowed_folders", str(tmp_path / "in"))
    try:
        with pytest.raises(PermissionError):
            main(["listing", str(tmp_path / "out")], spark)
    finally:
        spark.conf.unset("spark.tenderflow.allowed_folders")
