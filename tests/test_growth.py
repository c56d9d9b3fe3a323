"""Work that grows with the input, not with its square or with one group of it."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tenderflow.functions import scoring
from tenderflow.llm import substring_dedup
from tenderflow.operators import requirements
from tenderflow.plans import catalog


def test_verdicts_are_made_once_a_kind(spark, monkeypatch):
    made = []
    whole = requirements.kind_verdicts

    def counted(done, asked, year):
        made.append((done.count(), asked.count()))
        return whole(done, asked, year)

    monkeypatch.setattr(requirements, "kind_verdicts", counted)
    said = F.when(F.col("id") % 2 == 0, "±800kV 换流站监理，2020年竣工").otherwise("±800kV 线路监理，2020年竣工")
    done = spark.range(300).union(spark.range(2)).select(F.col("id").alias("performance_id"), scoring.performance_elements(said).alias("e"))
    asked = spark.range(200).select(F.when(F.col("id") > 0, F.col("id")).alias("criterion_id"), scoring.scope(F.lit("±800kV 换流站监理")).alias("a"), F.lit(None).cast("double").alias("amount_min"), F.when(F.col("id") % 2 == 0, 5).alias("years"))
    got = requirements.verdicts(done, asked, 2024)
    assert made == [(2, 2)]
    rows = got.toPandas()
    want = pd.DataFrame([(p, c) for p in [*range(0, 300, 2), 0] for c in [None, *range(1, 200)]], columns=["performance_id", "criterion_id"])
    shown = lambda x: sorted(x[["performance_id", "criterion_id"]].fillna(-1).astype(int).itertuples(index=False, name=None))
    assert shown(rows) == shown(want) and set(rows.verdict) == {"match"}


def test_score_tables_read_their_lines_once(spark):
    for name in ("declared_totals", "score_rows"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "SortAggregate" not in plan


def test_score_tables_are_sorted_without_their_cells(spark):
    plan = catalog.QUERIES["score_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    moved = plan[next(i for i, x in enumerate(plan) if "Sort [doc_id" in x) + 1]
    assert "Project [doc_id" in moved and not re.search(r"[\[ ](cells|said)#\d+[,\]]", moved)
    assert sum("Sort [" in x for x in plan) == 2 and not any("Aggregate" in x for x in plan)


def test_category_cells_are_read_once(spark):
    cell = scoring.score_cell(F.col("cells"), F.col("header"))
    plan = spark.createDataFrame([(["1", "a"], ["", "分值"])], "cells array<string>, header array<string>").select(cell)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("coalesce(filter(") == 1


def test_a_bucket_that_fits_a_block_is_refined_there(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "refine_dealt", lambda found: pytest.fail("windows dealt out one by one"))
    rows = [(1, i, 0, 0, 1, 2000, f"{i % 1999:0100d}".encode()) for i in range(2000)]
    found = spark.createDataFrame(rows, "h long, doc_id long, sig int, start int, windows int, classes long, context binary")
    assert [tuple(r) for r in substring_dedup.refine(found).collect()] == [(1999, 0, 0, 100)]
