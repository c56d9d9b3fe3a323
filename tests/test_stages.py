"""Incremental stages: what is done again, what is not seen, what a lost file costs."""

import os
from glob import glob

import pytest
from pyspark.sql import functions as F

from tenderflow import commits
from tenderflow.sinks import stages


def documents(spark, changed=()):
    rows = [(i, f"text {i}{'!' if i in changed else ''}") for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("content_hash", F.sha2("text", 256)).repartition(3, "doc_id")


class Maker:
    def __init__(self):
        self.asked = []

    def __call__(self, docs):
        self.asked.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
        return docs.filter("doc_id <> 7").select("doc_id", F.explode(F.split("text", " ")).alias("word"))


def test_only_what_changed_is_done(spark, tmp_path):
    path, make = str(tmp_path / "stage"), Maker()
    docs = documents(spark)
    assert stages.run(docs, path, "1", make) == 1 and make.asked == [[*range(20)]]
    assert stages.run(docs, path, "1", make) == 0 and len(make.asked) == 1
    later = documents(spark, (4,))
    assert stages.pending(later, path, "1").count() == 1
    assert stages.run(later, path, "1", make) == 2 and make.asked[-1] == [4]
    got = stages.rows(later, path, "1").collect()
    assert len(got) == 38 and {r.doc_id: r.version for r in got} == {i: 2 if i == 4 else 1 for i in range(20) if i != 7}
    assert {r.word for r in got if r.doc_id == 4} == {"text", "4!"}
    assert stages.rows(docs, path, "1").filter("doc_id = 4").count() == 0  # its old rows were replaced
    assert stages.run(later, path, "2", make) == 3 and make.asked[-1] == [*range(20)]
    assert stages.rows(later, path, "1").count() == 0
    assert stages.run(later, path, "2", make, force=True) == 4


def test_torn_files_are_done_again(spark, tmp_path):
    path, make = str(tmp_path / "stage"), Maker()
    docs = documents(spark)
    stages.run(docs, path, "1", make)
    first, second, *_ = sorted(glob(f"{path}/data/*/*.parquet"))
    held = {r.doc_id for r in spark.read.parquet(first).collect()}
    os.truncate(first, os.path.getsize(first) // 2)
    assert stages.torn(spark, path).collect()[0].n_docs == len(held)
    assert {r.doc_id for r in stages.rows(docs, path, "1").collect()} == {i for i in range(20) if i != 7} - held
    stages.run(docs, path, "1", make)
    assert set(make.asked[-1]) == held and stages.torn(spark, path).count() == 0
    assert stages.rows(docs, path, "1").count() == 38
    size = os.path.getsize(second)
    with open(second, "r+b") as f:  # as long as before, but no longer Parquet
        f.write(b"x" * 4)
        f.seek(size - 4)
        f.write(b"x" * 4)
    for crc in glob(f"{path}/data/*/.*.crc"):
        os.remove(crc)
    assert stages.torn(spark, path).count() == 0 and stages.torn(spark, path, deep=True).count() == 1
    stages.run(docs, path, "1", make, deep=True)
    assert stages.rows(docs, path, "1").count() == 38


def test_what_is_not_committed_is_not_seen(spark, tmp_path):
    path, make = str(tmp_path / "stage"), Maker()
    docs = documents(spark)

    def fails(some):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        stages.run(docs, path, "1", fails)
    assert commits.versions(spark, path) == {} and stages.pending(docs, path, "1").count() == 20
    with pytest.raises(FileNotFoundError):
        stages.rows(docs, path, "1").count()
    assert stages.run(docs, path, "1", make) == 1


def test_one_of_two_writers_gets_a_version(spark, tmp_path):
    path = str(tmp_path / "table")
    assert commits.commit(spark, path, 1, "a") and not commits.commit(spark, path, 1, "b")
    assert commits.append(spark, path, "b") == 2
    open(f"{path}/commits/00000003", "w").close()  # a writer that was lost
    assert commits.append(spark, path, "c") == 4
    assert commits.versions(spark, path) == {1: "a", 2: "b", 4: "c"}
    for name in "ax":
        os.makedirs(f"{path}/data/{name}")
    commits.forget(spark, path, {"data": ["a", "x"]})
    assert os.listdir(f"{path}/data") == ["a"]
