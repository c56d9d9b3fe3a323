"""Incremental stages: what a stage made of each document, and which documents it must do anew.

A stage's folder has data (rows by batch), manifests (a row for each document and file of a batch)
and the commits that make batches visible. A document is done if its newest entry has its content
hash and the code version and all its files are there in their full length; the rest, found by an
anti join, is pending. A run makes the pending documents' rows and commits them as one batch.

A document without rows has an entry without a file. The newest batch tells the rows' schema. Documents that are no longer asked for keep
their rows in the store, but `rows` gives those of the asked documents only.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import commits
from ..shared import remove

ENTRY = "doc_id long, content_hash string, code_version string, file string, length long, n_rows long, version int"


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The newest batch's entries of each document: doc_id, content_hash, code_version, file, length,
    n_rows and version."""
    found = commits.versions(spark, path)
    if not found:
        return spark.createDataFrame([], ENTRY)
    held = spark.createDataFrame([(name, version) for version, name in found.items()], "batch string, version int")
    every = spark.read.option("basePath", f"{path}/manifests").parquet(*(f"{path}/manifests/batch={name}" for name in found.values())).join(F.broadcast(held), "batch")
    newest = every.groupBy("doc_id").agg(F.max("version").alias("version"))
    return every.join(newest, ["doc_id", "version"]).select(*(c.split()[0] for c in ENTRY.split(", ")))


def lengths(spark: SparkSession, path: str) -> DataFrame:
    """file and length of all data files, as the store lists them; nothing is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{path}/data")
    return listed.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("there"))


def batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed batches, unreadable files passed over."""
    found = commits.versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no committed batch in {path}")
    told = spark.read.parquet(f"{path}/manifests/batch={found[max(found)]}").select("data_schema").first().data_schema
    lenient = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return lenient.schema(StructType.fromJson(json.loads(told))).parquet(*(f"{path}/data/batch={name}" for name in found.values()))


def checked(spark: SparkSession, path: str, deep: bool = False) -> DataFrame:
    """The entries with `whole`: whether the file is there as it was written.

    That is told by its length or, with `deep`, also by counting the rows that can be read.
    """
    known = entries(spark, path)
    if not commits.versions(spark, path):
        return known.withColumn("whole", F.lit(True))
    whole = F.coalesce("there", F.lit(-1)) == F.col("length")
    joined = known.join(lengths(spark, path), "file", "left")
    if deep:
        readable = batches(spark, path).groupBy("doc_id", F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("read"))
        joined = joined.join(readable, ["doc_id", "file"], "left")
        whole &= F.coalesce("read", F.lit(0)) == F.col("n_rows")
    return joined.withColumn("whole", F.col("file").isNull() | whole).select(*known.columns, "whole")


def torn(spark: SparkSession, path: str, deep: bool = False) -> DataFrame:
    """Files that are missing, cut or (deep) unreadable, with the number of documents that they concern."""
    return checked(spark, path, deep).filter("not whole").groupBy("file").agg(F.countDistinct("doc_id").alias("n_docs"))


def pending(docs: DataFrame, path: str, code_version: str, force: bool = False, deep: bool = False) -> DataFrame:
    """DM-4: the documents (doc_id, content_hash and more) that the stage must do; all with `force`."""
    if force:
        return docs
    done = checked(docs.sparkSession, path, deep).groupBy("doc_id", "content_hash", "code_version").agg(F.bool_and("whole").alias("whole"))
    good = done.filter(F.col("whole") & (F.col("code_version") == code_version)).select("doc_id", "content_hash")
    return docs.join(good, ["doc_id", "content_hash"], "left_anti")


def run(docs: DataFrame, path: str, code_version: str, make: Callable[[DataFrame], DataFrame], force: bool = False, deep: bool = False) -> int:
    """SNK-1, AP-9: make the pending documents' rows (with doc_id) and commit them; the version, 0 if none was pending.

    docs has doc_id and content_hash beside what `make` needs.
    """
    spark = docs.sparkSession
    todo = pending(docs, path, code_version, force, deep)
    name = commits.fresh()
    data, manifest = f"{path}/data/batch={name}", f"{path}/manifests/batch={name}"
    asked = f"{path}/asked/{name}"
    todo.select("doc_id", "content_hash").write.parquet(asked)  # what is pending does not change under the run
    chosen = spark.read.parquet(asked)
    if chosen.isEmpty():
        remove(spark, asked)
        return 0
    made = make(docs.join(chosen, ["doc_id", "content_hash"], "left_semi"))
    made.write.parquet(data)
    written = spark.read.parquet(data).select("doc_id", "_metadata.file_path", "_metadata.file_size").groupBy("doc_id", F.col("file_path").alias("file"), F.col("file_size").alias("length")).agg(F.count(F.lit(1)).alias("n_rows"))
    entry = chosen.join(written, "doc_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    entry.select(F.col("doc_id").cast("long").alias("doc_id"), "content_hash", F.lit(code_version).alias("code_version"), "file", "length", F.col("n_rows").cast("long").alias("n_rows"), F.lit(made.schema.json()).alias("data_schema")).write.parquet(manifest)
    version = commits.append(spark, path, name)
    remove(spark, asked)
    return version


def rows(docs: DataFrame, path: str, code_version: str) -> DataFrame:
    """SRC-15: the rows of the asked documents that are done, with the version that made them.

    Entries of other content or code, and files that are not whole, are passed over.
    """
    spark = docs.sparkSession
    good = checked(spark, path).filter(F.col("whole") & (F.col("code_version") == code_version)).join(docs.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_semi")
    of = good.filter("file is not null").select("doc_id", F.col("file").alias("_file"), "version")
    return batches(spark, path).withColumn("_file", F.col("_metadata.file_path")).join(of, ["doc_id", "_file"]).drop("_file")
