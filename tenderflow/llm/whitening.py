"""Embedding whitening by principal components.

Entries become whole numbers first, so the count and the sums of the fit are exact and rows can be
centred exactly: with n vectors of sums S, n * x - S is a whole number, and its n-th part is rounded
once. A RowMatrix of the centred rows gives the Gramian, tree-aggregated by Spark; divided by n it
is the covariance, whose d * d numbers are all that reaches the driver. Its eigenvectors, each over
the root of its eigenvalue, are broadcast (k * d numbers) and applied in mapInPandas. The identity
error is measured on the whitened rows, by a RowMatrix of their own.

Edge cases: vectors that are null or empty, hold null or non-finite entries or entries of 2^31 or
more, or are not of the most frequent length take no part; components without variance have
explained 0 and whitened null and are left out of the identity error; repeated rows and null ids
are rows like any other; with fewer dimensions than k there are as many components; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .vectors import stacked, usable

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0**31
FIELDS = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums = n * whole + rest; components by falling variance, one a row, over the
    root of their variance; explained is each one's part of all variance."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    explained: list[float]


def whole_numbers(rows: DataFrame, key: str, value: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """The key and x, array<long>: floor(scale * entry) + shift of each vector that takes part."""
    good = usable(rows, key, value, LARGEST)
    return good.select(key, F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("long") + shift).alias("x"))


def sums(points: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and their exact sums, one partial row a task and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = batch["x"].flatten().to_numpy().reshape(batch.num_rows, -1)
                part = x.sum(axis=0).astype(object)
                n, total = n + batch.num_rows, part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array(list(map(Decimal, total)), pa.decimal128(28, 0))], ["at", "n", "part"])

    parts = points.select("x").mapInArrow(run, "at int, n long, part decimal(28,0)")
    found = sorted(parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).collect())
    return (found[0].n, [int(r.total) for r in found]) if found else (0, [])


def gramian(rows: DataFrame, value: Column) -> np.ndarray:
    """The sum of the outer products of the rows' arrays."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(value).alias("vector")), "vector")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def fit(points: DataFrame, k: int = COMPONENTS) -> Whitening:
    n, total = sums(points)
    if not n:
        return Whitening(0, np.zeros(0), np.zeros(0), np.zeros((0, 0)), [])
    whole, rest = (np.array(x, np.int64) for x in zip(*(divmod(s, n) for s in total)))
    middle = F.array(*(F.struct(F.lit(int(q)).cast("long").alias("q"), F.lit(int(r)).cast("long").alias("r")) for q, r in zip(whole, rest)))
    centred = F.zip_with("x", middle, lambda x, m: (n * (x - m["q"]) - m["r"]).cast("double") / n)
    covariance = gramian(points, centred) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:k], vectors.T[::-1][:k]
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
    trace = covariance.trace()
    real = values > len(total) * np.finfo(float).eps * max(values[0], 0)
    scaled = np.where(real[:, None], vectors, np.nan) / np.sqrt(np.where(real, values, 1))[:, None]
    return Whitening(n, whole, rest, scaled, [float(e / trace) if r else 0.0 for e, r in zip(values, real)])


def squared(deviations: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    if np.abs(deviations).max(initial=0) < 2.0**31 / deviations.shape[1] ** 0.5:
        return (deviations**2).sum(axis=1).tolist()
    return (deviations.astype(object) ** 2).sum(axis=1).tolist()


def project(points: DataFrame, key: str, model: Whitening) -> DataFrame:
    """The key, deviation and w, the whitened components of every point."""
    held = points.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        for frame in frames:
            if not len(frame):
                continue
            apart = stacked(frame["x"]) - model.whole
            exact = np.abs(apart).max() < 2**62 // model.n
            moved = model.n * (apart if exact else apart.astype(object)) - model.rest
            made = (moved / model.n).astype(np.float64) @ model.components.T
            yield pd.DataFrame({key: frame[key], "deviation": [Decimal(s) for s in squared(moved if exact else moved)], "w": list(made)})

    return points.mapInPandas(run, f"{key} long, deviation decimal(38,0), w array<double>")


def identity_error(made: DataFrame, model: Whitening) -> float | None:
    """The largest entry, sign aside, of the covariance of w less the identity."""
    kept = [i for i, e in enumerate(model.explained) if e > 0]
    if not kept:
        return None
    means = made.agg(*(F.avg(F.get("w", F.lit(i))) for i in kept)).first()
    centred = F.array(*(F.get("w", F.lit(i)) - mean for i, mean in zip(kept, means)))
    return float(np.abs(gramian(made, centred) / model.n - np.eye(len(kept))).max())


def whiten(rows: DataFrame, key: str = "vec_id", value: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each
    vector and component."""
    points = whole_numbers(rows, key, value)
    model = fit(points, k)
    if not model.n:
        return rows.sparkSession.createDataFrame([], FIELDS)
    made = materialise(project(points, key, model))
    error = identity_error(made, model)
    return made.select(F.col(key).alias("vec_id"), "deviation", F.posexplode("w").alias("at", "value")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.when(~F.isnan("value"), F.col("value")).alias("whitened"),
        F.get(F.array(*map(F.lit, model.explained)), F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))
