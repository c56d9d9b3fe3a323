"""Tables of vectors: which rows take part, and their numbers as arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, key: str, value: str, below: float = float("inf")) -> DataFrame:
    """key as long and v, the vectors without null, NaN, infinite or larger entries, in their own
    type. Vectors must agree in length: the most frequent one counts, of several the longest."""
    held = F.forall(value, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < below))
    good = rows.select(F.col(key).cast("long").alias(key), F.col(value).alias("v")).filter(held & (F.size("v") > 0))
    lengths = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return good.filter(F.size("v") == (lengths[0].d if lengths else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column whose lists are equally long, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def listed(rows: np.ndarray) -> pa.Array:
    """A list column of the rows of a matrix."""
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64())) if rows.size else pa.array([[]] * len(rows), pa.list_(pa.float64()))
