"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back, which cuts its lineage.

    Lost executors then cost a reread of files, not a recomputation, and a frame that
    several jobs use is computed once.
    """
    spark = df.sparkSession
    path = shared_path(spark, "tenderflow")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tenderflow_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised frame that nothing reads any more."""
    path = getattr(df, "_tenderflow_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Arrow batches of at most n rows for what is planned inside: rows of whole texts are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some rows, which bounds what a task makes of them at once; what Arrow
    keeps for later goes back at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: An id filter has ID_RATE bits a key, so it lets one other key in about ID_RATE through; its bytes are
#: an eighth of MOST_ID_BITS at most (32 MB), beyond which it lets more through.
ID_RATE = 16
LEAST_ID_BITS, MOST_ID_BITS = 1 << 20, 1 << 28


def id_bitmap(rows: DataFrame, key: str) -> np.ndarray:
    """Bits of hashed keys, as many as the number of rows asks for. They are gathered in Spark, 64 a
    row, so at most MOST_ID_BITS / 64 rows reach the driver, however many keys there are."""
    size = max(LEAST_ID_BITS, min(MOST_ID_BITS, 1 << (ID_RATE * rows.count()).bit_length()))
    bit = F.pmod(F.xxhash64(key), F.lit(size).cast("long"))
    slots = rows.select(bit.alias("bit")).groupBy(F.expr("cast(bit div 64 as int)").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, "<i8")
    out[slots["slot"].to_numpy()] = slots["bits"].to_numpy()
    return out.view(np.uint8)


def in_bitmap(spark: SparkSession, key: str, bitmap: np.ndarray) -> Column:
    """Whether the bitmap may hold the key; false for a null key."""
    held = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def found(bits: pd.Series) -> pd.Series:
        bit = bits.to_numpy(np.int64)
        return pd.Series((held.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0)

    return F.col(key).isNotNull() & found(F.pmod(F.xxhash64(key), F.lit(8 * len(bitmap)).cast("long")))


def split_by_ids(docs: DataFrame, key: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs whose key may be among the rows' keys, and docs whose key surely is not.

    So a join of large rows with few ids moves only the rows that it may concern.
    """
    may = in_bitmap(docs.sparkSession, key, id_bitmap(rows, key))
    return docs.filter(may), docs.filter(~may)
