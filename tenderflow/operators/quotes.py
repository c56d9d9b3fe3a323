"""Which texts hold which quotes, white space aside, as a hash join.

Of each run of WINDOW q-grams the one of least hash is a text's key. A quote's key is that of its
first run, and wherever the quote stands in a text, that run stands there too, so the text has the
key. Pairs that meet at a key are then compared. Quotes come in classes by length, each with q-grams
and runs that fit its shortest, so a short quote costs a key every few bytes only where there is one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Least bytes of a quote in each class, and the bytes of its q-grams; shorter quotes are no evidence.
CLASSES = ((128, 32), (64, 32), (32, 16), (16, 8), (8, 4))
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
FIELDS = "id long, class int, key long"


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the q-grams; q is a power of two."""
    out, span = data.astype(np.uint64) + np.uint64(1), 1
    while span < q:
        out = out[:-span] * FACTORS[0] + out[span:]
        out ^= out >> np.uint64(29)
        out *= FACTORS[1]
        span *= 2
    return out ^ (out >> np.uint64(32))


def run_keys(data: np.ndarray, least: int, q: int) -> np.ndarray:
    """The least hash of each run of q-grams that `least` bytes have."""
    if len(data) < least:
        return np.zeros(0, np.uint64)
    return np.lib.stride_tricks.sliding_window_view(gram_hashes(data, q), least - q + 1).min(axis=1)


def keys_of(rows: DataFrame, classes: list[int] | None) -> DataFrame:
    """id, class and key of rows of id and data: of a text for all given classes, each key once;
    without classes of a quote, the first key of the class that it is long enough for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row_id, data in zip(batch["id"].to_pylist(), batch["data"].to_pylist()):
                found, made = np.frombuffer(data, np.uint8), []
                for k, (least, q) in enumerate(CLASSES):
                    if classes is None and len(found) >= least:
                        made = [(k, run_keys(found[:least], least, q))]
                        break
                    if classes is not None and k in classes:
                        made.append((k, np.unique(run_keys(found, least, q))))
                kinds = np.concatenate([np.zeros(0, np.int32), *(np.full(len(x), k, np.int32) for k, x in made)])
                keys = np.concatenate([np.zeros(0, np.uint64), *(x for _, x in made)])
                yield pa.RecordBatch.from_arrays([pa.array([row_id] * len(keys), pa.int64()), pa.array(kinds.astype(np.int32)), pa.array(keys.view(np.int64))], ["id", "class", "key"])

    return rows.select("id", "data").mapInArrow(run, FIELDS)


def held(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """text_id and quote_id where the text has the quote, white space aside, once each.

    Both have id and said; null is empty, and quotes under the shortest class are in no text.
    """
    dense = lambda rows: rows.select(F.col("id").cast("long").alias("id"), text.dense(F.coalesce("said", F.lit(""))).alias("dense")).withColumn("data", F.col("dense").cast("binary"))
    whole, asked = dense(texts), dense(quotes)
    asked_keys = keys_of(asked, None)
    classes = [r["class"] for r in asked_keys.select("class").distinct().collect()]  # as many as CLASSES at most
    met = keys_of(whole, classes).join(asked_keys.withColumnRenamed("id", "quote_id"), ["class", "key"]).select(F.col("id").alias("text_id"), "quote_id").distinct()
    both = met.join(whole.select(F.col("id").alias("text_id"), F.col("dense").alias("dense_text")), "text_id").join(asked.select(F.col("id").alias("quote_id"), F.col("dense").alias("dense_quote")), "quote_id")
    return both.filter(F.contains("dense_text", F.col("dense_quote"))).select("text_id", "quote_id", F.instr("dense_text", F.col("dense_quote")).alias("dense_at"))
