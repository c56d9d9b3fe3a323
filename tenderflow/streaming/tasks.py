"""Task events as streams: latest states, guarded transitions, notifications.

An event has task_id, seq, ts, kind, state and final. States go from submitted and working to
completed, failed or canceled, and stay there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shared import shared_path

TERMINAL = ("completed", "failed", "canceled")
OPEN = ("submitted", "working")


def source(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """ST-1, ST-7: an append-only folder of Parquet files of events; the checkpoint of a query
    holds what was read, so a restart goes on there."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest_states(events: DataFrame) -> DataFrame:
    """ST-2: the last state of each task and the number of its events."""
    return events.groupBy("task_id").agg(F.max_by("state", F.struct("ts", "seq")).alias("state"), F.count(F.lit(1)).alias("n_events"))


def _advance(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    state, refused = held.get if held.exists else ("", 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
    for wanted in rows["state"]:
        if state in TERMINAL:
            refused += 1
        else:
            state = wanted
    held.update((state, refused))
    yield pd.DataFrame({"task_id": [key[0]], "state": [state], "refused": [refused]})


def guarded_states(events: DataFrame) -> DataFrame:
    """ST-3: states with transitions guarded: what comes after a terminal state is refused."""
    return events.groupBy("task_id").applyInPandasWithState(_advance, "task_id long, state string, refused long", "state string, refused long", "update", GroupStateTimeout.NoTimeout)


def since(events: DataFrame, seq: int = 1) -> DataFrame:
    """ST-4, SNK-6: events from an offset on; what came before is skipped."""
    return events.filter(F.col("seq") >= seq)


def with_artifacts(states: DataFrame, artifacts: DataFrame) -> DataFrame:
    """ST-5: state changes and artifacts as one stream of events."""
    return states.withColumn("kind", F.lit("status-update")).unionByName(artifacts.withColumn("kind", F.lit("artifact-update")), True)


def notify(events: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str):
    """ST-6, SNK-5: hand each batch of terminal events to `send`, at least once."""
    return events.filter(F.col("state").isin(*TERMINAL)).writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(frame: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over all that is there now, each batch to files in the shared folder; a batch
    that is run again replaces its files. In complete mode the last batch is the result."""
    spark, folder = frame.sparkSession, shared_path(frame.sparkSession, name)
    rows = f"{folder}/rows"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/batch={number}")

    spark.createDataFrame([], frame.schema).write.parquet(f"{rows}/batch=-1")
    started = frame.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    found = spark.read.parquet(rows)
    if mode == "complete":
        found = found.filter(F.col("batch") == found.agg(F.max("batch")).first()[0])
    return found.select(*frame.columns)


def daily(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Extension: events and value by type and day; late rows wait for the watermark."""
    marked = events.withWatermark("ts", delay) if events.isStreaming else events
    return marked.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Extension: sessions of each user."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
