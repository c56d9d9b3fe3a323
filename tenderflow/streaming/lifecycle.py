"""Task streams with state: guarded states that expire, and delivery of events by position.

Both keep a little state a key in the state store (RocksDB, with its checkpoint in the shared folder), so
a query that stops goes on where it was, and both take a start state from a stored snapshot.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shared import shared_path
from .tasks import OPEN, TERMINAL

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STATES = "task_id long, state string, refused long, n_events long, reason string, final boolean"
DELIVERED = "reader string, task_id long, seq long, state string, final boolean"


class Lifecycle(StatefulProcessor):
    """A task's state: what comes after a terminal state is refused, and a cancellation counts from an
    open state only. A task that stays open for `patience` of event time fails."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("task", "state string, refused long, n_events long, deadline long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, refused, seen, deadline = self.held.get() or ("", 0, 0, 0)
        before = deadline
        for r in pd.concat(list(rows)).sort_values(["ms", "seq"]).itertuples():
            seen += 1
            if state in TERMINAL or r.state == "canceled" and state not in OPEN:
                refused += 1
            else:
                state = r.state
                deadline = 0 if state in TERMINAL else int(r.ms) + self.patience
        if deadline != before:
            if before:
                self.handle.deleteTimer(before)
            if deadline:
                self.handle.registerTimer(deadline)
        self.held.update((state, refused, seen, deadline))
        yield self._told(key, state, refused, seen, "")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, refused, seen, deadline = self.held.get()
        if state in OPEN and deadline == expiredTimerInfo.getExpiryTimeInMs():
            self.held.update(("failed", refused, seen, 0))
            yield self._told(key, "failed", refused, seen, "expired")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = initialState.iloc[0]
        deadline = 0 if r["state"] in TERMINAL or pd.isna(r["ms"]) else int(r["ms"]) + self.patience
        if deadline:
            self.handle.registerTimer(deadline)
        self.held.update((r["state"], int(r["refused"]), int(r["n_events"]), deadline))

    def close(self) -> None:
        pass

    @staticmethod
    def _told(key, state: str, refused: int, seen: int, reason: str) -> pd.DataFrame:
        return pd.DataFrame({"task_id": [key[0]], "state": [state], "refused": [refused], "n_events": [seen], "reason": [reason], "final": [state in TERMINAL]})


def lifecycle(events: DataFrame, patience_ms: int, delay: str = "1 hour", start: DataFrame | None = None) -> DataFrame:
    """ST-3, ST-7: task_id, state, refused, n_events, reason and final, a row for each change.

    events is a stream of task_id, seq, ts and state; start, a snapshot, has task_id, state, refused,
    n_events and ts of the last event. Within a batch events count in the order of ts and seq.
    """
    time = F.col("ts").cast("timestamp")
    ms = F.unix_millis(time).alias("ms")
    marked = events.select("task_id", "seq", time.alias("ts"), ms, "state").withWatermark("ts", delay)
    begun = None if start is None else start.select("task_id", "state", "refused", "n_events", ms).groupBy("task_id")
    return marked.groupBy("task_id").transformWithStateInPandas(Lifecycle(patience_ms), STATES, "update", "EventTime", initialState=begun)


def snapshot(changes: DataFrame) -> DataFrame:
    """The last state of each task among its changes; expiry comes after all events it follows."""
    last = F.max_by(F.struct("state", "refused", "n_events", "reason", "final"), F.struct("n_events", F.col("reason") != ""))
    return changes.groupBy("task_id").agg(last.alias("s")).select("task_id", "s.*")


#: So many numbers of a task in a row share an entry of the events that wait.
BLOCK = 256


class Delivery(StatefulProcessor):
    """The events of a task for one reader, each once, in the order of seq without gaps, up to the
    final one. Events that come before those they follow wait, those of a block of numbers in one
    entry: the state store is asked once a block, not once an event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "position long, ended boolean")
        self.waiting = handle.getMapState("waiting", "block long", "seqs array<long>, states array<string>, finals array<boolean>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        position, ended = self.place.get() or (0, False)
        if ended:
            return
        stored, blocks = set(), {}

        def block(seq: int) -> dict:
            n = seq // BLOCK
            if n not in blocks:
                held = self.waiting.getValue((n,)) if self.waiting.containsKey((n,)) else None
                if held:
                    stored.add(n)
                blocks[n] = {s: (state, final) for s, state, final in zip(*held)} if held else {}
            return blocks[n]

        for part in rows:
            for seq, state, final in zip(part["seq"].tolist(), part["state"].tolist(), part["final"].tolist()):
                if seq > position:
                    block(seq)[seq] = (state, bool(final))
        out = []
        # What waits never has the next number, so nothing can go out unless its block was met above.
        while not ended and (position + 1) // BLOCK in blocks and position + 1 in blocks[(position + 1) // BLOCK]:
            position += 1
            state, ended = block(position).pop(position)
            out.append((position, state, ended))
            if not ended:
                block(position + 1)
        if ended:
            self.waiting.clear()
        else:
            for n, held in blocks.items():
                if held:
                    self.waiting.updateValue((n,), ([*held], [state for state, _ in held.values()], [final for _, final in held.values()]))
                elif n in stored:
                    self.waiting.removeKey((n,))
        if out:
            self.place.update((position, bool(ended)))
            seqs, states, finals = zip(*out)
            yield pd.DataFrame({"reader": [key[0]] * len(out), "task_id": [key[1]] * len(out), "seq": seqs, "state": states, "final": finals})

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.place.update((int(initialState["position"].iloc[0]), False))

    def close(self) -> None:
        pass


def deliver(events: DataFrame, subscriptions: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """ST-4, SNK-6: reader, task_id, seq, state and final of what each reader has not had yet.

    events is a stream of task_id, seq (from 1, without gaps in the end), state and final; repeats
    are dropped. subscriptions has reader and task_id; positions, where readers begin, has
    reader, task_id and position, the last event they had.
    """
    asked = events.join(subscriptions.select("reader", "task_id"), "task_id").select("reader", "task_id", "seq", "state", "final")
    begun = None if positions is None else positions.select("reader", "task_id", "position").groupBy("reader", "task_id")
    return asked.groupBy("reader", "task_id").transformWithStateInPandas(Delivery(), DELIVERED, "append", "None", initialState=begun)


def with_artifacts(events: DataFrame, artifacts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """ST-5: events with the artifact that they name, where it comes within `delay` of them.

    events has task_id, seq, ts, artifact_id and more, artifacts task_id, artifact_id, made and
    content; repeats of either within the watermark are dropped. Events without one pass with null.
    """
    told = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["task_id", "seq"])
    made = artifacts.select(F.col("task_id").alias("_task"), F.col("artifact_id").alias("_artifact"), F.col("made").cast("timestamp").alias("made"), "content").withWatermark("made", delay).dropDuplicatesWithinWatermark(["_task", "_artifact"])
    near = (F.col("task_id") == F.col("_task")) & (F.col("artifact_id") == F.col("_artifact")) & (F.col("made") >= F.col("ts") - F.expr(f"interval {delay}")) & (F.col("made") <= F.col("ts") + F.expr(f"interval {delay}"))
    return told.join(made, near, "leftOuter").drop("_task", "_artifact", "made")


def run(frame: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """Run a stream over all that is there now, with its checkpoint and rows in `folder`, by default a
    new one; run it with the same folder again and it goes on. The rows of all runs."""
    spark: SparkSession = frame.sparkSession
    folder = folder or shared_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        started = frame.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE[0], before)
    started.awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{folder}/rows").select(*frame.columns)
