"""Streams with state: guards, expiry, start states, restarts, delivery by position, artifacts."""

import random
from datetime import datetime, timedelta

import pandas as pd

from tenderflow.streaming import lifecycle, tasks

BEGIN = datetime(2026, 1, 1)
EVENT = "task_id long, seq long, ts timestamp, state string, final boolean"
DAY_MS = 86_400_000


def at(hours):
    return BEGIN + timedelta(hours=hours)


def log(spark, path, rows, schema=EVENT):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def source(spark, path, schema=EVENT):
    return tasks.source(spark, str(path), spark.createDataFrame([], schema).schema, 1)


def states(spark, path, folder, **how):
    changes = lifecycle.run(lifecycle.lifecycle(source(spark, path), DAY_MS, **how), "update", str(folder))
    return {r.task_id: (r.state, r.refused, r.n_events, r.reason) for r in lifecycle.snapshot(changes).collect()}


FIRST = [(1, 1, at(0), "submitted", False), (1, 2, at(1), "working", False), (2, 1, at(0), "canceled", True), (3, 1, at(0), "submitted", False)]
SECOND = [(1, 3, at(2), "completed", True), (1, 4, at(3), "canceled", True), (2, 2, at(2), "submitted", False), (2, 3, at(3), "canceled", True), (2, 4, at(4), "working", False)]
LAST = [(9, 1, at(90), "submitted", False)]
WANT = {1: ("completed", 1, 4, ""), 2: ("canceled", 2, 4, ""), 3: ("failed", 0, 1, "expired"), 9: ("submitted", 0, 1, "")}


def test_a_restart_gives_the_same_states(spark, tmp_path):
    for rows in (FIRST, SECOND, LAST):
        log(spark, tmp_path / "events", rows)
    assert states(spark, tmp_path / "events", tmp_path / "once") == WANT
    seen = {}
    for rows in (FIRST, SECOND, LAST):  # the query ends after each batch and begins anew
        log(spark, tmp_path / "slow", rows)
        seen = states(spark, tmp_path / "slow", tmp_path / "often")
    assert seen == WANT


def test_a_start_state_counts(spark, tmp_path):
    start = spark.createDataFrame([(1, "completed", 5, 9, at(0)), (2, "working", 0, 3, at(0)), (3, "submitted", 1, 4, at(0))], "task_id long, state string, refused long, n_events long, ts timestamp")
    log(spark, tmp_path / "events", [(1, 10, at(1), "working", False), (2, 4, at(1), "canceled", True)])
    log(spark, tmp_path / "events", LAST)
    got = states(spark, tmp_path / "events", tmp_path / "run", start=start)
    assert got == {1: ("completed", 6, 10, ""), 2: ("canceled", 0, 4, ""), 3: ("failed", 1, 4, "expired"), 9: ("submitted", 0, 1, "")}


def test_readers_go_on_where_they_stopped(spark, tmp_path):
    rng = random.Random(1)
    every = [(t, s, at(s), "completed" if s == 12 else "working", s == 12) for t in (1, 2) for s in range(1, 15)]
    parts = [every[:5] + every[16:22], every[3:16], [e for e in every if e not in every[:16]]]
    subscribed = spark.createDataFrame([("ann", 1), ("ann", 2), ("bob", 2)], "reader string, task_id long")
    positions = spark.createDataFrame([("bob", 2, 6)], "reader string, task_id long, position long")
    seen = []
    for part in parts:
        rng.shuffle(part)
        log(spark, tmp_path / "events", part)
        frame = lifecycle.deliver(source(spark, tmp_path / "events"), subscribed, positions)
        rows = lifecycle.run(frame, "append", str(tmp_path / "run")).collect()
        seen.append({k: sorted(r.seq for r in rows if (r.reader, r.task_id) == k) for k in (("ann", 1), ("ann", 2), ("bob", 2))})
    assert seen[0] == {("ann", 1): [*range(1, 6)], ("ann", 2): [], ("bob", 2): [7, 8]}
    assert seen[-1] == {("ann", 1): [*range(1, 13)], ("ann", 2): [*range(1, 13)], ("bob", 2): [*range(7, 13)]}
    assert all(set(a[k]) <= set(b[k]) for a, b in zip(seen, seen[1:]) for k in a)


def test_artifacts_meet_their_events_once(spark, tmp_path):
    told, made = "task_id long, seq long, ts timestamp, artifact_id string", "task_id long, artifact_id string, made timestamp, content string"
    log(spark, tmp_path / "events", [(1, 1, at(0), "a"), (1, 1, at(0), "a"), (1, 2, at(0.1), None), (1, 3, at(0.2), "late"), (2, 1, at(0), "a")], told)
    log(spark, tmp_path / "made", [(1, "a", at(0.5), "x"), (1, "a", at(0.5), "x"), (1, "late", at(3), "y")], made)
    for hours in (50, 60):
        log(spark, tmp_path / "events", [(7, hours, at(hours), None)], told)
        log(spark, tmp_path / "made", [(7, str(hours), at(hours), "z")], made)
    rows = lifecycle.run(lifecycle.with_artifacts(source(spark, tmp_path / "events", told), source(spark, tmp_path / "made", made)), "append", str(tmp_path / "run")).collect()
    assert sorted((r.task_id, r.seq, r.content) for r in rows if r.task_id < 7) == [(1, 1, "x"), (1, 2, None), (1, 3, None), (2, 1, None)]


class Store:
    """A value and a map state that count how often they are asked."""

    def __init__(self):
        self.held, self.asked = {}, 0

    def getValueState(self, name, *schemas):
        return self

    getMapState = getValueState

    def call(self, do):
        self.asked += 1
        return do()

    def get(self):
        return self.call(lambda: self.held.get("place"))

    def update(self, value):
        return self.call(lambda: self.held.update(place=value))

    def containsKey(self, key):
        return self.call(lambda: key in self.held)

    def getValue(self, key):
        return self.call(lambda: self.held[key])

    def updateValue(self, key, value):
        return self.call(lambda: self.held.update({key: value}))

    def removeKey(self, key):
        return self.call(lambda: self.held.pop(key, None))

    def clear(self):
        return self.call(lambda: [self.held.pop(k) for k in [*self.held] if k != "place"])


def test_waiting_events_share_entries(spark):
    store, delivery, parts = Store(), lifecycle.Delivery(), [[*range(2, 2001, 2)], [*range(1, 1900, 2)], [*range(1901, 2001, 2)]]
    delivery.init(store)
    got, most = [], 0
    for part in parts:
        before = store.asked
        rows = pd.DataFrame({"seq": part, "state": "working", "final": [s == 1999 for s in part]})
        got += [s for out in delivery.handleInputRows(("ann", 1), iter([rows]), None) for s in out["seq"]]
        most = max(most, store.asked - before)
    assert got == [*range(1, 2000)] and set(store.held) == {"place"}
    assert most <= 40
