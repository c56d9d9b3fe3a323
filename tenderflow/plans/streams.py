"""Queries on task events, as streams over all that is there."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..shared import shared_path
from ..streaming import lifecycle, tasks
from .registry import query, read

STATES = {"signup": "submitted", "view": "working", "click": "working", "purchase": "completed", "error": "canceled"}
STATES_SQL = "CASE event_type WHEN 'signup' THEN 'submitted' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'canceled' ELSE 'working' END"


def task_events(spark, sf_dir):
    """Events of a user as those of a task."""
    schema = read(spark, sf_dir, "events").schema
    events = tasks.source(spark, f"{sf_dir}/event[s].parquet", schema)
    state = F.element_at(F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv)), F.col("event_type"))
    return events.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), "ts", state.alias("state"))


@query(f"SELECT user_id AS task_id, arg_max({STATES_SQL}, {{'a': ts, 'b': event_id}}) AS state, count(*)::BIGINT AS n_events FROM events GROUP BY 1")
def task_latest_state(spark, sf_dir):
    """ST-1, ST-2, ST-4."""
    return tasks.run_to_table(tasks.latest_states(task_events(spark, sf_dir)), f"latest_{uuid4().hex}", "complete")


@query(f"""
WITH e AS (SELECT user_id, {{'a': ts, 'b': event_id}} AS o, {STATES_SQL} AS state FROM events), f AS (SELECT user_id, min(o) FILTER (state IN ('completed', 'canceled')) AS stop, max(o) AS last FROM e GROUP BY 1)
SELECT f.user_id AS task_id, arg_max(state, o) FILTER (o <= coalesce(stop, last)) AS state, (count(*) FILTER (o > stop))::BIGINT AS refused FROM f JOIN e USING (user_id) GROUP BY 1""")
def task_guarded_state(spark, sf_dir):
    """ST-3."""
    found = tasks.run_to_table(tasks.guarded_states(task_events(spark, sf_dir)), f"guarded_{uuid4().hex}", "update")
    return found.groupBy("task_id").agg(F.max_by("state", "refused").alias("state"), F.max("refused").alias("refused"))


@query(f"SELECT user_id AS task_id, event_id AS seq, {STATES_SQL} AS state FROM events WHERE event_type IN ('purchase', 'error') AND event_id >= 1")
def task_notifications(spark, sf_dir):
    """ST-4, ST-6: terminal events after the first offset."""
    terminal = tasks.since(task_events(spark, sf_dir)).filter(F.col("state").isin(*tasks.TERMINAL))
    return tasks.run_to_table(terminal.select("task_id", "seq", "state"), f"terminal_{uuid4().hex}", "append")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_tumbling(spark, sf_dir):
    """Extension."""
    return tasks.daily(read(spark, sf_dir, "events")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    """Extension."""
    return tasks.sessions(read(spark, sf_dir, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(f"""
WITH e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o, {STATES_SQL} AS state FROM events),
b AS (SELECT user_id, min(o) FILTER (state IN ('submitted', 'working')) AS opened FROM e GROUP BY 1),
f AS (SELECT user_id, any_value(opened) AS opened, min(o) FILTER (state = 'completed' OR state = 'canceled' AND o > opened) AS stop, max(o) AS n FROM e JOIN b USING (user_id) GROUP BY 1),
g AS (SELECT user_id, any_value(n) AS n, any_value(stop) AS stop, coalesce(arg_max(state, o) FILTER (o = stop), arg_max(state, o) FILTER (stop IS NULL AND state IN ('submitted', 'working')), '') AS state,
  (count(*) FILTER (o > stop OR state = 'canceled' AND (opened IS NULL OR o < opened) AND (stop IS NULL OR o < stop)))::BIGINT AS refused, max(ts) FILTER (stop IS NULL AND state IN ('submitted', 'working')) AS last FROM e JOIN f USING (user_id) GROUP BY 1),
h AS (SELECT *, coalesce(state IN ('submitted', 'working') AND last + INTERVAL 10 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR, false) AS gone FROM g)
SELECT user_id AS task_id, CASE WHEN gone THEN 'failed' ELSE state END AS state, refused, n::BIGINT AS n_events, CASE WHEN gone THEN 'expired' ELSE '' END AS reason FROM h""")
def task_lifecycle(spark, sf_dir):
    """ST-3, ST-7: guarded states, cancellation from open states only, tasks that stay open for ten days fail."""
    changes = lifecycle.run(lifecycle.lifecycle(task_events(spark, sf_dir), 10 * 86_400_000), "update")
    return lifecycle.snapshot(changes).select("task_id", "state", "refused", "n_events", "reason")


@query(f"""
WITH e AS (SELECT user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, {STATES_SQL} AS state FROM events),
r AS (SELECT * FROM (VALUES ('new', 0, 1), ('old', 2, 2)) v(reader, position, every)),
a AS (SELECT reader, task_id, seq, state, min(CASE WHEN state = 'completed' AND seq > position THEN seq END) OVER (PARTITION BY reader, task_id) AS stop FROM e JOIN r ON task_id % every = 0 WHERE seq > position)
SELECT reader, task_id, seq::BIGINT AS seq, state FROM a WHERE seq <= coalesce(stop, seq)""")
def task_delivery(spark, sf_dir):
    """ST-4, SNK-6: two readers, one from the third event on, of an event log that grows in two steps; the query stops between them."""
    order = Window.partitionBy("task_id").orderBy("ts", "event_id")
    state = F.element_at(F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv)), F.col("event_type"))
    log = read(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), "event_id", "ts", state.alias("state")).withColumn("seq", F.row_number().over(order).cast("long"))
    log = log.select("task_id", "seq", "state", (F.col("state") == "completed").alias("final"), (F.col("event_id") % 2).alias("step"))
    tasks_of = log.select("task_id").distinct()
    readers = tasks_of.select(F.lit("new").alias("reader"), "task_id", F.lit(0).cast("long").alias("position")).union(tasks_of.filter("task_id % 2 = 0").select(F.lit("old"), "task_id", F.lit(2).cast("long")))
    path, folder = shared_path(spark, "log"), shared_path(spark, "delivery")
    for step in (0, 1):
        log.filter(F.col("step") == step).drop("step").write.mode("append").parquet(path)
        stream = tasks.source(spark, path, log.drop("step").schema)
        found = lifecycle.run(lifecycle.deliver(stream, readers, readers), "append", folder)
    return found.select("reader", "task_id", "seq", "state")
