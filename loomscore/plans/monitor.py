"""Monitoring queries on orders (tasks and runs), events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitor
from .base import ITEMS, items, query, table
from .operations import _TASKS, tasks


@query("SELECT coalesce(max(event_id), 0) AS latest_id FROM events")
def latest_id(spark, d):
    return monitor.latest_id(table(spark, d, "events"), "event_id")


@query(_TASKS + "SELECT CAST(queued_at AS DATE) AS day, status, count(*) AS n FROM tasks GROUP BY ALL")
def status_counts(spark, d):
    return monitor.status_counts(tasks(spark, d).withColumn("day", F.to_date("queued_at")), "day")


@query("SELECT user_id, map_keys(m) AS kinds, map_values(m) AS counts FROM (SELECT user_id, map_from_entries(list((event_type, n) ORDER BY event_type)) AS m FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1)")
def counts_map(spark, d):
    rows = monitor.counts_map(table(spark, d, "events"), "user_id", "event_type")
    return rows.select("user_id", F.map_keys("counts").alias("kinds"), F.map_values("counts").alias("counts"))


@query("""SELECT source, count(*) AS total, count(*) FILTER (WHERE length(trim(text, ' ')) > 0) AS with_text, count(*) FILTER (WHERE day >= DATE '2024-06-01') AS fresh, min(day) AS oldest, max(day) AS newest
    FROM (SELECT source, text, DATE '2024-01-01' + CAST(doc_id % 300 AS INT) AS day FROM documents) GROUP BY source""")
def text_counts(spark, d):
    rows = table(spark, d, "documents").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")))
    return monitor.text_counts(rows, "source", "text", "day", "2024-06-01")


_RUNS = """runs AS (SELECT o_orderkey AS run_id, o_orderdate AS started_at, CAST(o_orderkey % 13 AS BIGINT) AS claimed, CAST(least(o_orderkey % 13, o_orderkey % 4) AS BIGINT) AS failed,
    CAST(o_custkey % 3 AS BIGINT) AS skipped, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_custkey % 9000 AS BIGINT) END AS duration_ms, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'failed' ELSE 'running' END AS status FROM orders)"""


def runs(spark, d):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")
    return table(spark, d, "orders").select(
        k.alias("run_id"),
        F.col("o_orderdate").alias("started_at"),
        (k % 13).alias("claimed"),
        F.least(k % 13, k % 4).alias("failed"),
        (F.col("o_custkey") % 3).alias("skipped"),
        F.when(k % 5 > 0, F.col("o_custkey") % 9000).alias("duration_ms"),
        status.alias("status"),
    )


@query(f"""WITH {_RUNS}, r AS (SELECT * FROM runs WHERE started_at >= TIMESTAMP '1997-01-01')
SELECT count(*) AS runs, CAST(sum(claimed) AS BIGINT) AS processed, CAST(greatest(0, sum(claimed) - sum(failed)) AS BIGINT) AS succeeded, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(skipped) AS BIGINT) AS skipped,
    round(100.0 * (sum(claimed) - sum(failed)) / sum(claimed), 1)::DOUBLE AS success_rate, CAST(floor(avg(duration_ms) FILTER (WHERE duration_ms > 0)) AS BIGINT) AS avg_duration_ms FROM r""")
def run_counters(spark, d):
    return monitor.run_counters(runs(spark, d), "1997-01-01")


@query(ITEMS + """SELECT count(*) AS total, count(critic) AS with_score, count(*) FILTER (WHERE item_id % 3 = 0) AS with_summary, round(100.0 * count(*) FILTER (WHERE item_id % 3 = 0) / count(*), 1)::DOUBLE AS summary_percent,
    round(100.0 * (SELECT count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_quantity < 10 GROUP BY 1 HAVING count(*) >= 3)) / count(*), 1)::DOUBLE AS similar_percent FROM items""")
def data_quality(spark, d):
    rows = items(spark, d).select("item_id", F.col("critic").alias("score"), (F.col("item_id") % 3 == 0).alias("has_summary"))
    near = table(spark, d, "lineitem").filter("l_quantity < 10").select(F.col("l_partkey").alias("item_id"))
    return monitor.data_quality(rows, near)


@query(_TASKS + """, k(stage, queue) AS (VALUES ('load', '1-URGENT'), ('load', '2-HIGH'), ('tell', '5-LOW'), ('off', '3-MEDIUM'), ('idle', 'no such queue')),
c AS (SELECT queue, least(count(*) FILTER (WHERE status = 'queued'), 200) AS q, least(count(*) FILTER (WHERE status = 'running'), 50) AS r, 0 AS f FROM tasks GROUP BY 1),
s AS (SELECT stage, CAST(coalesce(sum(q), 0) AS BIGINT) AS queued, CAST(coalesce(sum(r), 0) AS BIGINT) AS running, CAST(coalesce(sum(f), 0) AS BIGINT) AS failed FROM k LEFT JOIN c USING (queue) GROUP BY 1)
SELECT stage, CASE WHEN stage = 'off' THEN 'disabled' WHEN failed > 0 THEN 'error' WHEN running > 0 THEN 'running' WHEN queued > 0 THEN 'queued' ELSE 'done' END AS state, queued, running, failed FROM s""")
def stage_states(spark, d):
    stages = {"load": ["1-URGENT", "2-HIGH"], "tell": ["5-LOW"], "off": ["3-MEDIUM"], "idle": ["no such queue"]}
    return monitor.stage_states(tasks(spark, d), stages, disabled=["off"])


@query("""WITH m AS (SELECT coalesce(max(event_id) FILTER (WHERE event_type = 'purchase' AND user_id % 7 = 0), -1) AS s, coalesce(max(event_id) FILTER (WHERE event_type = 'view' AND user_id % 11 = 0), -1) AS a FROM events),
t AS (SELECT count(*) AS streak FROM events, m WHERE event_type = 'error' AND event_id > s) SELECT streak, streak >= 2 AS is_open, streak >= 2 AND a <= s AS announce FROM t, m""")
def drift_alarm(spark, d):
    kind, user = F.col("event_type"), F.col("user_id")
    return monitor.drift_alarm(table(spark, d, "events"), kind == "error", (kind == "purchase") & (user % 7 == 0), (kind == "view") & (user % 11 == 0), least=2)


_NOW = "1998-08-02 01:00:00"


@query(f"""WITH {_RUNS}, f AS (SELECT (SELECT max(started_at) FROM runs WHERE status IN ('succeeded', 'partial')) AS last, (SELECT count(*) FROM runs WHERE epoch(TIMESTAMP '{_NOW}') - epoch(started_at) < 86400) AS alive,
    (SELECT count(*) FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-30') AS problems),
r AS (SELECT *, CASE WHEN last IS NULL THEN 'never_run' WHEN epoch(TIMESTAMP '{_NOW}') - epoch(last) > 100000 * 3600 THEN 'stale' WHEN alive = 0 THEN 'no_workers' WHEN problems > 0 THEN 'problems' ELSE 'none' END AS reason FROM f)
SELECT CASE WHEN reason = 'stale' THEN 'down' WHEN reason = 'none' THEN 'healthy' ELSE 'degraded' END AS status, reason, problems, alive FROM r""")
def system_health(spark, d):
    own = runs(spark, d)
    events = table(spark, d, "events")
    wrong = events.filter("event_type = 'error' AND ts >= timestamp'2024-01-30'")
    streak = monitor.drift_streak(events, F.lit(False), F.lit(True))
    return monitor.health(own, own.withColumnRenamed("started_at", "heartbeat_at"), wrong, streak, _NOW, stale_hours=100_000, alive_seconds=86400)


@query(_TASKS + "SELECT 'task' AS kind, task_id AS id FROM tasks WHERE status = 'running' ORDER BY queued_at DESC, task_id DESC LIMIT 1")
def current_job(spark, d):
    own = tasks(spark, d).withColumnRenamed("queued_at", "started_at")
    return monitor.current_job(own, runs(spark, d)).select("kind", "id")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 25")
def recent_events(spark, d):
    return monitor.recent(table(spark, d, "events"), "event_id", 25, event_type="error", user_id=None).select("event_id", "event_type")


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('error') AND ts >= TIMESTAMP '2024-01-15' AND user_id % 5 = 2")
def problem_events(spark, d):
    """Problems of one run since a time; of the test events those of type error are problems, and a run is a fifth of the users."""
    rows = table(spark, d, "events").withColumns({"level": F.col("event_type"), "run_id": F.col("user_id") % 5})
    return monitor.problems(rows, since="2024-01-15", run=2).select("event_id", "user_id")


@query("""SELECT round(coalesce(sum(CAST(round(value * 100) AS BIGINT)), 0) / 100.0::DOUBLE, 6) AS dollars, CAST(coalesce(sum(user_id), 0) AS BIGINT) AS tokens, count(*) AS n_calls
    FROM events WHERE event_type <> 'view' AND ts >= TIMESTAMP '2024-01-20'""")
def spend_window(spark, d):
    calls = table(spark, d, "events").select(F.when(F.col("event_type") != "view", "m").alias("model"), (F.round(F.col("value") * 100) / 100).alias("cost"), F.col("user_id").alias("tokens"), "ts")
    return monitor.spend(calls, "2024-01-20")


@query("""SELECT CASE WHEN s >= 10 THEN 'daily_cost' WHEN n >= 100 THEN 'hourly_calls' END AS refused FROM (SELECT sum(value) FILTER (WHERE ts >= TIMESTAMP '2024-01-20') AS s, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30 23:00:00') AS n FROM events)""")
def call_ceilings(spark, d):
    calls = table(spark, d, "events").select(F.lit("m").alias("model"), F.col("value").alias("cost"), "ts")
    return monitor.within_budget(calls, "2024-01-20", "2024-01-30 23:00:00")


@query(_TASKS + """SELECT 'tasks{queue="' || queue || '",status="' || status || '"} ' || count(*) AS line FROM tasks GROUP BY queue, status""")
def metrics_text(spark, d):
    counted = tasks(spark, d).groupBy("queue", "status").agg(F.count("*").alias("value"))
    return monitor.exposition(counted.select(F.lit("tasks").alias("name"), F.create_map(F.lit("status"), F.col("status"), F.lit("queue"), F.col("queue")).alias("labels"), "value"))


@query("SELECT event_id, 'id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: ' || coalesce(props, '') || chr(10) || chr(10) AS frame FROM events")
def event_frames(spark, d):
    return monitor.event_frames(table(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), F.col("props").alias("data")))
