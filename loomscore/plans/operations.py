"""Operational, merge and versioning queries on orders, events and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge, monitor, ops
from .base import query, table

NOW = "2001-08-02"

_TASKS = """WITH tasks AS (SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'succeeded' END AS status,
    o_orderpriority AS queue, o_orderkey % 4 AS priority, CAST(o_orderkey % 5 AS INT) AS attempts, o_orderdate AS queued_at,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 10 DAY END AS next_retry_at, o_orderdate + INTERVAL 5 DAY AS lease_expires_at, o_custkey % 600 AS duration FROM orders)
"""


def tasks(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded")
    return o.select(
        F.col("o_orderkey").alias("task_id"),
        status.alias("status"),
        F.col("o_orderpriority").alias("queue"),
        (F.col("o_orderkey") % 4).alias("priority"),
        (F.col("o_orderkey") % 5).cast("int").alias("attempts"),
        F.col("o_orderdate").alias("queued_at"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate") + F.expr("INTERVAL 10 DAY")).alias("next_retry_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 5 DAY")).alias("lease_expires_at"),
        (F.col("o_custkey") % 600).alias("duration"),
    )


@query(_TASKS + "SELECT queue, status, count(*) AS n, strftime(min(queued_at), '%Y-%m-%d') AS oldest FROM tasks GROUP BY ALL")
def queue_depth(spark, d):
    return ops.queue_depth(tasks(spark, d)).withColumn("oldest", F.date_format("oldest", "yyyy-MM-dd"))


@query(_TASKS + """SELECT queue, list_extract(l, CAST(len(l) // 2 AS BIGINT) + 1) AS p50, list_extract(l, least(len(l) - 1, CAST(floor(len(l) * 0.95) AS BIGINT)) + 1) AS p95
    FROM (SELECT queue, list_sort(list(duration)) AS l FROM tasks GROUP BY queue)""")
def duration_percentiles(spark, d):
    return ops.indexed_percentiles(tasks(spark, d), "queue", "duration")


@query(_TASKS + f"""SELECT queue, task_id FROM tasks WHERE status IN ('queued', 'retrying') AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '{NOW}')
    QUALIFY row_number() OVER (PARTITION BY queue ORDER BY priority DESC, queued_at, task_id) = 1""")
def claim_next(spark, d):
    return ops.claim_next(tasks(spark, d), NOW).select("queue", "task_id")


@query(_TASKS + """SELECT task_id, CASE WHEN status = 'running' AND lease_expires_at < TIMESTAMP '1999-01-01' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE status END AS status FROM tasks""")
def reap_leases(spark, d):
    return ops.reap(tasks(spark, d), "1999-01-01").select("task_id", "status")


@query("""WITH r AS (SELECT user_id, max(event_id) AS reset_id FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT e.user_id, count(*) FILTER (WHERE event_id > coalesce(reset_id, -1)) AS streak FROM events e LEFT JOIN r USING (user_id) WHERE event_type = 'error' GROUP BY 1""")
def streak_since_reset(spark, d):
    return ops.streaks(table(spark, d, "events"), F.col("event_type") == "error", F.col("event_type") == "purchase")


@query("""SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS spent_cents, count(*) OVER w AS n_calls FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)""")
def spend_24h(spark, d):
    return ops.rolling(table(spark, d, "events"), 86400).select("event_id", "spent_cents", "n_calls")


@query("""SELECT CAST(ts AS DATE) AS day, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'error') AS n_errors, count(DISTINCT user_id) AS n_users,
    round(100.0 * count(*) FILTER (WHERE event_type <> 'error') / count(*), 1) AS success_percent FROM events GROUP BY 1""")
def counters_24h(spark, d):
    error = F.count_if(F.col("event_type") == "error")
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n_events"),
        error.alias("n_errors"),
        F.countDistinct("user_id").alias("n_users"),
        F.round(100.0 * (F.count("*") - error) / F.count("*"), 1).alias("success_percent"),
    )


_HEALTH = "CASE WHEN n_err >= 10 THEN 'drift' WHEN n = 0 THEN 'none' WHEN last_seen < TIMESTAMP '2024-01-30 20:00:00' THEN 'stale' WHEN n_err > 2 THEN 'problems' ELSE 'ok' END"


@query(f"SELECT user_id, {_HEALTH} AS state FROM (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_err, max(ts) AS last_seen FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1)")
def health_state(spark, d):
    recent = table(spark, d, "events").filter("ts >= timestamp'2024-01-24'")
    seen = recent.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_err"), F.max("ts").alias("last_seen"))
    return seen.select("user_id", F.expr(_HEALTH).alias("state"))


@query("SELECT user_id, CASE WHEN epoch(TIMESTAMP '2024-01-31') - floor(epoch(max(ts))) < 86400 THEN 'alive' ELSE 'gone' END AS state FROM events GROUP BY 1")
def heartbeat_liveness(spark, d):
    return ops.liveness(table(spark, d, "events"), "user_id", "ts", "2024-01-31", 86400).select("user_id", "state")


@query("SELECT event_id, event_type, user_id FROM events WHERE event_id > 200 ORDER BY event_id LIMIT 200")
def events_after_cursor(spark, d):
    return monitor.events_after(table(spark, d, "events"), 200, backlog=10**9).select("event_id", "event_type", "user_id")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND event_id > (SELECT CASE WHEN max(event_id) > 5000 THEN max(event_id) ELSE 0 END FROM events) ORDER BY event_id LIMIT 200")
def events_after_backlog(spark, d):
    """From the start, of one kind: a table of over 5,000 events is too far ahead, so nothing is replayed."""
    return monitor.events_after(table(spark, d, "events"), 0, backlog=5000, event_type="click").select("event_id")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def last_state(spark, d):
    """The latest event of each user, by an aggregate rather than a window."""
    last = table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("event_id", "event_type")).alias("x"))
    return last.select("user_id", "x.event_type", "x.event_id")


@query("SELECT doc_id FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone, sum(n_chars) OVER () AS total FROM documents) WHERE total > 500000 AND total - coalesce(gone, 0) > 400000")
def lru_evict(spark, d):
    """Documents, taken as files last used in the order of falling length, beyond a budget of 500,000 characters."""
    files = table(spark, d, "documents").select("doc_id", "n_chars", (-F.col("n_chars")).alias("used"))
    return ops.evict(files, "n_chars", "used", "doc_id", 500_000).select("doc_id")


_DELTA = "delta AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey + 10000000, o_orderstatus, o_custkey FROM orders WHERE o_orderkey % 7 = 0)"


def _delta(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus")
    cust = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("o_custkey")
    known = o.filter("o_orderkey % 2 = 0").select("o_orderkey", status, cust)
    return known.union(o.filter("o_orderkey % 7 = 0").select(F.col("o_orderkey") + 10_000_000, "o_orderstatus", "o_custkey"))


@query(f"""WITH {_DELTA} SELECT d.o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'inserted' WHEN d.o_orderstatus IS DISTINCT FROM o.o_orderstatus OR d.o_custkey IS DISTINCT FROM o.o_custkey
    THEN 'updated' ELSE 'unchanged' END AS action FROM delta d LEFT JOIN orders o ON d.o_orderkey = o.o_orderkey""")
def upsert_classify(spark, d):
    return merge.classify(table(spark, d, "orders"), _delta(spark, d), ["o_orderkey"], ["o_orderstatus", "o_custkey"]).select("o_orderkey", "action")


@query(f"WITH {_DELTA} SELECT o_orderkey, o_custkey FROM delta WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def insert_ignore(spark, d):
    return merge.insert_ignore(table(spark, d, "orders"), _delta(spark, d), ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query(f"""WITH {_DELTA} SELECT coalesce(o.o_orderkey, d.o_orderkey) AS o_orderkey, CASE WHEN d.o_orderkey IS NOT NULL THEN d.o_orderstatus ELSE o.o_orderstatus END AS o_orderstatus,
    CASE WHEN o.o_orderkey IS NOT NULL THEN o.o_custkey ELSE d.o_custkey END AS o_custkey FROM orders o FULL JOIN delta d ON o.o_orderkey = d.o_orderkey""")
def upsert_merge(spark, d):
    target = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return merge.upsert(target, _delta(spark, d), ["o_orderkey"], ["o_orderstatus"])


@query(f"""WITH {_DELTA} SELECT d.o_orderkey, o.o_custkey AS before, d.o_custkey AS after FROM delta d LEFT JOIN orders o ON d.o_orderkey = o.o_orderkey
    WHERE CASE WHEN o.o_orderkey IS NOT NULL THEN o.o_custkey IS DISTINCT FROM d.o_custkey ELSE d.o_custkey IS NOT NULL END""")
def scores_moved(spark, d):
    return merge.moved(table(spark, d, "orders"), _delta(spark, d), "o_orderkey", "o_custkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber = coalesce(min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) OVER w, min(l_linenumber) OVER w) AS lead FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def single_lead(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_returnflag") == "R").alias("lead"))
    return merge.single_lead(rows, "l_orderkey", "lead", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) > 10")
def prune_history(spark, d):
    rows = table(spark, d, "orders").withColumn("current", F.col("o_orderstatus") == "O")
    return merge.prune(rows, "o_custkey", "o_orderkey", 10, "current").select("o_orderkey")


@query("""SELECT 'insert' AS change, l_partkey, l_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'A') EXCEPT SELECT 'insert', l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R'
UNION ALL (SELECT 'delete', l_partkey, l_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R') EXCEPT SELECT 'delete', l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'A')""")
def link_sync(spark, d):
    rows = table(spark, d, "lineitem")
    keys = ["l_partkey", "l_suppkey"]
    return merge.link_changes(rows.filter("l_returnflag <> 'R'").select(*keys), rows.filter("l_returnflag <> 'A'").select(*keys), keys)


@query("""SELECT n_nationkey AS channel_id, a.audience FROM nation, (VALUES ('critic'), ('user')) a(audience)
    WHERE (n_nationkey, a.audience) NOT IN (SELECT s_nationkey, 'user' FROM supplier)""")
def task_fanout(spark, d):
    """Each channel for each audience, but for what is queued already; the audiences are an array of two, so nothing is joined."""
    wanted = table(spark, d, "nation").select(F.col("n_nationkey").alias("channel_id"), F.explode(F.array(F.lit("critic"), F.lit("user"))).alias("audience"))
    queued = table(spark, d, "supplier").select(F.col("s_nationkey").alias("channel_id"), F.lit("user").alias("audience"))
    return wanted.join(queued, ["channel_id", "audience"], "left_anti")


@query("SELECT window_start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type FROM events) GROUP BY ALL")
def tumbling_counts(spark, d):
    rows = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
SELECT user_id, min(ts) AS started, count(*) AS n FROM g GROUP BY user_id, k""")
def sessions(spark, d):
    rows = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.min("ts").alias("started"), F.count("*").alias("n"))
    return rows.select("user_id", "started", "n")
