"""Job, run and crawl queries on orders, lineitem, events and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs, schedule
from .base import query, table
from .monitor import _RUNS, runs

NOW = "1998-08-10 12:00:00"

_OWN = """own AS (SELECT o_orderkey AS task_id, CASE WHEN o_orderstatus = 'F' THEN 'queued' ELSE 'running' END AS status, CAST(o_orderkey % 5 AS INT) AS attempts, CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 ELSE 1 END AS max_attempts,
    o_orderdate AS started_at FROM orders),
outcome AS (SELECT o_orderkey AS task_id, CASE o_orderkey % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'skipped' ELSE 'failed' END AS outcome, o_custkey % 3 > 0 AS retryable, CASE WHEN o_orderkey % 7 = 0 THEN 90 END AS retry_after_s FROM orders WHERE o_orderkey % 6 <> 5)"""


@query(f"""WITH {_OWN}, j AS (SELECT *, status = 'running' AND outcome IS NOT NULL AS ended FROM own LEFT JOIN outcome USING (task_id)), k AS (SELECT *, ended AND outcome = 'failed' AND retryable AND attempts < max_attempts AS again FROM j)
SELECT task_id, CASE WHEN NOT ended THEN status WHEN again THEN 'retrying' WHEN outcome <> 'failed' THEN outcome WHEN retryable THEN 'dead' ELSE 'failed' END AS status,
    CASE WHEN again THEN TIMESTAMP '{NOW}' + to_seconds(CAST(coalesce(retry_after_s, least(3600, 30 * pow(2, greatest(0, attempts - 1)))) AS INT)) END AS next_retry_at,
    CASE WHEN ended AND NOT again THEN CAST(epoch(TIMESTAMP '{NOW}') - epoch(started_at) AS BIGINT) * 1000 END AS duration_ms FROM k""")
def finish_tasks(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    most = jobs.retry_ceiling("o_orderpriority", {"1-URGENT": 4, "2-HIGH": 3})
    none = lambda kind: F.lit(None).cast(kind)
    own = o.select(
        k.alias("task_id"), F.when(F.col("o_orderstatus") == "F", "queued").otherwise("running").alias("status"), (k % 5).cast("int").alias("attempts"), most.alias("max_attempts"),
        F.col("o_orderdate").alias("started_at"), none("timestamp").alias("next_retry_at"), none("timestamp").alias("finished_at"), none("long").alias("duration_ms"),
    )
    outcome = F.when(k % 4 == 0, "succeeded").when(k % 4 == 1, "skipped").otherwise("failed")
    told = o.filter("o_orderkey % 6 <> 5").select(k.alias("task_id"), outcome.alias("outcome"), (F.col("o_custkey") % 3 > 0).alias("retryable"), F.when(k % 7 == 0, 90).alias("retry_after_s"))
    return jobs.finish(own, told, NOW).select("task_id", "status", F.col("next_retry_at").cast("timestamp_ntz").alias("next_retry_at"), "duration_ms")


@query("""SELECT o_orderkey AS task_id, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 > 0 AND o_orderdate + INTERVAL 5 DAY < TIMESTAMP '1996-01-01' THEN 'retrying' WHEN o_orderstatus = 'P' THEN 'running' ELSE 'succeeded' END AS status FROM orders""")
def requeue_expired(spark, d):
    lease = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate") + F.expr("INTERVAL 5 DAY"))
    status = F.when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), status.alias("status"), lease.alias("lease_expires_at"), F.lit(None).cast("timestamp").alias("next_retry_at"))
    return jobs.requeue_expired(rows, "1996-01-01").select("task_id", "status")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 = 3 THEN 'seen' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def stamp_rows(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return jobs.stamp(rows, F.col("o_custkey") % 10 == 3, o_orderstatus=F.lit("seen")).drop("o_custkey")


@query(f"WITH {_RUNS}, a AS (SELECT min(run_id) AS active FROM runs WHERE status = 'running') SELECT o_orderkey + 10000000 AS run_id, false AS opened, active AS conflict_with FROM orders, a WHERE o_orderkey % 100 = 0")
def open_run_conflicts(spark, d):
    wanted = table(spark, d, "orders").filter("o_orderkey % 100 = 0").select((F.col("o_orderkey") + 10_000_000).alias("run_id"))
    return jobs.open_run(runs(spark, d), wanted)


@query("SELECT o_orderkey AS run_id, o_orderkey = m AS opened, CASE WHEN o_orderkey <> m THEN m END AS conflict_with FROM orders, (SELECT min(o_orderkey) AS m FROM orders)")
def open_run_first(spark, d):
    own = runs(spark, d)
    return jobs.open_run(own.filter("status <> 'running'"), own.select("run_id"))


@query(f"""WITH {_RUNS} SELECT run_id, CASE WHEN stale THEN 'failed' ELSE status END AS status, CASE WHEN stale THEN CAST(epoch(TIMESTAMP '{NOW}') - epoch(started_at) AS BIGINT) * 1000 ELSE duration_ms END AS duration_ms
FROM (SELECT *, status = 'running' AND epoch(TIMESTAMP '{NOW}') - epoch(started_at) > 20000 * 3600 AS stale FROM runs)""")
def stale_runs(spark, d):
    return jobs.close_stale(runs(spark, d), NOW, 20_000).select("run_id", "status", "duration_ms")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderdate < TIMESTAMP '1996-01-01' AND o_orderstatus = 'F')")
def purge_finished(spark, d):
    return jobs.purge(table(spark, d, "orders"), "o_orderdate", "1996-01-01", F.col("o_orderstatus") == "F").select("o_orderkey")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def purge_events(spark, d):
    return jobs.purge(table(spark, d, "events"), "ts", "2024-01-10").select("event_id")


@query("SELECT user_id, max(ts) AS ts FROM events GROUP BY 1")
def heartbeat_upsert(spark, d):
    e = table(spark, d, "events")
    before = e.filter("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("ts"))
    return jobs.beat(before, e.filter("event_type <> 'view'"), "user_id", "ts")


@query("SELECT day, coalesce(phase, 'fresh') AS phase FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) LEFT JOIN (SELECT DISTINCT CAST(ts AS DATE) AS day, 'known' AS phase FROM events WHERE event_id % 50 = 0) USING (day)")
def day_states(spark, d):
    days = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    known = days.filter("event_id % 50 = 0").select("day", F.lit("known").alias("phase")).distinct()
    return jobs.get_or_create(known, days, ["day"], phase=F.lit("fresh"))


@query("""SELECT event_id AS task_id, unnest(CASE event_type WHEN 'purchase' THEN ['mail', 'ship'] WHEN 'error' THEN ['retry'] ELSE [] END) AS next FROM events WHERE event_type = 'purchase' OR value > 50""")
def follow_ups(spark, d):
    results = table(spark, d, "events").select(F.col("event_id").alias("task_id"), F.col("event_type").alias("kind"), "value")
    return jobs.follow_ups(results, [("purchase", F.lit(True), ["mail", "ship"]), ("error", F.col("value") > 50, ["retry"]), ("purchase", F.col("value") > 10, ["mail"])])


_AFTER = "2024-02-26 10:07:00"


@query(f"""WITH s AS (SELECT p_partkey AS task_id, p_partkey % 6 AS kind, p_size % 60 AS m, p_partkey % 24 AS h, 1 + p_partkey % 31 AS dom, p_size % 7 AS dow, 1 + p_size % 12 AS mon, TIMESTAMP '{_AFTER}' AS after FROM part),
c AS (SELECT CAST(DATE '2024-02-26' + CAST(i AS INT) AS DATE) AS day FROM range(0, 3700) t(i)),
f AS (SELECT day, day(day) AS dom, dayofweek(day) AS dow, month(day) AS mon FROM c),
-- Of each schedule its days, and on each the first time, or on the first day the next one after now.
d AS (SELECT task_id, day, CASE kind WHEN 5 THEN [h, (h + 6) % 24] ELSE [h] END AS hours, CASE kind WHEN 4 THEN list_transform(range(0, 60, 20), lambda x: x) ELSE [m] END AS minutes, after FROM s JOIN f ON
    CASE kind WHEN 0 THEN true WHEN 1 THEN f.dom = s.dom WHEN 2 THEN f.dom = 29 AND f.mon = 2 AND f.dow = s.dow WHEN 3 THEN f.dom = 31 AND f.mon = 4 WHEN 4 THEN f.dow BETWEEN 1 AND 5 AND f.mon = s.mon ELSE f.dow = s.dow AND f.dom BETWEEN 8 AND 14 END),
t AS (SELECT task_id, min(day + to_hours(CAST(x.h AS INT)) + to_minutes(CAST(x.m AS INT))) AS next_at FROM (SELECT task_id, day, after, unnest(flatten(list_transform(hours, lambda a: list_transform(minutes, lambda b: {{'h': a, 'm': b}})))) AS x FROM d)
    WHERE day + to_hours(CAST(x.h AS INT)) + to_minutes(CAST(x.m AS INT)) > after GROUP BY 1)
SELECT s.task_id, next_at FROM s LEFT JOIN t ON s.task_id = t.task_id""")
def cron_schedule(spark, d):
    """When each part's schedule runs next: daily, on a day of the month, on 29 February if it is some weekday, never, every 20 minutes of some month's working days, in the second week."""
    k, size = F.col("p_partkey"), F.col("p_size")
    m, h, dom, dow, mon = (x.cast("string") for x in (size % 60, k % 24, 1 + k % 31, size % 7, 1 + size % 12))
    space = lambda *parts: F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    both = F.concat_ws(",", h, ((k + 6) % 24).cast("string"))
    texts = [space(m, h, "*", "*", "*"), space(m, h, dom, "*", "*"), space(m, h, "29", "2", dow), space(m, h, "31", "4", "*"), space("*/20", h, "*", mon, "1-5"), space(m, both, "8-14", "*", dow)]
    cron = F.get(F.array(*texts), (k % 6).cast("int"))
    rows = table(spark, d, "part").select(k.alias("task_id"), cron.alias("cron"))
    found = schedule.next_runs(rows, "cron", F.lit(_AFTER), years=10)
    return found.select("task_id", F.col("next_at").cast("timestamp_ntz").alias("next_at"))


@query("SELECT event_id FROM events WHERE minute(ts) % 15 = 0 AND hour(ts) BETWEEN 6 AND 20 AND dayofweek(ts) IN (1, 3, 5)")
def cron_filter(spark, d):
    return table(spark, d, "events").filter(schedule.matches("ts", schedule.compiled("*/15 6-20 * * 1,3,5"))).select("event_id")


@query("""SELECT p_partkey AS item_id, CASE WHEN p_size % 3 = 0 AND p_size < 30 THEN 'recently_searched' WHEN p_size % 4 = 0 THEN 'unscored' WHEN p_size + 20 < 60 AND p_partkey % 90 < 50 THEN 'low_interest' END AS reason FROM part""")
def interest_gate(spark, d):
    size, day = F.col("p_size").cast("int"), F.lit("2024-03-01").cast("date")
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("item_id"), F.when(size % 3 == 0, F.date_sub(day, size)).alias("searched_at"), F.when(size % 4 != 0, size + 20).alias("score"), (F.col("p_partkey") % 90).alias("n_reviews")
    )
    return jobs.worth_a_search(rows, "2024-03-01").select("item_id", "reason")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 9 = 0 OR o_orderdate < TIMESTAMP '1994-01-01' ORDER BY CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate END NULLS FIRST, o_orderkey LIMIT 200")
def due_for_refresh(spark, d):
    rows = table(spark, d, "orders").withColumn("seen", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate")))
    return jobs.due_for_refresh(rows, "seen", "1994-01-01", 200, "o_orderkey").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 9 > 0 AND o_orderdate < TIMESTAMP '1995-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 300")
def stale_transcripts(spark, d):
    """Transcripts that were not to be had when last asked for, some time ago; those never asked for are no matter of a second try."""
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate")).alias("seen"), F.when(F.col("o_orderstatus") == "F", "unavailable").otherwise("found").alias("status"))
    return jobs.due_for_refresh(rows, "seen", "1995-01-01", 300, "o_orderkey", never=False, status="unavailable").select("o_orderkey")


_LISTING = "listing AS (SELECT l_partkey AS slug, l_orderkey * 10 + l_linenumber AS position FROM lineitem), claimed AS (SELECT DISTINCT l_partkey AS slug FROM lineitem WHERE l_quantity >= 49)"


def _listing(spark, d):
    rows = table(spark, d, "lineitem")
    slug = F.col("l_partkey").alias("slug")
    return rows.select(slug, (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position")), rows.filter("l_quantity >= 49").select(slug)


@query(f"WITH {_LISTING} SELECT slug, min(position) AS position FROM listing WHERE slug NOT IN (SELECT slug FROM claimed) GROUP BY 1 ORDER BY 2, 1 LIMIT 40")
def budget_claims(spark, d):
    return jobs.claim_budget(*_listing(spark, d), 40)


@query("""SELECT p_partkey AS slug, CASE WHEN p_partkey % 7 > 0 THEN p_size END AS score FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49 AND l_partkey % 2 = 0) ORDER BY score DESC NULLS LAST, p_partkey LIMIT 60""")
def backfill_claims(spark, d):
    """The bulk backfill: a listing by score rather than by place, claimed best first up to a budget."""
    claimed = table(spark, d, "lineitem").filter("l_quantity >= 49 AND l_partkey % 2 = 0").select(F.col("l_partkey").alias("slug"))
    score = F.when(F.col("p_partkey") % 7 > 0, F.col("p_size"))
    listing = table(spark, d, "part").select(F.col("p_partkey").alias("slug"), (-score).alias("less"), score.isNull().alias("unscored"), score.alias("score"))
    return jobs.claim_budget(listing, claimed, 60, order=("unscored", "less", "score")).select("slug", "score")


@query(f"""WITH {_LISTING}, t AS (SELECT slug, min(position) AS position FROM listing WHERE slug NOT IN (SELECT slug FROM claimed) GROUP BY 1 ORDER BY 2, 1 LIMIT 40), s AS (SELECT count(*) AS claimed, max(position) AS last FROM t)
SELECT s.claimed, (SELECT count(*) FROM listing WHERE slug IN (SELECT slug FROM claimed) AND (s.claimed < 40 OR position < s.last)) AS duplicates FROM s""")
def claim_report(spark, d):
    return jobs.claim_report(*_listing(spark, d), 40)


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, max(CASE WHEN l_quantity < 30 THEN 0 ELSE 1 END) AS touched FROM lineitem GROUP BY ALL),
e AS (SELECT *, count(*) OVER w = 2 AND sum(touched) OVER w = 0 AS ends FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
b AS (SELECT *, coalesce(bool_or(ends) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over_ FROM e) SELECT l_orderkey, l_linenumber FROM b WHERE NOT over_""")
def pages_until_unchanged(spark, d):
    pages = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.when(F.col("l_quantity") < 30, 0).otherwise(1)).alias("touched"))
    return jobs.pages_until_unchanged(pages, "l_orderkey", "l_linenumber", "touched", 2).select("l_orderkey", "l_linenumber")


@query("""SELECT event_id, CAST(sum(user_id % 5 + 1) OVER w AS BIGINT) AS spent, sum(user_id % 5 + 1) OVER w <= 60 AS allowed FROM events WINDOW w AS (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def day_budget(spark, d):
    calls = table(spark, d, "events").select("event_id", F.col("event_type").alias("provider"), F.to_date("ts").alias("day"), F.col("event_id").alias("seq"), (F.col("user_id") % 5 + 1).alias("units"))
    return jobs.day_budget(calls, 60).select("event_id", "spent", "allowed")


@query("""SELECT day, CAST(sum(u) AS BIGINT) AS units, list(event_type ORDER BY event_type) AS kinds, list(n ORDER BY event_type) AS n_calls FROM (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, sum(user_id % 5 + 1) AS u FROM events GROUP BY ALL) GROUP BY 1""")
def day_calls(spark, d):
    calls = table(spark, d, "events").select(F.lit("p").alias("provider"), F.to_date("ts").alias("day"), F.col("event_type").alias("kind"), (F.col("user_id") % 5 + 1).alias("units"))
    return jobs.day_calls(calls).select("day", "units", F.map_keys("calls").alias("kinds"), F.map_values("calls").alias("n_calls"))


@query("""SELECT CAST(o_orderdate AS DATE) AS crawl_date, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'O') > 0 THEN 'recent' ELSE 'backwards' END AS phase, count(*) FILTER (WHERE o_orderstatus <> 'O') AS next_offset, min(o_custkey) AS watermark FROM orders GROUP BY 1""")
def day_cursor(spark, d):
    rows = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("crawl_date"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"), F.col("o_custkey").alias("release_date"))
    return jobs.day_cursor(rows)
