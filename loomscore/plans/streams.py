"""Streaming queries: the events table run through as a stream until no more is available."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import eventlog, ordered, stream
from .base import query, table, work_folder
from .registry import ORACLE_SQL


def _decided(spark: SparkSession, d: str, machine: tuple) -> DataFrame:
    events = stream.open_events(spark, f"{d}/events.parquet*")
    return stream.drain(stream.decide(events, machine), work_folder(spark)).withColumnRenamed("key", "user_id")


_EVENTS = "e AS (SELECT user_id, event_id, event_type, epoch(ts) AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


@query(f"""WITH RECURSIVE {_EVENTS}, f AS (SELECT user_id, k, event_id, [now] AS hits, 'admitted' AS decision FROM e WHERE k = 1
UNION ALL SELECT user_id, k, event_id, CASE WHEN len(h) < 5 THEN list_append(h, now) ELSE h END, CASE WHEN len(h) < 5 THEN 'admitted' ELSE 'refused' END
    FROM (SELECT e.user_id, e.k, e.event_id, e.now, list_filter(f.hits, lambda t: t > e.now - 86400) AS h FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)) SELECT user_id, event_id, decision FROM f""")
def stream_limiter(spark, d):
    return _decided(spark, d, stream.limiter(5, 86400.0))


@query(f"""WITH RECURSIVE {_EVENTS}, f AS (SELECT user_id, k, event_id, 2.0::DOUBLE AS tokens, now AS last, 'taken' AS decision FROM e WHERE k = 1
UNION ALL SELECT user_id, k, event_id, CASE WHEN t >= 1 THEN t - 1 ELSE t END, now, CASE WHEN t >= 1 THEN 'taken' ELSE 'wait' END
    FROM (SELECT e.user_id, e.k, e.event_id, e.now, least(3.0::DOUBLE, f.tokens + (e.now - f.last) * (1.0::DOUBLE / 36000)) AS t FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)) SELECT user_id, event_id, decision FROM f""")
def stream_token_bucket(spark, d):
    return _decided(spark, d, stream.token_bucket(1 / 36000, 3.0))


@query(f"""WITH RECURSIVE {_EVENTS}, f AS (SELECT user_id, k, event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS n, false AS is_open, 0.0::DOUBLE AS opened, 'closed' AS decision FROM e WHERE k = 1
UNION ALL SELECT user_id, k, event_id, CASE WHEN waits THEN n WHEN failed THEN n + 1 ELSE 0 END, CASE WHEN waits THEN is_open ELSE failed AND (is_open OR n + 1 >= 2) END,
    CASE WHEN waits THEN opened WHEN failed AND (is_open OR n + 1 >= 2) THEN now ELSE 0.0 END, CASE WHEN waits THEN 'open' WHEN failed AND (is_open OR n + 1 >= 2) THEN 'tripped' ELSE 'closed' END
    FROM (SELECT e.user_id, e.k, e.event_id, e.now, f.n, f.is_open, f.opened, f.is_open AND e.now - f.opened < 43200 AS waits, e.event_type = 'error' AS failed FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)) SELECT user_id, event_id, decision FROM f""")
def stream_breaker(spark, d):
    return _decided(spark, d, stream.breaker(2, 43200.0))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark, d):
    events = stream.open_events(spark, f"{d}/events.parquet*")
    counts = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    rows = counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
    return stream.drain(rows, work_folder(spark), "complete")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_once(spark, d):
    """The stream with each event delivered twice, then once."""
    events = stream.open_events(spark, f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = events.union(events)
    return stream.drain(stream.deliver_once(twice, "event_id", "ts", "1 day"), work_folder(spark)).select("event_id", "user_id", "event_type")


#: The events are delivered in so many pieces, up to a day out of order; the last piece moves the clock on.
_PIECES, _AFTER = 4, 40


def _delivered(spark: SparkSession, events: DataFrame, path: str) -> Iterator[bool]:
    """Event files whose order is not that of time within a day, and a last one of the key -1 some weeks later; after each piece whether it is the last.

    A piece has as many files as the table has parts, each of any of its days, so a reader that stops within one may be further on than the watermark allows."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    span = events.agg(F.min(seconds).alias("low"), F.max(seconds).alias("high"), F.max("ts").alias("end")).first()
    if span["end"] is not None:
        jitter = F.pmod(F.xxhash64("event_id"), F.lit(86_400)) - 43_200
        piece = F.floor((seconds + jitter - span["low"]) / ((span["high"] - span["low"]) / _PIECES + 1))
        piece = F.least(F.greatest(piece, F.lit(0)), F.lit(_PIECES - 1))
        for k in range(_PIECES):
            events.filter(piece == k).write.mode("append").parquet(path)
            yield False
    end = events.agg((F.max("ts") + F.expr(f"INTERVAL {_AFTER} DAY")).alias("ts"))
    end.selectExpr("-1L AS event_id", "ts", "-1L AS user_id", "'end' AS event_type", "0D AS value", "'' AS props").write.mode("append").parquet(path)
    yield True


def _in_order(spark: SparkSession, d: str, machine: ordered.Machine) -> DataFrame:
    """The stream followed piece by piece: what has come is one batch, and the next run goes on from the checkpoint."""
    path, folder, events = work_folder(spark), work_folder(spark), table(spark, d, "events")
    for last in _delivered(spark, events, path):
        decided = ordered.decide_in_order(spark.readStream.schema(events.schema).parquet(path), machine, "2 days")
        rows = stream.drain(decided, folder, ending=last)
    return rows.filter("key >= 0").select(F.col("key").alias("user_id"), F.col("at").cast("timestamp_ntz").alias("at"), "event_id", "decision")


@query("""WITH n AS (SELECT user_id, event_id, ts, lag(ts) OVER w AS before, lead(ts) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, ts + INTERVAL 1 DAY AS at, NULL::BIGINT AS event_id, 'gone' AS decision FROM n WHERE after IS NULL OR after > ts + INTERVAL 1 DAY
UNION ALL SELECT user_id, ts, event_id, 'back' FROM n WHERE ts > before + INTERVAL 1 DAY""")
def stream_heartbeats(spark, d):
    """Users that give no sign for a day are gone, without an event that says so; their next event brings them back."""
    return _in_order(spark, d, ordered.liveness(86_400.0))


_TIMELINE = "e AS (SELECT user_id, event_id, event_type AS kind, epoch_us(ts) AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"
_LAST = "l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1)"


def _timeline_sql(state: str, step: str, end: str) -> str:
    """A fold over each user's events, whose deadline (due, microseconds) is looked at before each event and after the last."""
    return f"""WITH RECURSIVE {_TIMELINE}, f AS (
    SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::BIGINT AS now, {state}, NULL::BIGINT AS due, NULL::BIGINT AS exp_at, NULL::VARCHAR AS exp_said, NULL::VARCHAR AS said FROM events
    UNION ALL {step}), {_LAST}
SELECT user_id, make_timestamp(exp_at) AS at, NULL::BIGINT AS event_id, exp_said AS decision FROM f WHERE exp_said IS NOT NULL
UNION ALL SELECT user_id, make_timestamp(now), event_id, said FROM f WHERE said IS NOT NULL
UNION ALL SELECT user_id, make_timestamp(due), NULL, {end} FROM l WHERE due IS NOT NULL"""


@query(_timeline_sql("'waiting' AS status, 0 AS attempts", """SELECT user_id, k, event_id, now,
        CASE WHEN kind = 'click' AND s = 'waiting' THEN 'running' WHEN s <> 'running' THEN s WHEN kind = 'purchase' THEN 'succeeded' WHEN kind = 'error' THEN CASE WHEN attempts >= 3 THEN 'dead' ELSE 'waiting' END ELSE s END,
        CASE WHEN kind = 'click' AND s = 'waiting' THEN attempts + 1 ELSE attempts END,
        CASE WHEN (kind = 'click' AND s = 'waiting') OR (kind = 'view' AND s = 'running') THEN now + 21600000000 WHEN s = 'running' AND kind NOT IN ('purchase', 'error') THEN due END,
        CASE WHEN late THEN due END, CASE WHEN late THEN CASE WHEN attempts >= 3 THEN 'lost' ELSE 'requeued' END END,
        CASE WHEN kind = 'click' AND s = 'waiting' THEN 'claimed' WHEN kind = 'click' THEN 'refused' WHEN s <> 'running' THEN NULL WHEN kind = 'view' THEN 'extended' WHEN kind = 'purchase' THEN 'succeeded' WHEN kind = 'error' THEN CASE WHEN attempts >= 3 THEN 'dead' ELSE 'retrying' END END
    FROM (SELECT *, CASE WHEN late THEN CASE WHEN attempts >= 3 THEN 'lost' ELSE 'waiting' END ELSE status END AS s
        FROM (SELECT f.user_id, e.k, e.event_id, e.now, e.kind, f.status, f.attempts, f.due, coalesce(f.due < e.now, false) AS late FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1))""",
    "CASE WHEN attempts >= 3 THEN 'lost' ELSE 'requeued' END"))
def stream_leases(spark, d):
    """Each user is a task: clicks claim it for six hours, views extend the lease, purchases end it, errors fail the attempt; leases run out by themselves."""
    return _in_order(spark, d, ordered.leases(21_600.0, 3, "click", "view", "purchase", "error"))


@query(_timeline_sql("'closed' AS status, 0 AS n", """SELECT user_id, k, event_id, now,
        CASE WHEN s = 'open' THEN s WHEN kind <> 'error' THEN 'closed' WHEN s = 'half_open' OR n + 1 >= 2 THEN 'open' ELSE 'closed' END,
        CASE WHEN s = 'open' THEN n WHEN kind <> 'error' THEN 0 ELSE n + 1 END,
        CASE WHEN s = 'open' THEN due WHEN kind = 'error' AND (s = 'half_open' OR n + 1 >= 2) THEN now + 43200000000 END,
        CASE WHEN late THEN due END, CASE WHEN late THEN 'half_open' END,
        CASE WHEN s = 'open' THEN 'refused' WHEN kind <> 'error' THEN CASE WHEN s = 'half_open' THEN 'closed' END WHEN s = 'half_open' OR n + 1 >= 2 THEN 'tripped' END
    FROM (SELECT *, CASE WHEN late THEN 'half_open' ELSE status END AS s
        FROM (SELECT f.user_id, e.k, e.event_id, e.now, e.kind, f.status, f.n, f.due, coalesce(f.due < e.now, false) AS late FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1))""",
    "'half_open'"))
def stream_half_open(spark, d):
    """A breaker for each user that goes half open by itself, half a day after it has tripped."""
    return _in_order(spark, d, ordered.breaker(2, 43_200.0))


@query(ORACLE_SQL["stream_limiter"])
def stream_shuffled(spark, d):
    """The limiter on events that come out of order: the same decisions as in order."""
    return _in_order(spark, d, ordered.untimed(stream.limiter(5, 86_400.0))).select("user_id", "event_id", "decision")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_resumed(spark, d):
    """The log followed from its start, stopped when half of it is there, and followed again from the checkpoint."""
    path, folder, events = work_folder(spark), work_folder(spark), table(spark, d, "events")
    half = (events.agg(F.max("event_id")).first()[0] or 0) // 2
    for part in (F.col("event_id") <= half, F.col("event_id") > half):
        events.filter(part).write.mode("append").parquet(path)
        found = stream.drain(eventlog.follow(spark, path, events.schema, cursor=-1, backlog=10**12), folder)
    return found.select("event_id", "user_id", "event_type")
