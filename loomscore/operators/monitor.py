"""Monitoring: counters, percentages, stage and system states over task, run, event and worker tables.

Every figure is one aggregate row (or one for each group), so nothing but the result is gathered."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULT, Settings


def seconds_since(ts: Column | str, now: str) -> Column:
    at = F.col(ts) if isinstance(ts, str) else ts
    return (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 1e6


def percent(part: Column, whole: Column) -> Column:
    """To one decimal place; null of nothing."""
    return F.round(F.try_divide(100.0 * part, whole), 1)


def latest_id(rows: DataFrame, key: str) -> DataFrame:
    """(latest_id): 0 for an empty table."""
    return rows.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("latest_id"))


def status_counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by, "status").agg(F.count("*").alias("n"))


def counts_map(rows: DataFrame, group: str, name: str) -> DataFrame:
    """(group, counts): how often each value of `name` occurs in a group, as a map; nulls are not counted."""
    counted = rows.filter(F.col(name).isNotNull()).groupBy(group, name).agg(F.count("*").alias("n"))
    return counted.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "n")))).alias("counts"))


def text_counts(rows: DataFrame, group: str, text: str, day: str, since: str) -> DataFrame:
    """(group, total, with_text, fresh, oldest, newest)."""
    return rows.groupBy(group).agg(
        F.count("*").alias("total"),
        F.count_if(F.length(F.trim(text)) > 0).alias("with_text"),
        F.count_if(F.col(day) >= F.lit(since).cast("date")).alias("fresh"),
        F.min(day).alias("oldest"),
        F.max(day).alias("newest"),
    )


def run_counters(runs: DataFrame, since: str) -> DataFrame:
    """One row over the runs (started_at, claimed, failed, skipped, duration_ms) from `since` on; the mean duration is cut to whole ms."""
    recent = runs.filter(F.col("started_at") >= F.lit(since).cast("timestamp"))
    processed, failed = F.coalesce(F.sum("claimed"), F.lit(0)), F.coalesce(F.sum("failed"), F.lit(0))
    mean = F.try_divide(F.sum(F.when(F.col("duration_ms") > 0, F.col("duration_ms"))), F.count_if(F.col("duration_ms") > 0))
    return recent.agg(
        F.count("*").alias("runs"),
        processed.alias("processed"),
        F.greatest(F.lit(0), processed - failed).alias("succeeded"),
        failed.alias("failed"),
        F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"),
        percent(processed - failed, F.nullif(processed, F.lit(0))).alias("success_rate"),
        F.floor(mean).cast("long").alias("avg_duration_ms"),
    )


def data_quality(items: DataFrame, neighbours: DataFrame, least: int = 3) -> DataFrame:
    """One row: items with a score, with a summary and with at least `least` neighbours, and their percentages."""
    similar = neighbours.groupBy("item_id").count().filter(F.col("count") >= least).select("item_id", F.lit(True).alias("similar"))
    rows = items.join(similar, "item_id", "left")
    total = F.count("*")
    scored, told, near = F.count_if(F.col("score").isNotNull()), F.count_if("has_summary"), F.count_if("similar")
    return rows.agg(
        total.alias("total"),
        scored.alias("with_score"),
        told.alias("with_summary"),
        percent(told, F.nullif(total, F.lit(0))).alias("summary_percent"),
        percent(near, F.nullif(total, F.lit(0))).alias("similar_percent"),
    )


def stage_states(tasks: DataFrame, stages: Mapping[str, Sequence[str]], disabled: Sequence[str] = (), most_queued: int = 200, most: int = 50) -> DataFrame:
    """(stage, state, queued, running, failed) of every stage, also of those without tasks.

    tasks: queue, status. Counts are capped for each queue, as a display needs no more; a state is the first that holds of
    disabled, error, running, queued, done."""
    spark = tasks.sparkSession
    known = spark.createDataFrame([(s, q) for s, queues in stages.items() for q in queues], "stage string, queue string")  # a handful
    counted = tasks.groupBy("queue").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("queued", "running", "dead")])
    caps = {"queued": most_queued, "running": most, "dead": most}
    rows = known.join(counted, "queue", "left").groupBy("stage")
    rows = rows.agg(*[F.sum(F.least(F.coalesce(F.col(s), F.lit(0)), F.lit(cap))).alias(s) for s, cap in caps.items()])
    state = (
        F.when(F.col("stage").isin(*disabled), "disabled")
        .when(F.col("dead") > 0, "error")
        .when(F.col("running") > 0, "running")
        .when(F.col("queued") > 0, "queued")
        .otherwise("done")
    )
    return rows.select("stage", state.alias("state"), "queued", "running", F.col("dead").alias("failed"))


def drift_streak(events: DataFrame, broken: Column, sound: Column, key: str = "event_id") -> DataFrame:
    """One row (streak): the broken events after the last sound one. Two aggregates, no sort."""
    last = events.agg(F.coalesce(F.max(F.when(sound, F.col(key))), F.lit(-1)).alias("last"))
    return events.filter(broken & (F.col(key) > last.scalar())).agg(F.count("*").alias("streak"))


def drift_alarm(events: DataFrame, broken: Column, sound: Column, announced: Column, least: int = 10, key: str = "event_id") -> DataFrame:
    """One row (streak, is_open, announce): the circuit is open from `least` on; an incident is announced once, so not if an
    announcement followed the last sound event."""
    last = lambda c: F.coalesce(F.max(F.when(c, F.col(key))), F.lit(-1))
    marks = events.agg(last(sound).alias("_sound"), last(announced).alias("_said"))
    rows = marks.withColumn("streak", drift_streak(events, broken, sound, key).scalar())
    is_open = F.col("streak") >= least
    return rows.select("streak", is_open.alias("is_open"), (is_open & (F.col("_said") <= F.col("_sound"))).alias("announce"))


def health(runs: DataFrame, workers: DataFrame, problems: DataFrame, streak: DataFrame, now: str, least_drift: int = 10, stale_hours: float = 3, alive_seconds: int = 120) -> DataFrame:
    """One row (status, reason): the first that holds of drift, never run, stale, no worker, problems; else healthy.

    runs: status, started_at; workers: heartbeat_at; problems: what happened in the last day; streak: see drift_streak."""
    done = runs.agg(F.max(F.when(F.col("status").isin("succeeded", "partial"), F.col("started_at"))).alias("last"))
    alive = workers.agg(F.count_if(seconds_since("heartbeat_at", now) < alive_seconds).alias("alive"))
    wrong = problems.agg(F.count("*").alias("problems"))
    rows = done.select("last", alive.scalar().alias("alive"), wrong.scalar().alias("problems"), streak.scalar().alias("streak"))
    reason = (
        F.when(F.col("streak") >= least_drift, "drift")
        .when(F.col("last").isNull(), "never_run")
        .when(seconds_since("last", now) > stale_hours * 3600, "stale")
        .when(F.col("alive") == 0, "no_workers")
        .when(F.col("problems") > 0, "problems")
        .otherwise("none")
    )
    status = F.when(F.col("reason").isin("drift", "stale"), "down").when(F.col("reason") == "none", "healthy").otherwise("degraded")
    return rows.select(reason.alias("reason"), "problems", "alive").select(status.alias("status"), "reason", "problems", "alive")


def current_job(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """At most one row (kind, id, started_at): the running task last started, else the active run."""
    top = lambda rows, kind, key: rows.filter("status = 'running'").agg(F.max(F.struct("started_at", key)).alias("x")).select(
        F.lit(kind).alias("kind"), F.col(f"x.{key}").alias("id"), "x.started_at"
    )
    both = top(tasks, "task", "task_id").union(top(runs, "run", "run_id")).filter("id IS NOT NULL")
    return both.orderBy(F.desc("kind")).limit(1)


def recent(rows: DataFrame, key: str, limit: int, **equal: object) -> DataFrame:
    """The newest rows by key, of those where columns equal the values given (None: no condition)."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(name) == F.lit(value))
    return rows.orderBy(F.desc(key)).limit(limit)


def events_after(events: DataFrame, cursor: int | None, limit: int = 200, backlog: int = 2000, key: str = "event_id", **equal: object) -> DataFrame:
    """The next events after a cursor, by id, `limit` at most, of those where columns equal the values given.

    Without a cursor, or more than `backlog` ids behind, a reader starts from the latest event and so has nothing to read yet."""
    latest = events.agg(F.coalesce(F.max(key), F.lit(0)).alias("x")).scalar()
    start = latest if cursor is None else F.when(latest - cursor > backlog, latest).otherwise(F.lit(cursor))
    rows = events.filter(F.col(key) > start)
    for name, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(name) == F.lit(value))
    return rows.orderBy(key).limit(limit)


def problems(events: DataFrame, since: str | None = None, run: int | None = None, item: int | None = None, levels: Sequence[str] = ("warning", "error")) -> DataFrame:
    """Events of the levels that count as problems, of one run or item, since a time, where these are given."""
    rows = events.filter(F.col("level").isin(*levels))
    if since is not None:
        rows = rows.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    if run is not None:
        rows = rows.filter(F.col("run_id") == run)
    return rows if item is None else rows.filter(F.col("item_id") == item)


def spend(calls: DataFrame, since: str) -> DataFrame:
    """One row (dollars, tokens, n_calls) over calls (model, cost, tokens, ts) from `since` on; rows without a model are no calls."""
    rows = calls.filter(F.col("model").isNotNull() & (F.col("ts") >= F.lit(since).cast("timestamp")))
    return rows.agg(F.coalesce(F.round(F.sum("cost"), 6), F.lit(0.0)).alias("dollars"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"), F.count("*").alias("n_calls"))


def within_budget(calls: DataFrame, day_start: str, hour_start: str, settings: Settings = DEFAULT) -> DataFrame:
    """One row (refused): the ceiling that forbids another call (daily_cost, hourly_calls) or null; a ceiling of 0 is none."""
    made = calls.filter(F.col("model").isNotNull())
    day, hour = (F.col("ts") >= F.lit(t).cast("timestamp") for t in (day_start, hour_start))
    sums = made.agg(F.coalesce(F.sum(F.when(day, F.col("cost"))), F.lit(0.0)).alias("spent"), F.count_if(hour).alias("n"))
    refused = F.when((F.lit(settings.daily_cost) > 0) & (F.col("spent") >= settings.daily_cost), "daily_cost")
    return sums.select(refused.when((F.lit(settings.hourly_calls) > 0) & (F.col("n") >= settings.hourly_calls), "hourly_calls").alias("refused"))


def exposition(metrics: DataFrame) -> DataFrame:
    """(line): metrics (name, labels as a map, value) in the text form that scrapers read."""
    labels = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), F.replace(e["value"], F.lit('"'), F.lit('\\"')), F.lit('"')))
    inner = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(labels, ","), F.lit("}"))).otherwise("")
    return metrics.select(F.concat("name", inner, F.lit(" "), F.col("value").cast("string")).alias("line"))


def event_frames(events: DataFrame) -> DataFrame:
    """(event_id, frame): events (event_id, kind, data as text) as server-sent frames."""
    frame = F.concat(F.lit("id: "), F.col("event_id").cast("string"), F.lit("\nevent: "), "kind", F.lit("\ndata: "), F.coalesce("data", F.lit("")), F.lit("\n\n"))
    return events.select("event_id", frame.alias("frame"))
