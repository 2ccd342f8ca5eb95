"""Job, run and crawl state as pure functions: tables of states and of what happened to them -> tables of states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records


def _at(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def _ms(since: Column, now: Column) -> Column:
    return F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 1000).cast("long")


def retry_ceiling(kind: Column | str, most: Mapping[str, int]) -> Column:
    """How often a kind of task may be tried; a kind that is not named, once."""
    table = F.create_map(*[F.lit(v) for pair in most.items() for v in pair])
    return F.coalesce(table[F.col(kind) if isinstance(kind, str) else kind], F.lit(1))


def finish(tasks: DataFrame, outcomes: DataFrame, now: str, base: float = 30.0, most: float = 3600.0) -> DataFrame:
    """tasks (task_id, status, attempts, max_attempts, started_at, next_retry_at, finished_at, duration_ms) after their outcomes.

    outcomes: task_id, outcome (succeeded, skipped, failed), retryable, retry_after_s. A running task that failed is retried while
    attempts are left: after retry_after_s, else after the longest backoff (jitter is up to the caller). Out of attempts it is dead, not retryable it
    is failed. Tasks without an outcome, and those not running, stay as they are."""
    told = outcomes.select("task_id", "outcome", "retryable", "retry_after_s")
    rows = tasks.join(told, "task_id", "left")
    ended = (F.col("status") == "running") & F.col("outcome").isNotNull()
    again = ended & (F.col("outcome") == "failed") & F.col("retryable") & (F.col("attempts") < F.col("max_attempts"))
    over = ended & ~again
    state = F.when(again, "retrying").when(over & (F.col("outcome") != "failed"), F.col("outcome")).when(over & F.col("retryable"), "dead").when(over, "failed")
    wait = F.coalesce(F.col("retry_after_s").cast("double"), records.backoff_ceiling("attempts", base, most))
    due = F.timestamp_micros((F.unix_micros(_at(now)) + wait * 1e6).cast("long"))
    made = {
        "status": F.coalesce(state, F.col("status")),
        "next_retry_at": F.when(again, due).otherwise(F.col("next_retry_at")),
        "finished_at": F.when(over, _at(now)).otherwise(F.col("finished_at")),
        "duration_ms": F.when(over, _ms(F.col("started_at"), _at(now))).otherwise(F.col("duration_ms")),
        "started_at": F.when(~again, F.col("started_at")),
    }
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in tasks.columns])


def requeue_expired(tasks: DataFrame, now: str) -> DataFrame:
    """Running tasks whose lease is over go back to the queue, due at once."""
    late = (F.col("status") == "running") & (F.col("lease_expires_at") < _at(now))
    late = F.coalesce(late, F.lit(False))
    return tasks.withColumns(
        {"next_retry_at": F.when(late, _at(now)).otherwise(F.col("next_retry_at")), "lease_expires_at": F.when(~late, F.col("lease_expires_at")), "status": F.when(late, "retrying").otherwise(F.col("status"))}
    )


def stamp(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    """rows with columns set where a condition holds (a null condition holds nowhere)."""
    hit = F.coalesce(where, F.lit(False))
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def open_run(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(run_id, opened, conflict_with) of runs that ask to start: with none running the one with the least id opens, else none does."""
    active = runs.filter("status = 'running'").agg(F.min("run_id").alias("x"))
    first = wanted.agg(F.min("run_id").alias("x"))
    rows = wanted.select("run_id", active.scalar().alias("active"), first.scalar().alias("first"))
    opened = F.col("active").isNull() & (F.col("run_id") == F.col("first"))
    return rows.select("run_id", opened.alias("opened"), F.when(~opened, F.coalesce("active", "first")).alias("conflict_with"))


def close_stale(runs: DataFrame, now: str, hours: float) -> DataFrame:
    """Runs that have been running for longer than so many hours are failed, with their duration."""
    age = (F.unix_micros(_at(now)) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 3.6e9
    stale = (F.col("status") == "running") & (age > hours)
    return stamp(runs, stale, duration_ms=_ms(F.col("started_at"), _at(now)), status=F.lit("failed"))


def purge(rows: DataFrame, ts: str, before: str, only: Column | None = None) -> DataFrame:
    """What stays: rows from `before` on, rows without a time, and rows to which `only` does not apply."""
    old = F.col(ts) < F.lit(before).cast("timestamp")
    gone = old if only is None else old & only
    return rows.filter(~F.coalesce(gone, F.lit(False)))


def beat(workers: DataFrame, beats: DataFrame, key: str, ts: str) -> DataFrame:
    """workers (key, ts) after heartbeats: the latest time of each, new workers included."""
    return workers.select(key, ts).unionByName(beats.select(key, ts)).groupBy(key).agg(F.max(ts).alias(ts))


def get_or_create(states: DataFrame, keys: DataFrame, by: Sequence[str], **start: Column) -> DataFrame:
    """states and, for keys without one, a fresh state."""
    missing = keys.select(*by).distinct().join(states.select(*by), list(by), "left_anti")
    return states.unionByName(missing.withColumns(start), allowMissingColumns=True)


def follow_ups(results: DataFrame, rules: Sequence[tuple[str, Column, Sequence[str]]]) -> DataFrame:
    """(task_id, next) of the tasks that results ask for: of each rule (kind, condition, tasks), its tasks where both hold."""
    asked = F.array().cast("array<string>")
    for kind, condition, tasks in rules:
        holds = (F.col("kind") == kind) & F.coalesce(condition, F.lit(False))
        asked = F.concat(asked, F.when(holds, F.array(*map(F.lit, tasks))).otherwise(F.array().cast("array<string>")))
    return results.select("task_id", F.explode(F.array_distinct(asked)).alias("next"))


def worth_a_search(items: DataFrame, now: str, days: int = 30, least_score: int = 60, least_reviews: int = 50) -> DataFrame:
    """items with `reason`, why they are not searched for now, or null: recently_searched, unscored, low_interest."""
    age = (F.unix_micros(_at(now)) - F.unix_micros(F.col("searched_at").cast("timestamp"))) / 8.64e10
    low = (F.col("score") < least_score) & (F.coalesce("n_reviews", F.lit(0)) < least_reviews)
    return items.withColumn("reason", F.when(age < days, "recently_searched").when(F.col("score").isNull(), "unscored").when(low, "low_interest"))


def due_for_refresh(items: DataFrame, ts: str, before: str, limit: int, key: str = "item_id", never: bool = True, status: str | None = None) -> DataFrame:
    """The items never refreshed (unless never is false) or last before a time, those never first, then the oldest, then by key; with a status, only those that have it."""
    stale = F.col(ts) < F.lit(before).cast("timestamp")
    stale = F.col(ts).isNull() | stale if never else F.coalesce(stale, F.lit(False))
    if status is not None:
        stale = stale & (F.col("status") == status)
    return items.filter(stale).orderBy(F.asc_nulls_first(ts), key).limit(limit)


def claim_budget(listing: DataFrame, claimed: DataFrame, budget: int, key: str = "slug", order: Sequence[str] = ("position",)) -> DataFrame:
    """(key, position) of the first `budget` rows of the listing whose key was not claimed before; a key listed twice counts once."""
    fresh = listing.join(claimed.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.min(F.struct(*order)).alias("_at"))
    return fresh.orderBy("_at", key).limit(budget).select(key, "_at.*")


def claim_report(listing: DataFrame, claimed: DataFrame, budget: int, key: str = "slug", position: str = "position") -> DataFrame:
    """One row (claimed, duplicates): rows already claimed count as duplicates up to the last row that the budget takes."""
    taken = claim_budget(listing, claimed, budget, key, (position,))
    sums = taken.agg(F.count("*").alias("claimed"), F.max(position).alias("last"))
    end = F.when(sums.select("claimed").scalar() < budget, F.lit(None)).otherwise(sums.select("last").scalar())
    known = listing.join(claimed.select(key).distinct(), key, "left_semi").filter(F.coalesce(F.col(position) < end, F.lit(True)))
    return sums.select("claimed", known.agg(F.count("*").alias("n")).scalar().alias("duplicates"))


def pages_until_unchanged(pages: DataFrame, group: str, page: str, touched: str, quiet: int) -> DataFrame:
    """The pages read before a crawl of each group stops: up to the first that ends `quiet` pages in a row without a change."""
    run = Window.partitionBy(group).orderBy(page).rowsBetween(-(quiet - 1), 0)
    past = Window.partitionBy(group).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    ends = (F.count("*").over(run) == quiet) & (F.sum(F.when(F.col(touched) == 0, 0).otherwise(1)).over(run) == 0)
    rows = pages.withColumn("_ends", ends.cast("int"))
    return rows.withColumn("_before", F.coalesce(F.max("_ends").over(past), F.lit(0))).filter("_before = 0").drop("_ends", "_before")


def day_budget(calls: DataFrame, limit: int) -> DataFrame:
    """calls (provider, day, seq, kind, units) with spent (of their day, so far) and allowed: whether they stay within the day's limit."""
    upto = Window.partitionBy("provider", "day").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("spent", F.sum("units").over(upto)).withColumn("allowed", F.col("spent") <= limit)


def day_calls(calls: DataFrame) -> DataFrame:
    """(provider, day, units, calls): the units spent, and a map of how often each kind was called."""
    counted = calls.groupBy("provider", "day", "kind").agg(F.count("*").alias("n"), F.sum("units").alias("u"))
    return counted.groupBy("provider", "day").agg(F.sum("u").alias("units"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("calls"))


def day_cursor(items: DataFrame, day: str = "crawl_date", status: str = "status", released: str = "release_date") -> DataFrame:
    """(day, phase, next_offset, watermark): a day is in its first phase while a listed item waits, then goes backwards from the earliest release date."""
    waiting = F.count_if(F.col(status) == "queued")
    return items.groupBy(day).agg(
        F.when(waiting > 0, "recent").otherwise("backwards").alias("phase"),
        F.count_if(F.col(status) != "queued").alias("next_offset"),
        F.min(released).alias("watermark"),
    )
