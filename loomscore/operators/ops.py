"""Operational metrics over task and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def queue_depth(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("queue", "status").agg(F.count("*").alias("n"), F.min("queued_at").alias("oldest"))


def indexed_percentiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The values at index n // 2 and min(n - 1, int(0.95 n)) of each key's sorted values (not the usual discrete percentile); nulls are left out.

    Equal values are counted where they lie, so a key's task sorts its distinct values and not its rows."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(Window.partitionBy(key))})
    at = lambda index: F.min(F.when(F.col("_upto") > index, F.col(value)))
    return ranked.groupBy(key).agg(
        at(F.floor(F.col("_all") / 2)).alias("p50"), at(F.least(F.col("_all") - 1, F.floor(F.col("_all") * 0.95))).alias("p95")
    )


def streaks(events: DataFrame, counted: Column, reset: Column) -> DataFrame:
    """For each user: counted events after the last reset."""
    last = events.filter(reset).groupBy("user_id").agg(F.max("event_id").alias("reset_id"))
    rows = events.filter(counted).join(last, "user_id", "left")
    after = F.col("event_id") > F.coalesce("reset_id", F.lit(-1))
    return rows.groupBy("user_id").agg(F.count_if(after).alias("streak"))


def rolling(events: DataFrame, seconds: int, blocks: int = 24, key: str = "user_id", ts: str = "ts", value: str = "value", seq: str = "event_id") -> DataFrame:
    """events with spent_cents and n_calls: sum and count of the key's events within so many seconds up to each event, those of its own time included.

    Two levels: time is cut into blocks, of which `blocks` make up the span. What lies between an event's own block and the one in which its span
    begins are whole blocks, summed as rows of blocks; of its own block the sum up to the event counts, of the first block all but what comes
    before the span. So a key's events are dealt over its blocks, and one with half of all events is no task of its own. seq tells a key's events
    apart; an event without a key, a time or a value has the key null, counts for nothing, or as nothing."""
    width = seconds * 1_000_000 // blocks
    span = width * blocks
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    cents = F.coalesce(F.round(F.col(value) * 100).cast("long"), F.lit(0))
    block = lambda t: F.floor(t / F.lit(width)).cast("long")
    slim = events.select(F.col(key).alias("_key"), F.col(seq).alias("_seq"), at.alias("_at"), cents.alias("_cents"))
    # An event's own row, and a mark where its span begins: both look back within one block.
    own = F.struct(F.col("_at").alias("at"), F.lit(1).alias("kind"), F.col("_cents").alias("cents"), F.lit(1).alias("n"))
    mark = F.struct((F.col("_at") - span).alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("cents"), F.lit(0).alias("n"))
    marked = slim.filter("_at IS NOT NULL").select("_key", "_seq", F.inline(F.array(own, mark))).withColumn("_block", block(F.col("at")))
    inside = Window.partitionBy("_key", "_block").orderBy("at")
    upto, before = inside.rangeBetween(Window.unboundedPreceding, 0), inside.rangeBetween(Window.unboundedPreceding, -1)
    sign = F.when(F.col("kind") == 1, 1).otherwise(-1)
    edge = lambda c: sign * F.coalesce(F.when(F.col("kind") == 1, F.sum(c).over(upto)).otherwise(F.sum(c).over(before)), F.lit(0))
    edges = marked.select("_key", "_seq", "_block", "kind", edge("cents").alias("cents"), edge("n").alias("n"))
    sums = slim.filter("_at IS NOT NULL").groupBy("_key", block(F.col("_at")).alias("_block")).agg(F.sum("_cents").alias("cents"), F.count("*").alias("n"))
    past = Window.partitionBy("_key").orderBy("_block").rangeBetween(-blocks, -1)  # a row for each block of a key
    whole = sums.select("_key", "_block", F.coalesce(F.sum("cents").over(past), F.lit(0)).alias("_cents"), F.coalesce(F.sum("n").over(past), F.lit(0)).alias("_n"))
    whole = whole.withColumnsRenamed({"_key": "_k", "_block": "_b"})
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")) & (F.col("kind") == 1)
    parts = edges.join(whole, same, "left")
    add = lambda a, b: F.sum(F.col(a) + F.coalesce(F.col(b), F.lit(0))).cast("long")
    found = parts.groupBy("_key", "_seq").agg(add("cents", "_cents").alias("spent_cents"), add("n", "_n").alias("n_calls"))
    one = events[key].eqNullSafe(found["_key"]) & events[seq].eqNullSafe(found["_seq"])
    return events.join(found, one, "left").drop("_key", "_seq")


def claim_next(tasks: DataFrame, now: str, per: str = "queue") -> DataFrame:
    """The one task of each queue to lease next: due, highest priority, oldest, least id. An aggregate: nothing is sorted."""
    due = F.col("status").isin("queued", "retrying") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= F.lit(now).cast("timestamp")))
    rest = [c for c in tasks.columns if c != per]
    first = tasks.filter(due).groupBy(per).agg(F.min(F.struct((-F.col("priority")).alias("_p"), "queued_at", "task_id", F.struct(*rest).alias("row"))).alias("x"))
    return first.select(per, "x.row.*").select(*tasks.columns)


def reap(tasks: DataFrame, now: str, most: int = 3) -> DataFrame:
    """Expired leases: failed after so many attempts, else queued again."""
    late = (F.col("status") == "running") & (F.col("lease_expires_at") < F.lit(now).cast("timestamp"))
    state = F.when(late & (F.col("attempts") >= most), "failed").when(late, "queued").otherwise(F.col("status"))
    return tasks.withColumn("status", state)


def liveness(beats: DataFrame, key: str, ts: str, now: str, seconds: int = 120) -> DataFrame:
    last = beats.groupBy(key).agg(F.max(ts).alias("last_seen"))
    age = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("last_seen").cast("timestamp"))
    return last.withColumn("state", F.when(age < seconds, "alive").otherwise("gone"))


def evict(files: DataFrame, size: str, used: str, key: str, budget: int, to: float = 0.8, run_rows: int = 1_000_000, most_runs: int = 256) -> DataFrame:
    """What goes, least recently used first, until `to` of the budget is left; nothing if the budget holds.

    Approximate quantiles of the time of use cut the files into runs of about run_rows; sums over the runs (most_runs at most) give what
    goes before each, running sums within a run the rest. So no task sorts all rows, and the rows are read, not sorted, for the cuts."""
    total, n = files.agg(F.sum(size), F.count("*")).first()
    if (total or 0) <= budget:
        return files.filter("false")
    runs = max(1, min(most_runs, n // run_rows))
    cuts = files.agg(F.percentile_approx(used, [k / runs for k in range(1, runs)])).first()[0] if runs > 1 else []
    run = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(used))) if cuts else F.lit(0)
    rows = files.withColumn("_run", run)
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_run").agg(F.sum(size).alias("_sum"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))  # `runs` rows
    within = Window.partitionBy("_run").orderBy(used, key).rowsBetween(Window.unboundedPreceding, -1)
    gone = F.col("_before") + F.coalesce(F.sum(size).over(within), F.lit(0))
    kept = rows.join(F.broadcast(sums.select("_run", "_before")), "_run").withColumn("_gone", gone)
    return kept.filter(F.lit(total) - F.col("_gone") > budget * to).drop("_run", "_before", "_gone")
