"""Structured Streaming over event tables: sources with a resumable cursor, and keyed state machines.

The state machines are folds over a key's events in time order; each micro-batch continues from the stored state, so
no more than one batch of a key is in a task. The offset log and the state store give exactly-once restarts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[tuple, float, str], tuple[tuple, str]]


def limiter(limit: int, seconds: float) -> tuple[Step, tuple, str]:
    """Admits at most `limit` events in so many seconds; refused events do not count."""

    def step(state: tuple, now: float, kind: str) -> tuple[tuple, str]:
        hits = [t for t in state[0] if t > now - seconds]
        if len(hits) < limit:
            return ([*hits, now],), "admitted"
        return (hits,), "refused"

    return step, ([],), "hits array<double>"


def token_bucket(rate: float, burst: float) -> tuple[Step, tuple, str]:
    """Refills `rate` tokens a second up to `burst`; each event takes one or has to wait."""

    def step(state: tuple, now: float, kind: str) -> tuple[tuple, str]:
        tokens, last, used = state
        if used:
            tokens = min(burst, tokens + max(0.0, now - last) * rate)
        return ((tokens - 1, now, True), "taken") if tokens >= 1 else ((tokens, now, True), "wait")

    return step, (burst, 0.0, False), "tokens double, last double, used boolean"


def breaker(failures: int, seconds: float, failing: str = "error") -> tuple[Step, tuple, str]:
    """Closed until so many failures in a row; then open for so many seconds; then half open, where one event decides."""

    def step(state: tuple, now: float, kind: str) -> tuple[tuple, str]:
        count, is_open, opened = state
        if is_open and now - opened < seconds:
            return state, "open"
        if kind == failing:
            count = count + 1
            return ((count, True, now), "tripped") if is_open or count >= failures else ((count, False, 0.0), "closed")
        return (0, False, 0.0), "closed"

    return step, (0, False, 0.0), "count long, is_open boolean, opened double"


def decide(events: DataFrame, machine: tuple[Step, tuple, str], key: str = "user_id", ts: str = "ts", kind: str = "event_type", seq: str = "event_id") -> DataFrame:
    """(key, event_id, decision) of a stream of events under a keyed state machine.

    Within a micro-batch a key's events are taken in time order, so they are held together: what the source gives for one trigger
    bounds them. An event older than the last one decided in an earlier batch is `late` and changes nothing."""
    step, start, shape = machine
    rows = events.select(
        F.col(key).alias("key"), F.col(seq).alias("event_id"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("now"), F.col(kind).alias("kind")
    )

    def run(name: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *own, upto = (list(x) if hasattr(x, "tolist") else x for x in state.get) if state.exists else (*start, float("-inf"))
        own, before = tuple(own), upto
        batch = pd.concat(list(frames)).sort_values(["now", "event_id"])
        said = []
        for now, what in zip(batch["now"], batch["kind"], strict=True):
            if now < before:
                said.append("late")
                continue
            own, outcome = step(own, float(now), what)
            upto = float(now)
            said.append(outcome)
        state.update((*own, upto))
        yield pd.DataFrame({"key": name[0], "event_id": batch["event_id"].to_numpy(), "decision": said})

    return rows.groupBy("key").applyInPandasWithState(
        run, "key long, event_id long, decision string", f"{shape}, upto double", "append", GroupStateTimeout.NoTimeout
    )


def replay(machine: tuple[Step, tuple, str], rows: Iterable[tuple[float, str]]) -> list[str]:
    """The decisions on (now, kind) rows of one key, as a plain fold (for checking)."""
    step, state, _ = machine
    out = []
    for now, kind in rows:
        state, said = step(state, now, kind)
        out.append(said)
    return out


def open_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream over a Parquet path; its offset log is the resume cursor, files a batch bound the backlog."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def deliver_once(events: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Events without repeats of a key that come within `late`; state older than that is dropped."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


#: Whether a stream runs on without new events as long as its watermark moves.
GOES_ON = "spark.sql.streaming.noDataMicroBatches.enabled"


def drain(stream: DataFrame, folder: str, mode: str = "append", ending: bool = True) -> DataFrame:
    """Run what is available through to Parquet under folder, and read the result.

    Without `ending`, what only waits for the watermark is left to the next run on that folder."""
    spark = stream.sparkSession
    before = spark.conf.get(GOES_ON)
    spark.conf.set(GOES_ON, str(ending and before == "true").lower())
    try:
        writer = stream.writeStream.trigger(availableNow=True).outputMode(mode).option("checkpointLocation", f"{folder}/offsets")
        if mode == "append":
            started = writer.format("parquet").option("path", f"{folder}/rows").start()
        else:
            started = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/rows")).start()
        started.awaitTermination()
    finally:
        spark.conf.set(GOES_ON, before)
    return spark.read.parquet(f"{folder}/rows")
