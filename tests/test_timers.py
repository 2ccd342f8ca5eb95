"""Streams in event time: expiries without events, events out of order, restarts, the resumable log."""

import datetime as dt
import json
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomscore.streaming import eventlog, ordered, stream
from tests import oracle

SHAPE = "event_id long, ts timestamp, user_id long, event_type string"
START = dt.datetime(2024, 1, 1)
DAY = 86_400.0


def write(spark, path, rows):
    spark.createDataFrame([(k, START + dt.timedelta(seconds=t), u, kind) for k, t, u, kind in rows], SHAPE).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, folder, machine, delay="1 hour"):
    events = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(path)
    out = stream.drain(ordered.decide_in_order(events, machine, delay), folder)
    return sorted((r.key, (r.at - START).total_seconds(), r.event_id, r.decision) for r in out.filter("key >= 0").collect())


def folded(rows, machine, upto):
    own = defaultdict(list)
    for k, t, u, kind in rows:
        own[u].append((float(t), k, kind))
    return sorted((u, at, k, said) for u, events in own.items() if u >= 0 for at, k, said in ordered.replay(machine, sorted(events), upto))


LEASES = ordered.leases(7200.0, 2, "claim", "beat", "done", "fail")


def test_a_lease_runs_out_without_an_event(spark, tmp_path):
    path, folder = f"file://{tmp_path}/e", f"file://{tmp_path}/f"
    write(spark, path, [(1, 0, 7, "claim"), (2, 3600, 7, "beat"), (3, 100, 8, "claim"), (4, 200, 8, "done")])
    write(spark, path, [(5, 4 * 3600 + 1, -1, "tick")])  # only the clock goes on
    first = run(spark, path, folder, LEASES)
    assert first == [(7, 0.0, 1, "claimed"), (7, 3600.0, 2, "extended"), (7, 10800.0, None, "requeued"), (8, 100.0, 3, "claimed"), (8, 200.0, 4, "succeeded")]
    # Started again from the checkpoint: the state goes on, nothing is said twice.
    write(spark, path, [(6, 5 * 3600, 7, "claim"), (7, 5 * 3600, 8, "claim")])
    write(spark, path, [(8, 20 * 3600, -1, "tick")])
    assert run(spark, path, folder, LEASES) == sorted([*first, (7, 18000.0, 6, "claimed"), (7, 25200.0, None, "lost"), (8, 18000.0, 7, "refused")], key=lambda x: x[:2])


def test_order_of_delivery_changes_nothing(spark, tmp_path):
    """Several files, each out of order within the delay, against the fold over sorted events; one that comes too late changes nothing."""
    kinds = ["claim", "beat", "fail", "done", "other"]
    rows = [(k, (k * 977) % 90_000, k % 6, kinds[(k * 31) % 5]) for k in range(240)]
    pieces = defaultdict(list)
    for row in rows:
        pieces[max(0, (row[1] + (row[0] * 7919) % 3000 - 1500)) // 20_000].append(row)
    end = (10_000, 400_000, -1, "tick")
    for machine in (LEASES, ordered.breaker(2, 5000.0, "fail"), ordered.liveness(9000.0), ordered.untimed(stream.limiter(3, 20_000.0))):
        own = f"file://{tmp_path}/{id(machine)}"
        for k in sorted(pieces):
            write(spark, f"{own}/e", pieces[k])
        write(spark, f"{own}/e", [end])
        got = run(spark, f"{own}/e", f"{own}/f", machine)
        assert got == folded(rows, machine, 400_000 - 3600)
        write(spark, f"{own}/e", [(999, 5, 3, "claim"), (20_000, 500_000, -1, "tick")])
        late = run(spark, f"{own}/e", f"{own}/f", machine)
        assert [x for x in late if x not in got] in ([], [(3, 5.0, 999, "late")]) and len(late) <= len(got) + 1


@pytest.mark.parametrize("machine", [LEASES, ordered.breaker(2, 50.0, "fail"), ordered.liveness(50.0)])
def test_states_are_json(machine):
    """A state that has been written and read again goes on as it was."""
    state, due = machine.start, None
    for now, kind in enumerate(["claim", "fail", "fail", "beat", "done", "claim"]):
        state, _, due = machine.step(json.loads(json.dumps(state)), float(now), kind)
    if due is not None:
        machine.expire(json.loads(json.dumps(state)), due)


def log_of(spark, path, low, high):
    spark.range(low, high).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id")).coalesce(2).write.mode("append").parquet(path)


def ids(spark, path, folder, **options):
    schema = spark.range(0).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id")).schema
    return sorted(r.event_id for r in stream.drain(eventlog.follow(spark, path, schema, **options), folder).collect())


def test_a_log_is_followed_from_where_it_was_left(spark, tmp_path):
    path, folder = f"file://{tmp_path}/log", f"file://{tmp_path}/f"
    log_of(spark, path, 0, 900)
    assert ids(spark, path, folder, cursor=-1, rows_per_task=100) == list(range(900))
    assert ids(spark, path, folder, cursor=-1) == list(range(900))  # nothing new, nothing twice
    log_of(spark, path, 900, 1500)
    log_of(spark, path, 1500, 2800)
    assert ids(spark, path, folder, cursor=-1) == list(range(2800))
    log_of(spark, path, 2800, 4801)  # 2,001 wait: too far behind
    assert ids(spark, path, folder, cursor=-1) == list(range(2800))
    log_of(spark, path, 4801, 4901)
    assert ids(spark, path, folder, cursor=-1) == [*range(2800), *range(4801, 4901)]
    # Without a cursor a reader starts at the latest.
    assert ids(spark, path, f"file://{tmp_path}/g") == []
    log_of(spark, path, 4901, 4950)
    assert ids(spark, path, f"file://{tmp_path}/g") == list(range(4901, 4950))


def test_a_batch_that_failed_is_the_same_again(spark, tmp_path):
    """Stopped in the middle of a batch: the next run takes the batch as it was planned, then goes on."""
    path, folder = f"file://{tmp_path}/log", f"file://{tmp_path}/f"
    log_of(spark, path, 0, 300)
    schema = spark.read.parquet(path).schema
    seen = []

    def once(fail):
        def take(batch, _):
            if fail:
                raise RuntimeError("gone")
            seen.append(sorted(r.event_id for r in batch.collect()))

        rows = eventlog.follow(spark, path, schema, cursor=-1)
        return rows.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/o").trigger(availableNow=True).start()

    with pytest.raises(Exception, match="gone"):
        once(True).awaitTermination()
    log_of(spark, path, 300, 2600)  # more than the backlog wait by now, but the planned batch stands
    once(False).awaitTermination()
    assert seen[0] == list(range(300))
    assert [x for batch in seen[1:] for x in batch] in ([], list(range(300, 2600)))


def test_offsets():
    """What the reader plans, without a stream: limits after the first batch, the jump, ids dealt over tasks."""
    reader = eventlog.LogReader(type("S", (), {"names": ["event_id"]}), {"path": "x", "cursor": "5", "backlog": "50", "limit": "10", "rows_per_task": "20"})
    reader.latest_id = lambda: 45
    start, end = reader.initialOffset(), reader.latestOffset()
    assert (start, end) == ({"upto": 5, "first": False}, {"upto": 45, "first": True})
    assert [(p.after, p.upto) for p in reader.partitions(start, end)] == [(5, 25), (25, 45)]
    reader.latest_id = lambda: 500
    assert reader.latestOffset() == {"upto": 55, "first": False}
    assert [(p.after, p.upto) for p in reader.partitions({"upto": 45}, {"upto": 500, "first": False})] == [(k, min(k + 20, 500)) for k in range(45, 500, 20)]
    assert [(p.after, p.upto) for p in reader.partitions({"upto": 45}, {"upto": 500, "first": True})] == [(500, 500)]


def test_streaming_queries_have_sql():
    from loomscore.plans import registry

    names = {"stream_heartbeats", "stream_leases", "stream_half_open", "stream_shuffled", "stream_resumed"}
    assert names <= set(registry.ORACLE_SQL) and oracle.DATA


@pytest.fixture
def events_in_many_files(spark, tmp_path):
    """The events by time in twelve files, each a part of its own."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    rows = spark.read.parquet(f"{oracle.DATA}/events.parquet")
    for k, row in enumerate(rows.selectExpr("ntile(12) OVER (ORDER BY ts) AS k", "event_id").groupBy("k").agg(F.collect_list("event_id").alias("ids")).orderBy("k").collect()):
        rows.filter(F.col("event_id").isin(row.ids)).coalesce(1).write.parquet(f"{tmp_path}/events.parquet/part-{k:02}.parquet")
    for file in tmp_path.glob("events.parquet/*/*.parquet"):
        file.rename(tmp_path / "events.parquet" / f"{file.parent.name}-{file.name}")
    for folder in [x for x in tmp_path.glob("events.parquet/*") if x.is_dir()]:
        for file in folder.iterdir():
            file.unlink()
        folder.rmdir()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "16384")
    yield str(tmp_path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_table_in_many_files_loses_no_event(spark, events_in_many_files):
    """A piece of the delivery has a file for each part: read in part only, its last days were decided before its first had come."""
    from loomscore.plans import registry

    assert spark.read.parquet(f"{events_in_many_files}/events.parquet").rdd.getNumPartitions() > 8
    oracle.check(registry.QUERIES["stream_half_open"](spark, events_in_many_files), registry.ORACLE_SQL["stream_half_open"], oracle.connect())


def test_keys_dealt_over_any_groups(spark, tmp_path):
    """Calls of Python are as many as the groups, not the keys: two groups, one, and one for each key say the same."""
    rows = [(k, (k * 977) % 50_000, k % 23, ["claim", "beat", "fail"][k % 3]) for k in range(150)]
    write(spark, f"file://{tmp_path}/e", rows)
    write(spark, f"file://{tmp_path}/e", [(999, 300_000, -1, "tick")])
    for groups in (1, 2, 1024):
        events = spark.readStream.schema(SHAPE).parquet(f"file://{tmp_path}/e")
        out = stream.drain(ordered.decide_in_order(events, LEASES, "1 hour", groups=groups), f"file://{tmp_path}/{groups}")
        got = sorted((r.key, (r.at - START).total_seconds(), r.event_id, r.decision) for r in out.filter("key >= 0").collect())
        assert got == folded(rows, LEASES, 300_000 - 3600)


def test_a_long_row_group_is_read_piece_by_piece(tmp_path):
    whole = pa.table({"event_id": range(100_000), "user_id": ["u"] * 100_000, "at": [0.5] * 100_000})
    pq.write_table(whole, tmp_path / "a.parquet", row_group_size=100_000)
    later = pa.table({"event_id": pa.array([100_000, None, 100_001], pa.int32())})  # another type, and no other columns
    pq.write_table(later, tmp_path / "b.parquet", write_statistics=False)
    reader = eventlog.LogReader(type("S", (), {"names": ["user_id", "event_id"]}), {"path": str(tmp_path)})
    batches = list(reader.read(eventlog.Ids(10, 100_001)))
    rows = pa.Table.from_batches(batches)
    assert rows["event_id"].to_pylist() == list(range(11, 100_002)) and rows["user_id"].to_pylist() == ["u"] * 99_989 + [None] * 2
    assert max(b.num_rows for b in batches) <= 10_000  # before, as many as the group has
    assert list(reader.read(eventlog.Ids(200_000, 200_001))) == [] == list(reader.read(eventlog.Ids(7, 7)))
