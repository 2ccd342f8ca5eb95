import datetime as dt

from loomscore.operators import corpus, merge, validate
from loomscore.streaming import stream
from tests import oracle


def test_corpus_reasons(spark):
    long = "word " * 30
    rows = [
        (1, "g", "short", 50),
        (2, "g", long + "awful terrible boring", 90),
        (3, "g", long + "awful terrible boring", 40),
        (4, "g", (long + "awful  terrible boring").upper(), 40),
        (5, "g", "politics " * 20, 50),
        (6, "g", None, None),
        (7, None, long, None),
        (8, None, long, None),
    ]
    df = spark.createDataFrame(rows, "id long, g string, body string, score int")
    got = {r.id: r.reason for r in corpus.reject_reasons(df, "g", "id", "body", "score").collect()}
    assert got == {1: "too_short", 2: "score_text_mismatch", 3: None, 4: "duplicate", 5: "off_topic", 6: "too_short", 7: None, 8: "duplicate"}


def test_sample_keeps_strata_and_target(spark):
    day = dt.date(2024, 1, 1)
    rows = [(k, "g", "x" * (k % 900), 90 if k < 95 else 20, day + dt.timedelta(days=k)) for k in range(100)]
    df = spark.createDataFrame(rows, "id long, g string, body string, score int, day date")
    got = corpus.stratified_sample(df, "g", "id", "body", "score", "day", 20).collect()
    assert len(got) == 20
    assert any(r.score == 20 for r in got)


def test_validator(spark):
    d = dt.date(2024, 1, 1)
    evidence = [(k, "combat feels heavy and the combat music shines", d + dt.timedelta(days=20 * k)) for k in range(25)]
    claims = [
        (1, "combat feels heavy", [1, 2, 99]),
        (2, "combat feels heavy", [1, 1, 2]),
        (3, "reviews are mixed", [1, 2, 3]),
        (4, "combat improved over time", [1, 1, 1, 2, 3]),
        (5, 'they say "nothing like this at all"', [1, 2, 3]),
        (6, "story drags badly", [1, 2, 3]),
        (7, "combat feels heavy", [1, 2, 3]),
    ]
    got = validate.validate(
        spark.createDataFrame(claims, "claim_id long, claim string, refs array<long>"), spark.createDataFrame(evidence, "ref long, body string, date date")
    )
    assert {r.claim_id: r.outcome for r in got.collect()} == {
        1: "missing_ref",
        2: "low_support",
        3: "vague",
        4: "accepted",
        5: "quote_not_found",
        6: "aspect_unsupported",
        7: "accepted",
    }


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, x string, y int")
    delta = spark.createDataFrame([(2, None, 9), (3, "c", 3)], "k long, x string, y int")
    got = sorted(tuple(r) for r in merge.upsert(target, delta, ["k"], ["x"]).collect())
    assert got == [(1, "a", 1), (2, None, 2), (3, "c", 3)]


def test_state_machines_match_a_fold(spark, tmp_path):
    events = stream.open_events(spark, f"{oracle.DATA}/events.parquet*")
    machine = stream.limiter(3, 2 * 86400.0)
    got = {r.event_id: r.decision for r in stream.drain(stream.decide(events, machine), f"file://{tmp_path}").collect()}
    rows = spark.read.parquet(f"{oracle.DATA}/events.parquet").toPandas().sort_values(["ts", "event_id"])
    for _, own in rows.groupby("user_id"):
        want = stream.replay(machine, [(t.timestamp(), k) for t, k in zip(own["ts"].dt.tz_localize("UTC"), own["event_type"], strict=True)])
        assert want == [got[i] for i in own["event_id"]]
