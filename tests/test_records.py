"""Parsers, pages, state and schedules on small rows written here."""

import dataclasses
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from loomscore.functions import records
from loomscore.operators import catalog, detail, merge, monitor, ops, schedule, similarity, snapshots
from loomscore.plans.registry import QUERIES
from loomscore.settings import DEFAULT
from loomscore.sources import details
from loomscore.streaming import stream


def detail_payload(**own):
    item = {"id": 7, "slug": "a-b", "title": "A & B", "platforms": [], "genres": [], "images": []} | own
    return json.dumps({"components": [{"meta": {"componentName": "nav"}, "data": {"items": [1]}}, {"meta": {"componentName": "product"}, "data": {"item": item}}]})


@pytest.fixture(scope="module")
def payloads(spark):
    lead = lambda *flags: [{"name": f"Shop {k}", "isLeadPlatform": f, "criticScoreSummary": {"score": 88.5, "reviewCount": None}} for k, f in enumerate(flags)]
    rows = [
        detail_payload(slug="none", platforms=lead(False, False)),
        detail_payload(slug="two", platforms=lead(False, True, True)),
        detail_payload(slug="unrated", platforms=[{"name": "Shop 9", "releaseDate": ""}], releaseDate="", description=" <i>x</i>\r\n\r\n\r\n\r\ny "),
        detail_payload(slug="firms", production={"companies": [{"name": "Acme", "typeName": "Developer"}, {"name": "acme", "typeName": "developer"}, {"name": "Acme", "typeName": "Publisher"}]}),
        detail_payload(slug="bare", images=[{"bucketPath": "first.jpg", "typeName": "x"}, {"bucketPath": "", "typeName": "mainImage"}]),
        json.dumps({"components": [{"meta": {"componentName": "nav"}}]}),
        "no json",
    ]
    return spark.createDataFrame([(r,) for r in rows], "body string")


def test_exactly_one_lead(payloads):
    got = {}
    for r in details.detail_channels(payloads).collect():
        got.setdefault(r.slug, []).append((r.position, r.is_lead, r.score, r.n_reviews))
    assert sorted(got["none"]) == [(0, True, 88, 0), (1, False, 88, 0)]
    assert sorted(got["two"]) == [(0, False, 88, 0), (1, True, 88, 0), (2, False, 88, 0)]
    assert got["unrated"] == [(0, True, None, 0)]


def test_details_parse_once_and_carry_no_lists(payloads):
    """A condition on the product parses nothing anew, and a channel's row does not carry the list of all."""
    plan = details.detail_channels(payloads)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    above = plan[: plan.index("Generate posexplode")]
    assert "lead#" in above and "all#" not in above


def test_a_print_is_made_where_its_payload_lies(spark):
    """Each payload was parsed four times and its lists went through shuffles and joins to become one print."""
    firms = [{"name": "Acme É", "typeName": "Developer"}, {"name": "acme e", "typeName": "developer"}, {"name": None}]
    one = {"platforms": [{"name": "Shop ﬁ", "criticScoreSummary": {"score": 88.5}}, {"slug": "x", "name": None}, None], "genres": [{"name": "A\x1fB"}, {"name": None}], "production": {"companies": firms}}
    other = {k: v[::-1] for k, v in one.items() if k != "production"} | {"production": {"companies": firms[1:]}, "userScore": {"score": 7}}
    rows = [detail_payload(**one), detail_payload(**other), detail_payload(**one | {"genres": [{"name": "A B C"}]}), detail_payload(**one | {"platforms": []}), "no json", None]
    made = details.change_fingerprint(spark.createDataFrame(list(enumerate(rows)), "k int, text string"), "text")
    assert made.columns == ["k", "text", "slug", "print"]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and "Join" not in plan and "Aggregate" not in plan
    got = {r.k: r.print for r in made.collect()}
    assert set(got) == {0, 1, 2, 3} and got[0] == got[1] and len(set(got.values())) == 3
    said = {"slug": "a-b", "title": "A & B", "channels": "-:0|shop-fi:88:0|x:-:0", "tags": "a-b", "companies": "developer:acme-e|publisher"}
    fields = {n: F.lit(said.get(n)) for n in ("slug", "title", "description", "cover", "video_url", "release_date", "rating", "franchise", "channels", "tags", "companies")}
    assert got[0] == spark.range(1).select(records.fingerprint(fields)).first()[0]


def test_a_changed_payload_meets_its_former_self_without_a_join(spark):
    found = QUERIES["change_fingerprint"](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 2  # eight before


def test_details(payloads):
    rows = {r.slug: r for r in details.detail_items(payloads).collect()}
    assert set(rows) == {"none", "two", "unrated", "firms", "bare"}
    assert rows["none"].title_norm == "a and b" and rows["unrated"].release_date is None
    assert rows["unrated"].description == "x\n\ny"
    assert (rows["bare"].cover, rows["bare"].card, rows["none"].cover) == ("first.jpg", "first.jpg", None)
    assert details.drifted(payloads).count() == 2
    firms = sorted((r.company, r.role, r.position) for r in details.detail_companies(payloads).collect())
    assert firms == [("acme", "developer", 0), ("acme", "publisher", 2)]


def test_reviews(spark):
    critics = {"data": {"items": [{"quote": "Fine.", "publicationName": "The Daily", "date": "2024-01-02", "score": 80}, {"quote": "", "publicationName": ""}, {"quote": None, "publicationSlug": "x"}]}}
    players = {"data": {"items": [{"id": "r1", "quote": "ok", "score": 7}, {"id": "", "quote": "ok", "author": "me"}, {"id": None, "quote": " "}]}}
    df = spark.createDataFrame([(1, json.dumps(critics), json.dumps(players))], "page long, critics string, players string")
    got = details.critic_reviews(df, "page", "critics").collect()
    assert [(r.publication, r.score, r.published) for r in got] == [("the-daily", 80.0, dt.date(2024, 1, 2)), ("x", None, None)]
    got = details.player_reviews(df, "page", "players").collect()
    assert [(r.key == "r1", r.score_100, r.is_spoiler) for r in got] == [(True, 70.0, False), (False, None, False)] and len(got[1].key) == 64


def test_payload_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x":\n 1}')
    (tmp_path / "b.json").write_text('{"x": 2}\n\n{"x": 3}\n')
    got = sorted(json.loads(r.body)["x"] for r in details.read_payloads(spark, str(tmp_path)).collect())
    assert got == [1, 2, 3]


def test_pages():
    assert detail.page_numbers(1, 1) == [1]
    assert detail.page_numbers(6, 12) == [1, None, 4, 5, 6, 7, 8, None, 12]


def test_deep_pages_are_refused(spark):
    rows = spark.range(3).withColumnRenamed("id", "item_id")
    with pytest.raises(ValueError):
        detail.page(rows, [F.col("item_id")], 10_001, 5)
    with pytest.raises(ValueError):
        catalog.sorted_page(rows, "score", 10_001)
    assert detail.page(rows, [F.col("item_id")], 10_000, 5).collect() == []
    assert [(r.total, r.has_more) for r in detail.page(rows, [F.col("item_id")], 0, 2).collect()] == [(3, True)] * 2


def test_redaction(spark):
    said = {"user": "me", "llm_api_key": "x", "x_keys": "z", "my_tokens": ["z"], "inner": [{"Token": "y", "note": "monkey"}], "deep": {"a": {"b": {"c": {"d": {"e": {"f": {"token": "kept"}}}}}}}}
    got = spark.createDataFrame([(json.dumps(said),), ("no json",), (None,)], "x string").select(records.redact_json("x")).collect()
    clean = json.loads(got[0][0])
    assert clean["x_keys"] == clean["my_tokens"] == clean["llm_api_key"] == clean["inner"][0]["Token"] == "***" and clean["inner"][0]["note"] == "monkey" and clean["user"] == "me"
    assert clean["deep"]["a"]["b"]["c"]["d"]["e"]["f"]["token"] == "kept"
    assert [r[0] for r in got[1:]] == ["no json", None]


def test_sentence_trim(spark):
    rows = [("One two. Three four five",), ("No end in here at all",), ("Short.",), ("A. " + "b" * 30,), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(records.trim_to_sentence("x", 12)).collect()]
    assert got == ["One two.", "No end in here at all", "Short.", "A. " + "b" * 30, None]


def test_cron(spark):
    times = ["2024-02-25 04:15:00", "2024-02-26 04:15:00", "2024-03-01 05:00:00", "2024-09-01 05:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp").alias("t"))
    for fields in (schedule.compiled, lambda cron: schedule.parsed(F.lit(cron))):
        hit = lambda cron, of=fields: [r[0] for r in df.select(schedule.matches("t", of(cron))).collect()]
        assert hit("15 4 * * 0") == hit("15 4 * * 7") == [True, False, False, False]
        assert hit("0 5 1 * 0") == [False, False, False, True]  # the day of the month and that of the week
        assert hit("*/5 4-5 * 2 *") == [True, True, False, False]
    bad = ["", "* * * *", "60 * * * *", "* * 0 * *", "a * * * *", "*/0 * * * *", "5-1 * * * *", "* * * * 8", "1,,2 * * * *"]
    got = spark.createDataFrame([(b,) for b in [*bad, None]], "cron string").select(schedule.parsed("cron").isNull()).collect()
    assert all(r[0] for r in got)
    for cron in bad:
        with pytest.raises(ValueError):
            schedule.compiled(cron)


def test_next_runs(spark):
    after = "2024-02-28 23:59:30"
    want = {
        "* * * * *": "2024-02-29 00:00:00",
        "30 4 29 2 *": "2024-02-29 04:30:00",
        "0 0 29 2 1": "2044-02-29 00:00:00",
        "0 0 31 4 *": None,
        "59 23 28 * *": "2024-03-28 23:59:00",
        "15,45 */6 * * 6,0": "2024-03-02 00:15:00",
        "10-20/5 8 1 1 *": "2025-01-01 08:10:00",
        "0 5 1 * *": "2024-03-01 05:00:00",
        "nonsense": None,
    }
    rows = spark.createDataFrame([(c,) for c in want], "cron string")
    got = {r.cron: r.next_at and str(r.next_at) for r in schedule.next_runs(rows, "cron", F.lit(after)).collect()}
    assert got == want
    early = schedule.next_runs(rows, "cron", F.lit("2024-02-28 10:00:00")).collect()
    assert {r.cron: str(r.next_at) for r in early}["59 23 28 * *"] == "2024-02-28 23:59:00"
    near = {r.cron: r.next_at for r in schedule.next_runs(rows, "cron", F.lit(after), years=3).collect()}
    assert near["0 0 29 2 1"] is None and near["0 5 1 * *"] is not None


def test_health_chain(spark):
    now = "2024-01-02 00:00:00"
    runs = lambda *r: spark.createDataFrame(r, "status string, started_at timestamp")
    workers = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23, 59),)], "heartbeat_at timestamp")
    events = spark.createDataFrame([(k, "error") for k in range(12)] + [(20, "ok")], "event_id long, kind string")
    ok = ("succeeded", dt.datetime(2024, 1, 1, 23))
    streak = lambda sound: monitor.drift_streak(events, F.col("kind") == "error", (F.col("kind") == "ok") & F.lit(sound))
    state = lambda r, w, p, sound=True: tuple(monitor.health(r, w, p, streak(sound), now).first())[:2]
    none = events.limit(0)
    assert state(runs(ok), workers, none) == ("healthy", "none")
    assert state(runs(ok), workers, none, False) == ("down", "drift")
    assert state(runs(("failed", ok[1])), workers, none) == ("degraded", "never_run")
    assert state(runs(("partial", dt.datetime(2024, 1, 1, 20))), workers, none) == ("down", "stale")
    assert state(runs(ok), workers.limit(0), none) == ("degraded", "no_workers")
    assert state(runs(ok), workers, events) == ("degraded", "problems")


def test_versions_demote_only_for_what_is_fresh(spark):
    history = spark.createDataFrame([(1, "a", "fresh", 4, True)], "g long, fingerprint string, status string, version long, is_current boolean")
    save = lambda *rows: sorted((r.fingerprint, r.version, r.is_current) for r in snapshots.save_versions(history, spark.createDataFrame(rows, "g long, fingerprint string, status string"), ["g"]).collect())
    assert save((1, "b", "failed")) == [("a", 4, True), ("b", 5, False)]
    assert save((1, "b", "fresh"), (1, "a", "fresh")) == [("a", 4, False), ("b", 5, True)]
    assert save((1, "a", "fresh")) == [("a", 4, True)]


def test_similarity_parts(spark):
    make = lambda k, **own: {"item_id": k, "tags": ["x"], "series": None, "makers": [], "publishers": [], "channels": [], "score": 80, "year": 2000, "words": ["a"], "family": None, "n_reviews": 9, "aspects": None} | own
    rows = [
        make(1, series="s"), make(2, series="s", aspects={"story": "positive"}), make(3, family=5, publishers=["p"]), make(4, family=5, publishers=["p"]),
        make(5, score=None, n_reviews=1), make(6, score=None, n_reviews=2), make(7, tags=[], series=None), make(8, aspects={"story": "positive", "sound": "absent"}),
    ]
    shape = "item_id long, tags array<string>, series string, makers array<string>, publishers array<string>, channels array<string>, score int, year int, words array<string>, family long, n_reviews long, aspects map<string,string>"
    items = spark.createDataFrame(rows, shape)
    branches = [("tags", 300), ("makers", 100), ("family", 20), ("series", 20)]
    pairs = similarity.candidates(items, branches)
    found = {(r.item_id, r.other_id) for r in pairs.collect()}
    assert {b for a, b in found if a == 7} == {1, 2, 3, 4, 8}  # nothing shared: the best scored
    got = {(r.item_id, r.other_id): r for r in similarity.similar(items, pairs).collect()}
    assert got[1, 2].reason == "same_series" and got[1, 2].components.aspect is None
    assert got[3, 4].components.penalty == 0.5 and got[3, 4].components.makers == 0.5 and got[3, 4].components.series == 0.9
    assert got[2, 8].components.aspect == 1.0
    assert (5, 6) not in got or got[5, 6].components.penalty == 0.35


def test_link_changes_sort_nothing(spark):
    have = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (None, 3)], "a long, b long")
    want = spark.createDataFrame([(2, 2), (4, 4), (4, 4), (None, 3)], "a long, b long")
    found = merge.link_changes(have, want, ["a", "b"])
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(1, 1, "delete"), (4, 4, "insert"), (None, 3, "insert"), (None, 3, "delete")], key=repr)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # before, two joins with both sides sorted in one task


def test_similar_among_makes_few_pairs(spark):
    """The same rows as from all pairs, where many items share values; before, every candidate of every item became a row with both items' features."""
    rows = [
        (k, [f"t{k % 3}", f"u{k % 2}"] if k % 11 else [], f"s{k % 4}" if k % 5 else None, ["m"] if k % 7 else [], [f"p{k % 2}"], [f"c{k % 3}"], k * 31 % 101 if k % 6 else None,
         1990 + k % 30 if k % 13 else None, [f"w{k % 4}", "x"], k % 9 if k % 4 else None, k % 8, {"story": ("positive", "negative", "absent")[k % 3]} if k % 3 else None)
        for k in range(400)
    ]
    shape = "item_id long, tags array<string>, series string, makers array<string>, publishers array<string>, channels array<string>, score int, year int, words array<string>, family long, n_reviews long, aspects map<string,string>"
    items, branches = spark.createDataFrame(rows, shape), [("tags", 60), ("makers", 30), ("family", 20), ("series", 20)]
    narrow = dataclasses.replace(DEFAULT, similar_candidates=90, similar_top=5)
    seen = []
    pairs = similarity.candidates(items, branches, 90)
    want = sorted(map(tuple, similarity.similar(items, pairs, narrow).select("item_id", "other_id", "similarity", "rank", "reason").collect()), key=repr)
    plain, similarity.similar = similarity.similar, lambda i, p, s: seen.append(p.count()) or plain(i, p, s)
    try:
        got = similarity.similar_among(items, branches, narrow)
    finally:
        similarity.similar = plain
    assert sorted(map(tuple, got.select("item_id", "other_id", "similarity", "rank", "reason").collect()), key=repr) == want
    assert seen[0] * 2 < pairs.count()


def test_late_events_change_nothing(spark, tmp_path):
    """The second file is older than the first: its events are late, whatever the machine would have said."""
    shape = "user_id long, event_id long, event_type string, ts timestamp"
    day = lambda k: dt.datetime(2024, 1, k)
    src = f"file://{tmp_path}/in"
    spark.createDataFrame([(1, 1, "a", day(5)), (1, 2, "a", day(6))], shape).coalesce(1).write.parquet(src)
    machine = stream.limiter(5, 864000.0)
    read = lambda: stream.decide(spark.readStream.schema(shape).parquet(src), machine)
    stream.drain(read(), f"file://{tmp_path}/out")
    spark.createDataFrame([(1, 3, "a", day(4)), (1, 4, "a", day(7))], shape).coalesce(1).write.mode("append").parquet(src)
    got = {r.event_id: r.decision for r in stream.drain(read(), f"file://{tmp_path}/out").collect()}
    assert got == {1: "admitted", 2: "admitted", 3: "late", 4: "admitted"}


def test_evict_over_runs(spark):
    rows = [(k, (k * 7919) % 1000, 1 + k % 9) for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, used long, size long")
    total = sum(s for *_, s in rows)
    left, want = total, set()
    for i, _, s in sorted(rows, key=lambda r: (r[1], r[0])):
        if left <= 3000 * 0.8:
            break
        want.add(i)
        left -= s
    assert {r.id for r in ops.evict(df, "size", "used", "id", 3000, run_rows=50).collect()} == want
    assert ops.evict(df, "size", "used", "id", total).count() == 0


def test_merges_of_repeats(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (2, "c", 2)], "k long, v string, seq long")
    assert sorted(tuple(r) for r in merge.last_wins(df, ["k"], "seq").collect()) == [(1, "b", 3), (2, "c", 2)]


def test_schedules_are_read_once_and_dealt(spark):
    """Each field's pattern is looked for once, and rows that lie in one task are worked on by many."""
    rows = spark.range(40, numPartitions=1).select("id", F.concat(F.col("id").cast("string"), F.lit(" 6-10/2,20 * * 1,7")).alias("cron"))
    found = schedule.next_runs(rows, "cron", F.lit("2024-02-26 10:07:00"), years=1)
    assert found.rdd.getNumPartitions() > 1
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 5 * 4
    assert {r.next_at for r in found.collect()} == {dt.datetime(2024, 2, 26, 10 if k > 7 else 20, k) for k in range(40)}
