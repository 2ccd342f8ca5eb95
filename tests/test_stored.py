"""Merges on repeats and nulls, tables on storage through crashes, the maintained rollup, title search, facets, sliding sums."""

import os
import subprocess
import sys
import textwrap
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomscore.operators import catalog, corpus, merge, ops, stored, titles
from loomscore.plans import base

ROW = "k long, x string, y int"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_delta_that_repeats_its_keys(spark):
    target = spark.createDataFrame([(1, "a", 1), (None, "n", 0)], ROW)
    delta = spark.createDataFrame([(1, "b", 5), (1, "c", 4), (2, "d", 1), (2, "e", 1), (2, "e", 1), (None, "m", 7), (None, "m", 7)], ROW)
    new = [(None, "m", 7), (None, "m", 7)]
    assert rows_of(merge.insert_ignore(target, delta, ["k"])) == sorted([(2, "d", 1), *new], key=str)
    assert rows_of(merge.insert_ignore(target, delta.withColumn("s", -F.col("y")), ["k"], "s").drop("s")) == sorted([(2, "d", 1), *new], key=str)
    assert rows_of(merge.upsert(target, delta, ["k"], ["x", "y"])) == sorted([(1, "c", 4), (2, "e", 1), (None, "n", 0), *new], key=str)
    assert rows_of(merge.upsert(target, delta, ["k"], ["x", "y"], seq="y")) == sorted([(1, "b", 5), (2, "e", 1), (None, "n", 0), *new], key=str)
    assert rows_of(merge.upsert(target, delta, ["k"], ["x"], {"x": F.col("y") > 100})) == sorted([(1, "a", 1), (2, "e", 1), (None, "n", 0), *new], key=str)
    keys = delta.select("k")
    assert rows_of(merge.one_each(keys, ["k"])) == [(1,), (2,), (None,), (None,)]


def table_of(spark, path, n=200):
    return stored.StoredTable(spark, path, ["k"], buckets=8).create(spark.range(n).select(F.col("id").alias("k"), F.lit("old").alias("x"), F.lit(1).alias("y")))


def files(path):
    return {p: (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(path.removeprefix("file://")).rglob("*.parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    table = table_of(spark, path)
    before = files(path)
    delta = spark.createDataFrame([(3, "new", 9), (3000, "new", 9)], ROW)
    table.upsert(delta, ["k"], ["x"])
    own = {f"_bucket={b}" for b in table.touched(delta)}
    after = files(path)
    assert {p.parent.name for p in before if before[p] != after.get(p)} == own and len(own) <= 2
    assert rows_of(table.read()) == rows_of(spark.createDataFrame([(k, "new" if k == 3 else "old", 1) for k in range(200)] + [(3000, "new", 9)], ROW))
    assert table.insert_ignore(delta, ["k"]).collect() == [] and files(path).keys() >= after.keys()
    everything = spark.range(5000).select(F.col("id").alias("k"))
    table.replace_groups(delta.limit(0), everything)  # every group is empty afterwards
    assert table.read().collect() == []
    table.upsert(spark.createDataFrame([(None, "n", 1), (None, "n", 1)], ROW), ["k"], ["x"])
    assert rows_of(table.read()) == [(None, "n", 1), (None, "n", 1)]


class Died(Exception):
    pass


@pytest.mark.parametrize("where", ["before it is told", "after it is told", "between buckets"])
def test_a_write_that_dies(spark, tmp_path, monkeypatch, where):
    path = f"file://{tmp_path}/t"
    table = table_of(spark, path)
    old, groups = rows_of(table.read()), spark.range(0, 200, 2).select(F.col("id").alias("k"))
    new = groups.filter("k % 4 = 0").select("k", F.lit("new").alias("x"), F.lit(2).alias("y"))
    want = [r for r in old if r[0] % 2] + [(k, "new", 2) for k in range(0, 200, 4)]

    def die(*_):
        raise Died

    with monkeypatch.context() as m:
        if where == "before it is told":
            m.setattr(stored._Folder, "put", die)
        elif where == "after it is told":
            m.setattr(stored.StoredTable, "_overwrite", die)
        else:
            m.setattr(stored._Folder, "delete", lambda self, name, plain=stored._Folder.delete: die() if name.startswith("rows/") or name == "change/told" else plain(self, name))
        with pytest.raises(Died):
            table.replace_groups(new, groups)
    again = stored.StoredTable(spark, path, ["k"], buckets=8)
    assert rows_of(again.read()) == (old if where == "before it is told" else sorted(want, key=str))
    assert not Path(f"{tmp_path}/t/change").exists()
    again.replace_groups(new, groups)
    assert rows_of(again.read()) == sorted(want, key=str)


def test_a_process_that_is_killed(spark, tmp_path):
    """Another process is gone in the middle of a change; what it had told is finished by the next one."""
    path = f"file://{tmp_path}/t"
    table_of(spark, path)
    script = f"""
    import os
    from pyspark.sql import SparkSession, functions as F
    from loomscore.operators import stored
    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    stored.StoredTable._overwrite = lambda self: os._exit(9)
    stored.StoredTable(spark, "{path}", ["k"], buckets=8).upsert(spark.createDataFrame([(7, "new", 1)], "{ROW}"), ["k"], ["x"])
    """
    root = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, timeout=180, check=False)
    assert done.returncode == 9, done.stderr[-2000:]
    assert Path(f"{tmp_path}/t/change/told").exists()
    assert dict((r.k, r.x) for r in stored.StoredTable(spark, path, ["k"], buckets=8).read().collect()) == {k: "new" if k == 7 else "old" for k in range(200)}


CHANNEL = "item_id long, channel_id long, critic int, critic_count long, user double, user_count long, is_lead boolean"


def test_the_rollup_is_kept_up(spark, tmp_path):
    import numpy as np

    r = np.random.default_rng(5)
    made = lambda item, channel: (item, channel, None if r.random() < 0.2 else int(r.integers(0, 100)), int(r.integers(0, 9)), None if r.random() < 0.4 else float(r.integers(0, 11)), int(r.integers(0, 3)), bool(r.random() < 0.3))
    state = {(i, c): made(i, c) for i in range(60) for c in range(int(r.integers(1, 5)))}
    path = f"file://{tmp_path}/r"
    kept = stored.MaintainedRollup(spark, path, buckets=8).create(spark.createDataFrame(list(state.values()), CHANNEL))
    for _ in range(3):
        items = sorted({int(x) for x in r.integers(0, 70, 3)})
        delta = [made(i, c) for i in items for c in sorted({int(x) for x in r.integers(0, 6, 3)})]
        before = files(path)
        kept.apply(spark.createDataFrame(delta, CHANNEL))
        moved = {p.parent.name for p, x in before.items() if files(path).get(p) != x}
        assert moved <= {f"_bucket={b}" for b in kept.channels.touched(spark.createDataFrame([(i,) for i in items], "item_id long"))}
        for key in [k for k in state if k[0] in items]:
            state[key] = (*state[key][:6], False)
        for row in delta:
            old = state.get(row[:2])
            state[row[:2]] = row if old is None or row[4] is not None or row[5] > 0 else (*row[:4], *old[4:6], row[6])
        whole = catalog.rollup(spark.createDataFrame(list(state.values()), CHANNEL))
        assert rows_of(kept.read()) == rows_of(whole)


def likeness(a, b):
    def grams(x):
        words = "".join(c if c.isascii() and c.isalnum() else " " for c in x.lower()).split()
        return {p[i : i + 3] for w in words for p in [f"  {w} "] for i in range(len(p) - 2)}

    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def test_title_search_of_many(spark, tmp_path):
    import numpy as np

    r = np.random.default_rng(2)
    words = ["red", "blue", "widget", "widgets", "gear", "gearbox", "storm", "stormy", "night", "knight", "of", "x", "a1", "é", "the"]
    title = lambda: " ".join(r.choice(words, r.integers(1, 5)))
    own, asked = [title() for _ in range(150)] + ["", None, "!!", "Red  Widget", "red widget"], [title() for _ in range(60)] + ["", None, "RED WIDGET", "zzz"]
    df = lambda x, c: spark.createDataFrame([(k, t) for k, t in enumerate(x)], f"id int, {c} string")
    for least in (0.25, 0.6):
        index = titles.trigram_index(df(own, "name"), "name", least).write(f"file://{tmp_path}/{least}")
        found = {(x.needle, x.title): x.likeness for x in titles.resembling(index, df(asked, "needle"), "needle").collect()}
        want = {(a, b): likeness(a, b) for a in asked if a is not None for b in own if b is not None and likeness(a, b) > least}
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)
    # No pair outside the bounds is made: sizes, and what is left after the first common trigram.
    needles = titles._ordered(df(asked, "needle"), "needle", index.ranks)
    sizes = {x.title: len(x.grams) for x in index.sets.collect()} | {x.title: len(x.grams) for x in needles.collect()}
    made = [tuple(x) for x in titles.candidates(index, needles).collect()]
    assert set(want) <= set(made) and all(sizes[a] > 0.6 * sizes[b] and sizes[b] > 0.6 * sizes[a] for a, b in made)
    assert len(made) < 0.2 * len(set(asked)) * len(set(own))
    best = titles.search_all(index, df(asked, "needle"), "needle", df(own, "name"), "name", most=1).select("needle", "title").distinct().collect()
    assert {x.needle: x.title for x in best} == {a: min((t for n, t in want if n == a), key=lambda t: (-want[a, t], t)) for a in {n for n, _ in want}}


def test_facets_of_one_request(spark):
    items = [(k, [f"c{k % 3}", f"c{k % 2}", None], f"t{k % 4}", k % 10) for k in range(60)] + [(100, None, None, None)]
    df = spark.createDataFrame(items, "item_id int, channels array<string>, tag string, score int")
    filters = {"band": F.col("score") >= 5, "channel": F.arrays_overlap("channels", F.array(F.lit("c0"))), "tag": F.col("tag").isin("t1", "t2")}
    got = {(r.facet, r.value): r.n_items for r in catalog.facets(df, {"channel": F.col("channels"), "tag": F.array("tag"), "score": F.array("score")}, filters).collect()}
    want = {}
    for _, channels, tag, score in items:
        holds = {"band": score is not None and score >= 5, "channel": "c0" in (channels or []), "tag": tag in ("t1", "t2")}
        for facet, values in (("channel", set(channels or []) - {None}), ("tag", {tag} - {None}), ("score", {score} - {None}), ("total", {None})):
            if all(ok for f, ok in holds.items() if f != facet):
                for v in values:
                    key = (facet, None if v is None else str(v))
                    want[key] = want.get(key, 0) + 1
    assert got == want


def test_a_hot_key_slides_over_many_tasks(spark):
    """Half of all events are one user's: the sums are those of one window for each event, and no task has them all."""
    rows = [(k, 1 if k % 2 else k % 7, 1_700_000_000 + (k * 7919) % 400_000 + (k % 5) * 1e-6, float(k % 11) / 4) for k in range(1500)]
    rows += [(5000, None, 1_700_000_000.0, 1.0), (5001, 3, None, 1.0), (5002, 3, 1_700_000_000.0, None), (5003, 3, 1_700_000_000.0, 2.0)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, at double, value double").withColumn("ts", F.timestamp_micros(F.round(F.col("at") * 1e6).cast("long")))
    own = ops.rolling(df, 86_400)
    got = {r.event_id: (r.spent_cents, r.n_calls) for r in own.collect()}
    assert set(own.columns) == {*df.columns, "spent_cents", "n_calls"}
    timed = [(k, u, round(t * 1e6), round((v or 0) * 100)) for k, u, t, v in rows if t is not None]
    for k, u, t, _ in timed:
        inside = [c for _, u2, t2, c in timed if u2 == u and t - 86_400_000_000 <= t2 <= t]
        assert got[k] == (sum(inside), len(inside)), k
    assert got[5001] == (None, None)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = df.filter("user_id = 1").select(F.floor(F.unix_micros("ts") / 3_600_000_000).alias("block"), "user_id").repartition(16, "user_id", "block")
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 0.25 * sum(sizes)


def test_samples_by_the_budget_of_each_group(spark):
    rows = [(k, g, "word " * 30, 90 if k % 3 else 20, f"2024-01-{1 + k % 28:02d}") for g in ("a", "b", None) for k in range(40)]
    df = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "id int, g string, body string, score int, day string").withColumn("day", F.col("day").cast("date"))
    budgets = spark.createDataFrame([("a", 5), (None, 12)], "g string, budget int")
    got = corpus.stratified_sample(df, "g", "id", "body", "score", "day", budgets, most=12).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {"a": 5, None: 12}
    whole = corpus.stratified_sample(df, "g", "id", "body", "score", "day", 20).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in whole} == {"a": 20, "b": 20, None: 20}


def test_work_folder(spark):
    assert base.work_folder(spark) != base.work_folder(spark)


def test_titles_are_compared_where_they_meet(spark):
    """Pairs meet with their sets, in a given number of tasks, and those that resemble each other come once without being made distinct."""
    rows = spark.createDataFrame([(f"storm gear {k} night widget",) for k in range(40)], "name string")
    index = titles.trigram_index(rows, "name")
    found = titles.resembling(index, rows, "name")
    assert {"grams", "signs"} <= set(index.postings.columns) and found.count() == found.distinct().count() == 1600


@pytest.mark.parametrize("least", [0.0, 0.25, 0.6])
def test_titles_are_compared_by_blocks_as_by_the_index(spark, monkeypatch, least):
    """Some needles with no, one or many titles, whatever the blocks and strips, and whichever trigrams are counted together."""
    r = np.random.default_rng(3)
    names = ["".join(r.choice(list("abcde "), r.integers(1, 30))) for _ in range(300)] + ["", None, "!!", "Ab cde", "ab  CDE", "é", "x" * 3_000, " ".join(map(str, range(900)))]
    asked = ["".join(r.choice(list("abcdf "), r.integers(1, 30))) for _ in range(90)] + [None, "", "ab-cde", "qq", " ".join(map(str, range(100, 950)))]
    df = lambda x: spark.createDataFrame([(t,) for t in x], "name string")
    index = titles.trigram_index(df(names), "name", least)
    needles = titles._ordered(df(asked), "name", index.ranks)
    want = {(a, b): likeness(a, b) for a in asked if a is not None for b in names if b is not None and likeness(a, b) > least}
    for block, strip, columns, single in ((8192, 2048, 1024, 500), (50, 7, 3, 500), (50, 300, 10**4, 10**9), (10**6, 64, 64, 0)):
        for name, value in (("BLOCK", block), ("STRIP", strip), ("COLUMNS", columns), ("SINGLE", single)):
            monkeypatch.setattr(titles, name, value)
        rows = titles._by_blocks(index, needles, needles.count(), index.sets.count()).collect()
        found = {(x.needle, x.title): x.likeness for x in rows}
        assert len(rows) == len(found) and found == want
    rows = titles._by_index(index, needles).collect()
    assert {(x.needle, x.title): x.likeness for x in rows} == want and len(rows) == len(want)
    assert titles.resembling(index, df(asked).limit(0), "name").count() == 0


def test_titles_that_nearly_all_meet_are_compared_by_blocks(spark):
    """Each pair was made as a row under each of the first trigrams of both, whatever they shared besides."""
    r = np.random.default_rng(4)
    names = [" ".join("".join(r.choice(list("abc"), 3)) for _ in range(12)) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in names], "name string")
    index = titles.trigram_index(rows, "name")
    found = titles.resembling(index, rows, "name")
    assert "FlatMapGroupsInArrow" in plan_of(found)
    some = {(a, b): likeness(a, b) for a in names[:20] for b in names}
    assert {(x.needle, x.title): x.likeness for x in found.filter(F.col("needle").isin(names[:20])).collect()} == {k: v for k, v in some.items() if v > 0.25}
    rare = spark.createDataFrame([(f"{k:06d}",) for k in range(0, 900_000, 7_919)], "name string")
    assert "FlatMapGroupsInArrow" not in plan_of(titles.resembling(titles.trigram_index(rare, "name", 0.9), rare, "name"))


@pytest.fixture
def large(spark):
    """As among large tables: nothing is small enough to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_replaced_groups_are_not_sorted(spark, large):
    old = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3), (None, "d", 4)], ROW)
    new = spark.createDataFrame([(1, "x", 9), (1, "y", 8), (3, "z", 7), (None, "n", 6)], ROW)
    groups = spark.createDataFrame([(1,), (1,), (None,)], "k long")
    found = merge.replace_groups(old, new, ["k"], groups)
    assert "Sort" not in plan_of(found)  # before, all rows of the target were sorted by their group
    assert rows_of(found) == sorted([(1, "x", 9), (1, "y", 8), (2, "c", 3), (None, "d", 4)], key=str)


def test_facets_sort_no_links(spark, large):
    links = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (3, 8), (None, 8)], "item_id long, channel_id long")
    items = spark.createDataFrame([(1,), (1,), (2,), (None,)], "item_id long")
    found = catalog.facet(links, items, "channel_id")
    assert "Sort" not in plan_of(found)  # before, links were sorted by their item
    assert rows_of(found) == [(7, 2)]


def test_a_maintained_rollup_works_out_its_delta_once(spark, tmp_path):
    shape = "item_id long, channel_id long, critic int, critic_count long, user double, user_count long, is_lead boolean"
    own = spark.createDataFrame([(k, c, 50, 3, 5.0, 4, c == 1) for k in range(4) for c in (1, 2)], shape)
    kept = stored.MaintainedRollup(spark, f"file://{tmp_path}/t", buckets=4).create(own)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    delta = own.filter(counted("item_id") == 2).withColumn("critic", F.lit(90))
    kept.apply(delta)
    assert seen.value == 8  # one pass over the rows that the delta is made of; before, each read of the delta was one
    assert {r.item_id: r.critic for r in kept.read().collect()} == {0: 50, 1: 50, 2: 90, 3: 50}
    assert not (tmp_path / "t/channels/delta").exists()
