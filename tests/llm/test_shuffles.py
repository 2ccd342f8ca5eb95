"""What steps send through shuffles, as Spark counts it."""

import contextlib
import random

import corpus_pipeline
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from loomscore.llm.common import sifted
from loomscore.llm.jaccard import jaccard_components
from loomscore.llm.licenses import scan_licenses


def records_shuffled(spark, job, what="shuffleWriteRecords"):
    """What job() returns, and the rows (or what else is counted) that it writes to shuffles."""
    context = spark.sparkContext._jsc.sc()
    first = context.dagScheduler().nextStageId()
    out = job()
    context.listenerBus().waitUntilEmpty(30_000)
    sent = 0
    for k in range(first, context.dagScheduler().nextStageId()):
        with contextlib.suppress(Py4JJavaError):  # a stage that never ran
            sent += getattr(context.statusStore().lastStageAttempt(k), what)()
    return out, sent


def test_jaccard_sends_prefixes_once(spark):
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(404)) for _ in range(100)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, texts[0], texts[1] + " end"])], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as among large tables
    try:
        rows, sent = records_shuffled(spark, lambda: jaccard_components(docs).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.doc_id: r.component_id for r in rows} == {**{k: k for k in range(100)}, 100: 0, 101: 1}
    prefixes = 101 * (400 - 320 + 40)  # of all distinct sets; before, each was sent twice
    assert prefixes <= sent < 1.5 * prefixes


def test_near_copies_leave_other_texts_where_they_are(spark):
    rng = random.Random(8)
    texts = [f"{rng.randbytes(10_000).hex()} {k}" for k in range(200)]
    docs = spark.createDataFrame([*enumerate(texts), (200, texts[0]), (201, texts[1]), (None, texts[2]), (None, "alone")], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as among large tables
    try:
        rows, sent = records_shuffled(spark, lambda: corpus_pipeline.near_copy_stage(spark, docs, "").collect(), "shuffleWriteBytes")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in rows if r.doc_id is not None) == [(False, k, t) for k, t in enumerate(texts)]
    assert [r.text for r in rows if r.doc_id is None] == ["alone"]
    assert sent < sum(map(len, texts)) / 8  # before, each text was sent with its row


def test_sifted_drops_no_partner(spark):
    few = spark.range(0, 3_000, 3).selectExpr("id AS a", "CAST(id AS string) AS b").union(spark.sql("SELECT CAST(NULL AS bigint), 'n'"))
    many = spark.range(10_000).selectExpr("id AS k", "CAST(id AS string) AS s", "repeat('x', 5) AS text").union(spark.sql("SELECT CAST(NULL AS bigint), 'n', 'y'"))
    rows = sifted(many, F.xxhash64("k", "s"), few, F.xxhash64("a", "b"))
    assert rows.columns == ["k", "s", "text", "_maybe"] and rows.count() == 10_001
    maybe = {r.k for r in rows.filter("_maybe").collect()}
    assert {None, *range(0, 3_000, 3)} <= maybe and len(maybe) < 1_100
    assert sifted(many, F.xxhash64("k"), few.limit(0), F.xxhash64("a")).filter("_maybe").count() == 0


def test_directories_are_not_sent_to_every_task(spark):
    """Nearly as many directories as files, one of them with half of all: those that inherit were sent out sixteen times over."""
    files = [(0, "LICENSE", "Licensed under the MIT License."), (1, "b/LICENSE", "Licensed under the ISC License."), (2, None, "x"), (3, None, None)]
    files += [(k, f"{'ab'[k % 2]}/{k}/x.py" if k < 2_000 else "b/c/x.py", f"import x{k}") for k in range(10, 4_000)]
    df = scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string"))
    got = {r.doc_id: (r.license, r.from_directory) for r in df.collect()}
    assert got == {0: ("MIT", None), 1: ("ISC", None), 2: (None, None), 3: (None, None)} | {k: ("ISC", "b") if k % 2 or k >= 2_000 else ("MIT", "") for k in range(10, 4_000)}
    joins = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x and "_salt" in x]
    assert joins and not [x for x in joins if "Broadcast" in x]
