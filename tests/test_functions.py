import unicodedata

import pytest
from pyspark.sql import functions as F

from loomscore.functions import records, scores, text
from loomscore.operators import corpus
from loomscore.sources import extract


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "count", "valid"),
    [(None, 0, False), (None, 5, False), (0.0, 0, False), (0.0, 1, False), (0.0, 19, False), (0.0, 20, True), (0.5, 6382, True), (7.4, 1, True), (10.0, 25, True)],
)
def test_effective(spark, raw, count, valid):
    row = spark.createDataFrame([(raw, count)], "raw double, n int").select(scores.effective("raw", "n").alias("v")).first()
    assert row.v == (raw if valid else None)


@pytest.mark.parametrize(("x", "y"), [(100, "excellent"), (85, "excellent"), (84, "good"), (70, "good"), (69, "mixed"), (50, "mixed"), (49, "poor"), (0, "poor"), (None, "none")])
def test_tier(spark, x, y):
    assert one(spark, x, scores.tier("x"), "int") == y


@pytest.mark.parametrize(("x", "scale", "y"), [(8.9, 10, 89), (3.8, 10, 38), (10.0, 10, 100), (0.5, 10, 5), (86.0, 100, 86), (88.5, 100, 88), (None, 10, None)])
def test_normalized(spark, x, scale, y):
    assert one(spark, x, scores.normalized("x", scale), "double") == y


@pytest.mark.parametrize(
    ("x", "y"),
    [("NieR: Automata", "nier automata"), ("Ratchet & Clank", "ratchet and clank"), ("S.T.A.L.K.E.R. 2", "s t a l k e r 2"), ("Pokémon Légendes: Arceus", "pokemon legendes arceus"), ("Assassin's Creed", "assassins creed"), (None, None)],
)
def test_title(spark, x, y):
    assert one(spark, x, text.normalize_title("x")) == y


def test_slug(spark):
    assert one(spark, "Xbox Series X|S", text.slug("x")) == "xbox-series-x-s"


def test_slugs_of_a_list_are_those_of_its_names(spark):
    names = ["Xbox Series X|S", "É'a", "한국 ﷺ", "", "a\x1fb", "--", "Σας"]
    df = spark.createDataFrame([(names,), ([],)], "x array<string>").select("x", text.in_one("x").alias("y")).select("x", text.slugs("y").alias("y"))
    each = [r[0] for r in spark.createDataFrame([(n,) for n in names], "x string").select(text.slug("x")).collect()]
    assert [r.y for r in df.collect()] == [each, [""]]


def test_accents_go_to_python_only_where_one_becomes_several(spark):
    told = "".join(map(chr, [*range(1, 0x3400), *range(0xABF0, 0xAC20), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F260), *range(0x2F800, 0x2FA20)]))
    kept = "\u0041\u030a\u00c5 \u00e9\u0301 \u0131 \u00df \u4e00"
    rows = [(None,), ("",), ("plain",), (told,), (kept,), *((c,) for c in told)]
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    frame = spark.createDataFrame(rows, "x string").select("x", text.strip_accents("x").alias("y"), F.col("x").rlike(text._stripped()[2]).alias("several"))
    for r in frame.collect():
        assert r.y == (None if r.x is None else plain(r.x))
        assert r.several == (None if r.x is None else any(len(plain(c)) > 1 for c in r.x))


@pytest.mark.parametrize(("x", "y"), [("PT1H24M9S", 5049), ("P1DT1S", 86401), ("PT", 0), ("1H", None), ("", None), (None, None)])
def test_duration(spark, x, y):
    assert one(spark, x, text.iso_seconds("x")) == y


@pytest.mark.parametrize(
    ("x", "y"), [("a great game", 1), ("not a great game", -1), ("not a very long but great", 1), ("terrible and boring", -2), ("", 0)]
)
def test_polarity(spark, x, y):
    tokens = F.split("x", " ")
    assert one(spark, x, text.polarity(tokens, corpus.POSITIVE, corpus.NEGATIVE, corpus.NEGATORS)) == y


def test_cleaning(spark):
    assert one(spark, " a\r\n<b>x</b>​ \n\n\n\nb ", text.clean_body("x")) == "a\n x\n\nb"
    assert one(spark, "   ", text.clean_body("x")) is None
    assert one(spark, "one two three", text.for_prompt("x", 9)) == "one two…"
    assert one(spark, "a b  c", text.collapse("x")) == "a b c"


def test_fingerprint(spark):
    """Null, 0, '' and the text null are four things; 1 and 1.0 are one; no value can pass for two fields; the order of fields is nothing."""
    of = lambda **fields: spark.range(1).select(records.fingerprint({k: F.expr(v) for k, v in fields.items()})).first()[0]
    assert len({of(x="cast(null as int)"), of(x="0"), of(x="''"), of(x="'null'"), of(x="'z'"), of(x="'0'")}) == 6
    assert of(x="1") == of(x="1.0D") == of(x="1.0BD") == of(x="1L") == of(x="cast(1.00 as decimal(9,2))") != of(x="1.5D")
    assert of(x="1e10D") == of(x="10000000000L")
    assert of(a="'1,b=2'", b="'3'") != of(a="'1'", b="'2,b=3'")
    assert of(a="1", b="2") == of(b="2", a="1") != of(a="2", b="1")
    assert of(x="date'2024-01-02'") != of(x="date'2024-01-03'") and of(x="true") != of(x="'true'")


def test_captions(spark):
    said = "1\n00:01 --> 00:02\nhello\nhello there\n<i>there</i>\n[Music]\nbye"
    assert one(spark, said, extract.caption_lines("x")) == ["hello there", "bye"]


@pytest.mark.parametrize(
    ("sizes", "target", "total"), [([5, 3], 10, 8), ([100, 1], 10, 10), ([50, 50, 1, 1], 8, 8), ([3, 3], 1, 1), ([40, 30, 20, 10], 17, 17)]
)
def test_quotas(sizes, target, total):
    given = corpus.quotas(sizes, target, 0.15)
    assert sum(given) == total
    assert all(0 <= g <= n for g, n in zip(given, sizes, strict=True))


def test_quotas_keep_minorities():
    assert corpus.quotas([100, 1], 10, 0.15)[1] == 1


def test_each_text_is_read_once(spark):
    """One pass over the rows, one plain form of a body and one row of signs, however many conditions look at them."""
    rows = spark.createDataFrame([(1, "a", "x", 5), (2, "a", None, 5), (3, None, "good " * 30, 5), (4, None, "good  " * 30, 5), (5, None, "word " * 30, 5), (6, None, "Word  " * 30, 5)], "id int, g string, body string, score int")
    told = corpus.reject_reasons(rows, "g", "id", "body", "score")
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and plan.count("(?U)\\s+") == 1 and plan.count("\\Qmasterpiece\\E") == 1
    assert {r.id: r.reason for r in told.collect()} == {1: "too_short", 2: "too_short", 3: "score_text_mismatch", 4: "score_text_mismatch", 5: None, 6: "duplicate"}
