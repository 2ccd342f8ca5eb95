"""Corpus, validation, similarity, ranking and extraction queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import corpus, ranking, similarity, snapshots, validate
from ..sources import extract
from .base import query, table

# The texts are invented, so the lexicon of the queries is made of their own frequent words.
LEXICON = {"positive": ["the", "and"], "negative": ["of", "der"], "negators": ["to", "a", "in"], "off_topic": ["tion", "ist", "per"]}

_REVIEWS = """reviews AS (SELECT doc_id, source, text, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(doc_id * 7 % 101 AS INT) END AS score,
    CASE WHEN doc_id % 11 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(doc_id * 13 % 400 AS INT) END AS published FROM documents)"""


def reviews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id",
        "source",
        "text",
        F.when(F.col("doc_id") % 9 != 0, (F.col("doc_id") * 7 % 101).cast("int")).alias("score"),
        F.when(F.col("doc_id") % 11 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") * 13 % 400).cast("int"))).alias("published"),
    )


# A sentiment word is turned by a negator within the three words before it, unless another sentiment word stands between.
_POLARITY = """tok AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM t),
val AS (SELECT *, CASE WHEN x IN ('the', 'and') THEN 1 WHEN x IN ('of', 'der') THEN -1 ELSE 0 END AS v, CASE WHEN x IN ('to', 'a', 'in') THEN i END AS neg FROM tok),
was AS (SELECT *, max(neg) OVER before AS last_neg, max(CASE WHEN v <> 0 THEN i END) OVER before AS last_word FROM val WINDOW before AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pol AS (SELECT doc_id, CAST(sum(CASE WHEN i - last_neg <= 3 AND last_neg > coalesce(last_word, -1) THEN -v ELSE v END) AS INT) AS side FROM was GROUP BY 1)"""
_FILTER = f"""WITH {_REVIEWS}, p AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS plain FROM reviews),
t AS (SELECT *, list_filter(string_split(plain, ' '), lambda w: w <> '') AS w FROM p), {_POLARITY},
j AS (SELECT t.*, length(plain) < 80 AS short, coalesce(len(list_filter(w, lambda x: x IN ('tion', 'ist', 'per'))) / nullif(len(w), 0)::DOUBLE, 0) >= 0.06 AS off, coalesce(side, 0) AS side FROM t LEFT JOIN pol ON pol.doc_id = t.doc_id),
k AS (SELECT *, coalesce((score >= 70 AND side <= -3) OR (score <= 35 AND side >= 3), false) AS wrong FROM j),
m AS (SELECT *, min(CASE WHEN NOT (short OR off OR wrong) THEN doc_id END) OVER (PARTITION BY source, plain) AS kept FROM k),
judged AS (SELECT *, CASE WHEN short THEN 'too_short' WHEN kept < doc_id THEN 'duplicate' WHEN off THEN 'off_topic' WHEN wrong THEN 'score_text_mismatch' END AS reason FROM m)
"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    return corpus.reject_reasons(reviews(spark, d), "source", "doc_id", "text", "score", **LEXICON)


@query(_FILTER + "SELECT doc_id, side FROM j")
def polarity(spark, d):
    words = F.filter(F.split(F.lower(text.collapse("text")), " "), lambda w: w != "")
    return reviews(spark, d).select("doc_id", text.polarity(words, LEXICON["positive"], LEXICON["negative"], LEXICON["negators"]).alias("side"))


@query(_FILTER + "SELECT doc_id, reason FROM judged")
def corpus_filter(spark, d):
    return judged(spark, d).select("doc_id", "reason")


@query(_FILTER + "SELECT source, coalesce(reason, 'kept') AS reason, count(*) AS n FROM judged GROUP BY ALL")
def rejection_counts(spark, d):
    return judged(spark, d).groupBy("source", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_PLACED = """s AS (SELECT source, min(published) AS o, max(published) AS n FROM {0} GROUP BY 1),
r AS (SELECT {0}.*, coalesce((published - o) / nullif(n - o, 0)::DOUBLE, 0) AS recency, concat_ws('/', CASE WHEN score IS NULL THEN 'unscored' WHEN score >= 70 THEN 'positive' WHEN score >= 50 THEN 'neutral' ELSE 'negative' END,
    CASE WHEN published >= o + CAST((n - o) // 2 AS INT) THEN 'new' ELSE 'old' END) AS stratum FROM {0} JOIN s ON {0}.source IS NOT DISTINCT FROM s.source),
z AS (SELECT source, stratum, count(*) AS size FROM r GROUP BY ALL)
"""
_STRATA = f"WITH {_REVIEWS}, {_PLACED.format('reviews')}"


@query(_STRATA + "SELECT source, stratum, size AS n FROM z")
def strata_sizes(spark, d):
    return corpus.with_strata(reviews(spark, d), "source", "score", "published").groupBy("source", "stratum").agg(F.count("*").alias("n"))


# Rounded parts, at least the floor; then the largest strata in turn give or take what is over or missing, round by round.
_QUOTA = """, g AS (SELECT *, sum(size) OVER w AS total, count(*) OVER w AS k FROM z WINDOW w AS (PARTITION BY source)),
q AS (SELECT *, greatest(1, CAST(round_even(20 * 0.15 / k, 0) AS INT)) AS floor_, row_number() OVER (PARTITION BY source ORDER BY size DESC, first) AS place FROM (SELECT g.*, f.first FROM g JOIN (SELECT source, stratum, min(doc_id) AS first FROM r GROUP BY ALL) f ON f.source IS NOT DISTINCT FROM g.source AND f.stratum = g.stratum)),
d AS (SELECT *, CASE WHEN total <= 20 THEN size ELSE least(size, greatest(floor_, CAST(round_even(20 * size / total::DOUBLE, 0) AS BIGINT))) END AS given FROM q),
e AS (SELECT *, sum(given) OVER (PARTITION BY source) - 20 AS over_, CASE WHEN total <= 20 THEN 0 ELSE given - floor_ END AS can_give, CASE WHEN total <= 20 THEN 0 ELSE size - given END AS can_take FROM d),
steps AS (SELECT source, stratum, place, unnest(range(1, 200)) AS round_, over_, can_give, can_take FROM e),
able AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round_, place) AS nth FROM steps WHERE (over_ > 0 AND round_ <= can_give) OR (over_ < 0 AND round_ <= can_take)),
moved AS (SELECT source, stratum, count(*) AS n, any_value(sign(over_)) AS way FROM able WHERE nth <= abs(over_) GROUP BY ALL),
quota AS (SELECT e.source, e.stratum, CAST(given - coalesce(way * n, 0) AS BIGINT) AS quota FROM e LEFT JOIN moved m ON m.source IS NOT DISTINCT FROM e.source AND m.stratum = e.stratum)
"""


@query(_STRATA + _QUOTA + "SELECT source, stratum, quota FROM quota")
def strata_quota(spark, d):
    """How many of 20 rows each stratum of a source gives."""
    return corpus.strata_quotas(corpus.with_strata(reviews(spark, d), "source", "score", "published"), "source", "doc_id", 20)


@query(_FILTER.rstrip() + f""", own AS (SELECT doc_id, source, text, score, published FROM judged WHERE reason IS NULL), {_PLACED.format('own')}{_QUOTA}, x AS (SELECT *, row_number() OVER (PARTITION BY source, stratum
    ORDER BY round(0.45 * least(1.0::DOUBLE, length(text) / 900.0::DOUBLE) + 0.30 * recency + 0.15 * coalesce(abs(score - 50) / 50.0::DOUBLE, 0.0) + 0.05, 9) DESC, doc_id) AS nth FROM r)
SELECT x.source, x.doc_id, x.stratum FROM x JOIN quota ON quota.source IS NOT DISTINCT FROM x.source AND quota.stratum = x.stratum WHERE nth <= quota""")
def stratified_sample(spark, d):
    kept = judged(spark, d).filter("reason IS NULL")
    return corpus.stratified_sample(kept, "source", "doc_id", "text", "score", "published", 20).select("source", "doc_id", "stratum")


_SNAPSHOT = f"""WITH {_REVIEWS}, snap AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published IS NULL, published, doc_id) - 1 AS position
    FROM reviews)"""


@query(_SNAPSHOT + "SELECT source, doc_id, printf('C%02d', position) AS ref FROM snap")
def snapshot_refs(spark, d):
    return corpus.snapshot(reviews(spark, d), "source", "doc_id", "published").select("source", "doc_id", "ref")


@query(f"""WITH {_REVIEWS}, snap AS (SELECT *, doc_id // 500 AS grp, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY published IS NULL, published, doc_id) - 1 AS position FROM reviews)
SELECT grp, sha256('v1|' || string_agg(concat_ws(':', doc_id, coalesce(CAST(score::DOUBLE AS VARCHAR), 'None'), coalesce(CAST(published AS VARCHAR), ''), substr(sha256(coalesce(text, '')), 1, 16)), '|' ORDER BY position)) AS content_hash
    FROM snap GROUP BY grp""")
def content_hash(spark, d):
    """Snapshots of up to 500 members: the documents of each half thousand."""
    members = corpus.snapshot(reviews(spark, d).withColumn("grp", F.expr("doc_id div 500")), "grp", "doc_id", "published")
    return corpus.content_hash(members, "grp", "doc_id", "score", "published", "text")


# The same quotas for a budget of its own for each source, then the members in order, their hash, and what is known already.
_BUDGET_QUOTA = (
    _QUOTA.replace("FROM z WINDOW", "FROM (SELECT z.*, budget FROM z JOIN budgets b ON b.source IS NOT DISTINCT FROM z.source) WINDOW")
    .replace("20 * 0.15 / k", "budget * 0.15 / k").replace("total <= 20", "total <= budget").replace("20 * size", "budget * size").replace("- 20 AS over_", "- budget AS over_")
)
_BUILT = f"""{_FILTER.rstrip()}, own AS (SELECT doc_id, source, text, score, published FROM judged WHERE reason IS NULL),
budgets AS (SELECT source, CAST(least(40, floor(6000 * 3.5 * 0.75 / (avg(least(length(text), 1500)) + 60))) AS INT) AS budget FROM own GROUP BY 1), {_PLACED.format('own')}{_BUDGET_QUOTA},
x AS (SELECT *, row_number() OVER (PARTITION BY source, stratum ORDER BY round(0.45 * least(1.0::DOUBLE, length(text) / 900.0::DOUBLE) + 0.30 * recency + 0.15 * coalesce(abs(score - 50) / 50.0::DOUBLE, 0.0) + 0.05, 9) DESC, doc_id) AS nth FROM r),
mem AS (SELECT x.source, x.doc_id, x.score, x.published, x.text, row_number() OVER (PARTITION BY x.source ORDER BY x.published IS NULL, x.published, x.doc_id) - 1 AS position FROM x JOIN quota ON quota.source IS NOT DISTINCT FROM x.source AND quota.stratum = x.stratum WHERE nth <= quota),
head AS (SELECT source, count(*) AS n_members, sha256('v1|' || string_agg(concat_ws(':', doc_id, coalesce(CAST(score::DOUBLE AS VARCHAR), 'None'), coalesce(CAST(published AS VARCHAR), ''), substr(sha256(text), 1, 16)), '|' ORDER BY position)) AS content_hash FROM mem GROUP BY 1),
ids AS (SELECT *, length(source) % 2 = 0 AND right(source, 1) IN ('0', '2', '4', '6', '8') AS known, CAST('0x' || substr(sha256(concat_ws('|', coalesce(source, ''), content_hash)), 1, 15) AS BIGINT) AS made FROM head)
"""


def _built(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Snapshots of the sources' reviews; those of some sources have been built before, under the ids 1, 2, ..."""
    how = {"group": "source", "key": "doc_id", "body": "text", "score": "score", "date": "published", "tokens": 6000, "cap": 40, **LEXICON}
    none = spark.createDataFrame([], "source string, content_hash string, snapshot_id long")
    before, _ = snapshots.build(reviews(spark, d), none, **how)
    even = (F.length("source") % 2 == 0) & F.substring("source", -1, 1).isin(*"02468")
    known = before.filter(even).select("source", "content_hash", F.length("source").cast("long").alias("snapshot_id"))
    return snapshots.build(reviews(spark, d), known, **how)


@query(_BUILT + "SELECT source, content_hash, n_members, CASE WHEN known THEN length(source) ELSE made END AS snapshot_id, NOT coalesce(known, false) AS created FROM ids")
def snapshot_headers(spark, d):
    return _built(spark, d)[0].select("source", "content_hash", "n_members", "snapshot_id", "created")


@query(_BUILT + "SELECT mem.source, made AS snapshot_id, doc_id, CAST(position AS INT) AS position, printf('C%02d', position) AS ref FROM mem JOIN ids ON mem.source IS NOT DISTINCT FROM ids.source WHERE NOT coalesce(known, false)")
def snapshot_members(spark, d):
    return _built(spark, d)[1]


@query("SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(replace(replace(replace(lower(strip_accents(text)), chr(39), ''), '’', ''), '&', ' and '), '[^\\pL\\pN_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS key FROM documents")
def normalize_title(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.normalize_title("text"), 256).alias("key"))


@query("SELECT doc_id, trim(regexp_replace(replace(replace(lower(strip_accents(text)), chr(39), ''), '’', ''), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def slugs(spark, d):
    return table(spark, d, "documents").select("doc_id", text.slug("text").alias("slug"))


@query("SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS hash FROM documents")
def body_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", text.body_hash("text").alias("hash"))


@query(r"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS v FROM benchmark), n AS (SELECT count(*) AS n FROM benchmark)
SELECT doc_id, item_id, round(len(list_intersect(v, w)) / len(v)::DOUBLE, 6) AS covered FROM t, n, b WHERE item_id = doc_id % n.n""")
def coverage(spark, d):
    """How much of a benchmark text's words a document holds: every document with one benchmark text, in turn."""
    found = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    asked = table(spark, d, "benchmark").select("item_id", found("text").alias("v"))
    n = table(spark, d, "benchmark").agg(F.count("*").alias("n")).scalar()
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % n).alias("item_id"), found("text").alias("w"))
    return docs.join(asked, "item_id").select("doc_id", "item_id", F.round(text.coverage(F.col("v"), F.col("w")), 6).alias("covered"))


_CLAIMS = r"""n AS (SELECT count(*) AS n FROM documents), claims AS (SELECT item_id AS claim_id, CASE WHEN item_id % 7 = 0 THEN 'over time ' WHEN item_id % 11 = 0 THEN 'Reviews are mixed. ' WHEN item_id % 5 = 1 THEN '"' || left(text, 30) || '" ' ELSE '' END || text AS claim,
    list_distinct([item_id * 7919 % n, CASE WHEN item_id % 13 = 0 THEN item_id * 7919 % n ELSE (item_id * 104729 + 17) % n END, CASE WHEN item_id % 6 = 0 THEN 999999999 ELSE (item_id * 1299709 + 5) % n END]) AS refs FROM benchmark, n),
ev AS (SELECT doc_id AS ref, lower(text) AS body, DATE '2024-01-01' + CAST(doc_id * 13 % 400 AS INT) AS date FROM documents)"""
_STOP = "[" + ", ".join(f"'{w}'" for w in validate.STOPWORDS) + "]"
_TOKENS = f"list_filter(list_distinct(regexp_extract_all(lower({{x}}), '[a-z][a-z''-]{{{{2,}}}}')), lambda w: NOT list_contains({_STOP}, w))"
_VALIDATE = f"""WITH {_CLAIMS}, c AS (SELECT claim_id, claim, unnest(refs) AS ref, {_TOKENS.format(x='claim').replace('{{', '{').replace('}}', '}')} AS tokens FROM claims),
f AS (SELECT claim_id, any_value(claim) AS claim, count(*) AS n_refs, count(*) FILTER (WHERE ev.ref IS NULL) AS n_missing, count(DISTINCT date) AS n_dates, max(date) - min(date) AS days,
    max(len(tokens)) AS n_tokens, lower(regexp_extract(any_value(claim), '{validate.QUOTE.replace("'", "''")}', 1)) AS quote, bool_or(contains(body, lower(regexp_extract(claim, '{validate.QUOTE.replace("'", "''")}', 1)))) AS quoted, count(*) FILTER (WHERE len(list_intersect(tokens, {_TOKENS.format(x='body').replace('{{', '{').replace('}}', '}')})) > 0) AS n_support FROM c LEFT JOIN ev USING (ref) GROUP BY claim_id),
outcomes AS (SELECT claim_id, n_refs, CASE WHEN n_missing > 0 THEN 'missing_ref' WHEN n_refs < 3 THEN 'low_support'
    WHEN regexp_matches(claim, '{validate.VAGUE}') THEN 'vague' WHEN regexp_matches(claim, '{validate.TEMPORAL}') AND NOT (n_dates >= 2 AND days >= 30) THEN 'temporal' WHEN quote <> '' AND NOT coalesce(quoted, false) THEN 'quote_not_found'
    WHEN n_tokens > 0 AND n_support < greatest(2, (n_refs + 1) // 2) THEN 'aspect_unsupported' ELSE 'accepted' END AS outcome FROM f)
"""


def validated(spark: SparkSession, d: str) -> DataFrame:
    """Whole benchmark texts as claims, some with a phrase that says nothing, one that asserts change, or a quotation; references lie all over the documents."""
    docs = table(spark, d, "documents")
    n, i = docs.agg(F.count("*").alias("n")).scalar(), F.col("item_id")
    before = (
        F.when(i % 7 == 0, "over time ").when(i % 11 == 0, "Reviews are mixed. ").when(i % 5 == 1, F.concat(F.lit('"'), F.substring("text", 1, 30), F.lit('" '))).otherwise("")
    )
    rows = table(spark, d, "benchmark").select("item_id", "text", n.alias("n"))
    first = i * 7919 % F.col("n")
    second = F.when(i % 13 == 0, first).otherwise((i * 104729 + 17) % F.col("n"))
    third = F.when(i % 6 == 0, F.lit(999999999)).otherwise((i * 1299709 + 5) % F.col("n"))
    claims = rows.select(i.alias("claim_id"), F.concat(before, "text").alias("claim"), F.array(first, second, third).alias("refs"))
    date = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") * 13 % 400).cast("int"))
    return validate.validate(claims, docs.select(F.col("doc_id").alias("ref"), F.col("text").alias("body"), date.alias("date")))


@query(_VALIDATE + "SELECT claim_id, n_refs, outcome FROM outcomes")
def validate_claims(spark, d):
    return validated(spark, d)


@query(_VALIDATE + "SELECT outcome, count(*) AS n FROM outcomes GROUP BY 1")
def validation_counts(spark, d):
    return validated(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


@query(_VALIDATE + "SELECT round(100.0 * count(*) FILTER (WHERE outcome = 'accepted') / count(*), 1) AS percent FROM outcomes")
def acceptance_rate(spark, d):
    accepted = F.count_if(F.col("outcome") == "accepted")
    return validated(spark, d).agg(F.round(F.try_divide(100.0 * accepted, F.count("*")), 1).alias("percent"))


_SIMILAR = """WITH it AS (SELECT p_partkey AS item_id, CASE WHEN p_partkey % 31 > 0 THEN [p_type, 's' || (p_size % 10)] ELSE [] END AS tags, CASE WHEN p_partkey % 31 > 0 THEN p_brand END AS series, CASE WHEN p_partkey % 31 > 0 THEN p_size END AS family,
    CASE WHEN p_partkey % 31 > 0 THEN [p_brand || '/' || p_type] ELSE [] END AS makers, [p_type] AS publishers, ['c' || (p_partkey % 3), 'c' || (p_partkey % 4)] AS channels, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_partkey * 31 % 101 AS INT) END AS score,
    CAST(1990 + p_partkey % 30 AS INT) AS year, list_distinct(string_split(lower(p_name), ' ')) AS words, p_partkey % 9 AS n_reviews,
    CASE WHEN p_partkey % 5 > 0 THEN ['positive', 'negative', 'mixed', 'absent'][1 + p_partkey % 4] END AS story, CASE WHEN p_partkey % 5 > 0 THEN ['negative', 'positive', 'positive'][1 + p_partkey % 3] END AS sound FROM part),
vals AS (SELECT 0 AS branch, 300 AS lim, item_id, score, CAST(unnest(list_distinct(tags)) AS VARCHAR) AS v FROM it UNION ALL SELECT 1, 100, item_id, score, unnest(makers) FROM it UNION ALL SELECT 2, 20, item_id, score, CAST(family AS VARCHAR) FROM it WHERE family IS NOT NULL UNION ALL SELECT 3, 20, item_id, score, series FROM it WHERE series IS NOT NULL),
lists AS (SELECT * FROM vals QUALIFY row_number() OVER (PARTITION BY branch, v ORDER BY score DESC NULLS LAST, item_id) <= lim + 1),
found AS (SELECT DISTINCT a.branch, a.lim, a.item_id, l.item_id AS other_id, l.score FROM vals a JOIN lists l ON a.branch = l.branch AND a.v = l.v WHERE a.item_id <> l.item_id),
cut AS (SELECT *, row_number() OVER (PARTITION BY branch, item_id ORDER BY score DESC NULLS LAST, other_id) AS k FROM found QUALIFY k <= lim),
spare AS (SELECT 4 AS branch, b.item_id, t.item_id AS other_id, t.k FROM (SELECT item_id FROM it WHERE item_id % 31 = 0) b, (SELECT item_id, row_number() OVER (ORDER BY score DESC, item_id) AS k FROM it WHERE score IS NOT NULL QUALIFY k <= 51) t WHERE b.item_id <> t.item_id),
fi AS (SELECT item_id, other_id, min((branch, k)) AS place FROM (SELECT branch, item_id, other_id, k FROM cut UNION ALL SELECT branch, item_id, other_id, k FROM spare) GROUP BY ALL),
cand AS (SELECT item_id, other_id FROM fi QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY place, other_id) <= 300)
"""
BRANCHES = [("tags", 300), ("makers", 100), ("family", 20), ("series", 20)]


def _similar_items(spark: SparkSession, d: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size").cast("int")
    some = key % 31 > 0
    none = F.array().cast("array<string>")
    state = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (key % n + 1).cast("int"))
    verdicts = F.create_map(F.lit("story"), state(("positive", "negative", "mixed", "absent"), 4), F.lit("sound"), state(("negative", "positive", "positive"), 3))
    return table(spark, d, "part").select(
        key.alias("item_id"),
        F.when(some, F.array(F.col("p_type"), F.concat(F.lit("s"), F.col("p_size") % 10))).otherwise(none).alias("tags"),
        F.when(some, F.col("p_brand")).alias("series"),
        F.when(some, size).alias("family"),
        F.when(some, F.array(F.concat_ws("/", "p_brand", "p_type"))).otherwise(none).alias("makers"),
        F.array("p_type").alias("publishers"),
        F.array(F.concat(F.lit("c"), key % 3), F.concat(F.lit("c"), key % 4)).alias("channels"),
        F.when(key % 6 != 0, (key * 31 % 101).cast("int")).alias("score"),
        (key % 30 + 1990).cast("int").alias("year"),
        F.array_distinct(F.split(F.lower("p_name"), " ")).alias("words"),
        (key % 9).alias("n_reviews"),
        F.when(key % 5 > 0, verdicts).alias("aspects"),
    )


@query(_SIMILAR + "SELECT item_id, other_id FROM cand")
def similar_candidates(spark, d):
    return similarity.candidates(_similar_items(spark, d), BRANCHES)


def _jac(x: str) -> str:
    return f"(CASE WHEN len(a.{x}) > 0 AND len(b.{x}) > 0 THEN len(list_intersect(list_distinct(a.{x}), list_distinct(b.{x}))) / len(list_distinct(list_concat(a.{x}, b.{x})))::DOUBLE ELSE 0.0::DOUBLE END)"


_WORTH = "(CASE {} WHEN 'positive' THEN 1.0::DOUBLE WHEN 'negative' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END)"


@query(_SIMILAR + f""", pr AS (SELECT c.item_id, c.other_id, {_jac('tags')} AS tags, CASE WHEN a.series = b.series THEN 1.0::DOUBLE WHEN a.family = b.family THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS series,
    CASE WHEN list_has_any(a.makers, b.makers) THEN 1.0::DOUBLE WHEN list_has_any(a.publishers, b.publishers) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS makers, {_jac('channels')} AS channels, coalesce(1 - abs(a.score - b.score) / 100.0::DOUBLE, 0.0) AS score, exp(-abs(a.year - b.year) / 6.0::DOUBLE) AS era, {_jac('words')} AS lexical,
    {_WORTH.format('a.story')} AS a1, {_WORTH.format('a.sound')} AS a2, {_WORTH.format('b.story')} AS b1, {_WORTH.format('b.sound')} AS b2, a.story IS NOT NULL AND b.story IS NOT NULL AS told,
    a.score IS NULL AND b.score IS NULL AND greatest(a.n_reviews, b.n_reviews) < 5 AS unknown, coalesce(a.family = b.family, false) AS kin FROM cand c JOIN it a ON a.item_id = c.item_id JOIN it b ON b.item_id = c.other_id),
m AS (SELECT *, 0.30 * tags + 0.20 * series + 0.16 * makers + 0.12 * channels + 0.12 * score + 0.10 * era AS meta, CASE WHEN told THEN (1 + (a1 * b1 + a2 * b2) / (sqrt(a1 * a1 + a2 * a2) * sqrt(b1 * b1 + b2 * b2))) / 2 END AS aspect FROM pr),
sc AS (SELECT *, round((CASE WHEN aspect IS NULL THEN (0.62 * meta + 0.12 * lexical) / 0.74 ELSE 0.62 * meta + 0.12 * lexical + 0.26 * aspect END) * CASE WHEN unknown THEN 0.35::DOUBLE ELSE 1.0 END * CASE WHEN kin THEN 0.5::DOUBLE ELSE 1.0 END, 5) AS similarity FROM m)
SELECT item_id, other_id, similarity, CASE WHEN series >= 0.9 THEN 'same_series' WHEN makers >= 1 THEN 'same_maker' WHEN tags >= 0.6 THEN 'close_genre' WHEN aspect >= 0.75 THEN 'praised_alike' WHEN score >= 0.9 AND meta >= 0.18 THEN 'scored_alike' END AS reason,
    row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, other_id) AS rank FROM sc WHERE similarity >= 0.34 QUALIFY rank <= 12""")
def similar_items(spark, d):
    return similarity.similar_among(_similar_items(spark, d), BRANCHES).drop("components")


@query("""WITH s AS (SELECT l_partkey AS item_id, l_orderkey * 10 + l_linenumber AS k, l_suppkey % 3 AS a, CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'R' THEN 'absent' ELSE 'negative' END AS v FROM lineitem WHERE l_quantity > 5)
SELECT item_id, count(*) AS n, string_agg('a' || a || '=' || v, ',' ORDER BY a) AS aspects FROM (SELECT item_id, a, arg_min(v, (CASE WHEN v = 'absent' THEN 1 ELSE 0 END, k, v)) AS v FROM s GROUP BY ALL) GROUP BY 1""")
def aspect_profiles(spark, d):
    verdict = F.when(F.col("l_returnflag") == "A", "positive").when(F.col("l_returnflag") == "R", "absent").otherwise("negative")
    rows = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("item_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("summary_id"),
        (F.col("l_quantity") > 5).alias("is_current"),
        F.lit("fresh").alias("status"),
        F.create_map(F.concat(F.lit("a"), F.col("l_suppkey") % 3), verdict).alias("verdicts"),
    )
    said = F.transform(F.map_entries("aspects"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return similarity.aspect_profiles(rows).select("item_id", F.size("aspects").cast("long").alias("n"), F.array_join(said, ",").alias("aspects"))


@query("SELECT l_suppkey AS item_id, s_name, rank FROM (SELECT l_suppkey, row_number() OVER (ORDER BY l_suppkey) AS rank FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_partkey = 5)) JOIN supplier ON s_suppkey = l_suppkey WHERE rank <= 12")
def item_neighbours(spark, d):
    from pyspark.sql import Window

    near = table(spark, d, "lineitem").filter("l_partkey = 5").select(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("other_id")).distinct()
    edges = near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("other_id"))).withColumn("similarity", F.lit(0.5))
    items = table(spark, d, "supplier").select(F.col("s_suppkey").alias("item_id"), "s_name")
    return similarity.neighbours(edges, items, 5).drop("similarity")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT query_id, vec_id, round((1 + list_cosine_similarity(q.e, v.e)) / 2, 5) AS cosine FROM q JOIN v ON query_id <> vec_id)
SELECT query_id, vec_id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s QUALIFY rank <= 5""")
def cosine_topk(spark, d):
    """Of every fiftieth vector, the five nearest of all."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("e"))
    return similarity.nearest_cosine(v, v.filter("vec_id % 50 = 0"), "vec_id", "e", 5)


_SUFFIX = ("gameplay part 1", "trailer", "review", "walkthrough no commentary", "full game", "highlights", "part 2")
_VIDEOS = f"""WITH v AS (SELECT l_partkey AS item_id, p_name AS item_title, l_orderkey * 10 + l_linenumber AS video_id, p_name || ' ' || ({list(_SUFFIX)})[l_linenumber] AS title, l_suppkey AS channel_id,
    CASE WHEN l_tax = 0.05 THEN NULL ELSE CAST(l_quantity AS INT) * 300 END AS duration, CAST(round(l_extendedprice) AS BIGINT) AS views, CAST(round(l_extendedprice * l_discount / 2) AS BIGINT) AS likes,
    CAST(l_shipdate AS DATE) AS published, DATE '1998-01-01' AS released, l_returnflag <> 'R' AS captions FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT *, CASE WHEN regexp_matches(title, '{ranking.TRAILER}') THEN 'trailer' WHEN regexp_matches(title, '{ranking.OFF_FORMAT}') THEN 'off_format' WHEN duration IS NULL THEN 'duration_unknown'
    WHEN duration < 600 THEN 'too_short' WHEN duration > 25200 THEN 'too_long' END AS reason FROM v),
w AS (SELECT *, max(CASE WHEN reason IS NULL THEN views END) OVER (PARTITION BY item_id) AS top, count(*) OVER (PARTITION BY item_id, channel_id) AS per FROM r),
s AS (SELECT *, CASE WHEN reason IS NULL THEN round(greatest(0.0::DOUBLE, 0.0::DOUBLE + 0.32 * CASE WHEN views > 0 AND top > 0 THEN log10(views + 1) / log10(top + 1) ELSE 0 END
    + 0.28 * (0.6 * 1.0::DOUBLE + 0.4 * CAST(regexp_matches(title, '{ranking.PLAY.replace("'", "''")}') AS DOUBLE))
    + 0.14 * CASE WHEN duration = 0 THEN 0 WHEN duration BETWEEN 1800 AND 10800 THEN 1.0::DOUBLE WHEN duration < 1800 THEN duration / 1800.0::DOUBLE ELSE exp(-(duration - 10800) / 7200.0::DOUBLE) END
    + 0.12 * CASE WHEN likes > 0 AND views > 0 THEN least(1.0::DOUBLE, likes / views::DOUBLE / 0.05) ELSE 0 END + 0.08 * CASE WHEN published >= released THEN exp(-(published - released) / 120.0::DOUBLE) ELSE 0 END
    + 0.06 * CASE WHEN per >= 3 THEN 1.0::DOUBLE ELSE 0 END - (0.0::DOUBLE + CASE WHEN regexp_matches(title, '{ranking.NO_COMMENTARY}') THEN 0.25::DOUBLE ELSE 0 END
    + CASE WHEN regexp_matches(title, '{ranking.COMPILATION}') THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN NOT captions THEN 0.20::DOUBLE ELSE 0 END)) * 100, 4) END AS score FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(score, -1) DESC, regexp_matches(title, '{ranking.FIRST_PART}') DESC, duration DESC NULLS LAST, video_id) AS rank FROM s)
"""


def ranked(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    candidates = rows.select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("item_title"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("video_id"),
        F.concat_ws(" ", "p_name", F.element_at(F.array(*map(F.lit, _SUFFIX)), F.col("l_linenumber"))).alias("title"),
        F.col("l_suppkey").alias("channel_id"),
        F.when(F.col("l_tax") != 0.05, F.col("l_quantity").cast("int") * 300).alias("duration"),
        F.round("l_extendedprice").cast("long").alias("views"),
        F.round(F.col("l_extendedprice") * F.col("l_discount") / 2).cast("long").alias("likes"),
        F.to_date("l_shipdate").alias("published"),
        F.lit("1998-01-01").cast("date").alias("released"),
        (F.col("l_returnflag") != "R").alias("captions"),
        F.lit("none").alias("live"),
        F.lit("en").alias("language"),
        F.lit(True).alias("embeddable"),
    )
    return ranking.rank(candidates)


@query(_VIDEOS + "SELECT item_id, video_id, reason, score FROM k")
def rank_candidates(spark, d):
    return ranked(spark, d).select("item_id", "video_id", "reason", "score")


@query(_VIDEOS + "SELECT item_id, video_id FROM k WHERE rank = 1 AND score >= 60")
def select_best(spark, d):
    return ranked(spark, d).filter("selected").select("item_id", "video_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", extract.html_title("html").alias("title"))


@query("SELECT page_id, nullif(regexp_extract(html, '(?i)<html[^>]*\\slang=\"([^\"]*)\"', 1), '') AS lang, nullif(regexp_extract(html, '(?i)<meta[^>]*charset=\"?([^\">]*)', 1), '') AS charset, CAST(len(regexp_extract_all(html, '(?i)<script\\b')) AS INT) AS n_scripts FROM pages")
def page_meta(spark, d):
    return table(spark, d, "pages").select("page_id", extract.html_meta("html").alias("m")).select("page_id", "m.*")


@query("SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)<a [^>]*href=\"([^\"]*)\"', 1)) AS link FROM pages")
def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(extract.html_links("html")).alias("link"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) = 1")
def last_turn(spark, d):
    last = table(spark, d, "conversations").groupBy("conv_id").agg(F.min(F.struct(-F.col("turn"), "role")).alias("x"))
    return last.select("conv_id", (-F.col("x.col1")).alias("turn"), "x.role")


_FOLD = """list_reduce(list_transform(lines, lambda l: [l]), lambda kept, x: CASE WHEN starts_with(x[1], kept[len(kept)]) THEN list_concat(kept[1:len(kept) - 1], x) WHEN ends_with(kept[len(kept)], x[1]) THEN kept ELSE list_concat(kept, x) END)"""


@query(f"""WITH c AS (SELECT conv_id, turn, role, string_split(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '(?i)\\[[a-z ]+\\]', '', 'g'), chr(10)) AS raw FROM conversations),
l AS (SELECT *, list_filter(list_transform(raw, lambda s: trim(s, ' ')), lambda s: s <> '' AND NOT regexp_matches(s, '^[0-9]+$') AND NOT contains(s, '-->')) AS lines FROM c) SELECT conv_id, turn, CASE WHEN len(lines) = 0 THEN [] ELSE {_FOLD} END AS lines FROM l""")
def caption_clean(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", extract.caption_lines("text").alias("lines"))


@query(r"""SELECT word, source, n FROM (SELECT source, word, count(*) AS n FROM (SELECT source, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z''-]{3,}'))) AS word FROM documents) GROUP BY ALL)
    WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, word) <= 6""")
def shared_vocabulary(spark, d):
    rows = table(spark, d, "documents").select("source", F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z'-]{3,}"), F.lit(0)).alias("words"))
    return corpus.shared_vocabulary(rows, "source", "words", 3)


_EVALUATED = """c AS (SELECT l_orderkey AS block, CASE WHEN l_partkey % 2 = 0 THEN 'positive' ELSE 'negative' END AS side, l_returnflag <> 'R' AS ok, l_quantity >= 20 AS large FROM lineitem),
b AS (SELECT block, count(*) FILTER (WHERE ok AND side = 'positive') AS n_positive, count(*) FILTER (WHERE ok AND side = 'negative') AS n_negative, count(*) FILTER (WHERE side = 'positive') AS p FROM c GROUP BY 1),
k AS (SELECT block, n_positive, n_negative, n_positive >= CASE WHEN p > 0 THEN 2 ELSE 0 END AND n_negative >= 2 AS passed FROM b)"""


def _evaluated(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("block"), F.when(F.col("l_partkey") % 2 == 0, "positive").otherwise("negative").alias("side"), "l_returnflag", "l_quantity")
    return validate.evaluate(rows, ["block"], "side", F.col("l_returnflag") != "R", F.col("l_quantity") >= 20)


@query(f"WITH {_EVALUATED} SELECT * FROM k")
def evaluation_blocks(spark, d):
    return _evaluated(spark, d)[0]


@query(f"""WITH {_EVALUATED} SELECT count(*) AS claims, count(*) FILTER (WHERE ok) AS claims_passed, round(100.0 * count(*) FILTER (WHERE ok) / count(*), 1)::DOUBLE AS claims_percent, count(*) FILTER (WHERE large) AS large, count(*) FILTER (WHERE ok AND large) AS large_passed,
    (SELECT count(*) FROM k) AS blocks, (SELECT count(*) FROM k WHERE passed) AS blocks_passed, round(100.0 * (SELECT count(*) FROM k WHERE passed) / (SELECT count(*) FROM k), 1)::DOUBLE AS blocks_percent FROM c""")
def evaluation_report(spark, d):
    return _evaluated(spark, d)[1]


@query("""SELECT p_partkey AS item_id, CAST(p_size * 1000 + 7 AS BIGINT) AS whole, p_size + 0.5::DOUBLE AS decimal, CASE WHEN p_size % 3 = 0 THEN 'b' || p_size WHEN p_size % 3 = 1 THEN 'c' || p_size END AS url FROM part""")
def picked_values(spark, d):
    """The first numbers in a text, and the best of some formats; where none of those wanted is there, none is taken."""
    size = F.col("p_size").cast("int")
    said = F.concat(F.lit("about "), size, F.lit(",007 of 9"))
    options = F.array(F.struct(F.lit("m3u8").alias("ext"), F.lit("no").alias("url")), F.struct(F.when(size % 3 == 0, "json3").when(size % 3 == 1, "vtt").otherwise("srt").alias("ext"), F.concat(F.when(size % 3 == 0, "b").otherwise("c"), size).alias("url")))
    url = extract.by_preference(options, "ext", ["json3", "vtt"])["url"]
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), extract.first_int(said).alias("whole"), extract.first_float(F.concat(size, F.lit(".50 x"))).alias("decimal"), url.alias("url"))


@query("""SELECT p_partkey AS item_id, CAST(CASE WHEN p_partkey % 4 <> 3 THEN p_size % 5 * 3600 + p_size * 60 + p_partkey % 60 END AS BIGINT) AS seconds FROM part""")
def iso_duration(spark, d):
    p = table(spark, d, "part")
    said = F.concat(F.lit("PT"), F.col("p_size") % 5, F.lit("H"), F.col("p_size"), F.lit("M"), F.col("p_partkey") % 60, F.lit("S"))
    said = F.when(F.col("p_partkey") % 4 == 3, F.concat(F.lit("x"), said)).otherwise(said)
    return p.select(F.col("p_partkey").alias("item_id"), text.iso_seconds(said).alias("seconds"))
