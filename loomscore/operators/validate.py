"""Evidence validation: claims against the texts that they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULT, Settings

# Phrases that say nothing, phrases that assert change, quotations, words without content.
VAGUE = (
    r"(?i)\bmixed reviews?\b|\breviews?\s+(?:are|is|were|was)\s+mixed\b|\brecept(?:ion|ions)\s+(?:is|was)\s+mixed\b|"
    r"\bgenerally (?:positive|negative|favou?rable)\b|\bopinions? (?:are|is) divided\b|"
    r"\bsome (?:players|critics|reviewers) (?:like|dislike)\b|\bnot for everyone\b|\bhit or miss\b|"
    r"\boverall (?:good|bad|fine|okay)\b|\bwell received\b"
)
TEMPORAL = (
    r"(?i)\bafter (?:the |a )?(?:patch|update|release|launch)\b|\bat launch\b|\bover time\b|"
    r"\bsince (?:the |its )?(?:launch|release|patch)\b|\beventually\b|\blater reviews?\b|\bearly reviews?\b|"
    r"\bno longer\b|\bnowadays\b|\bthese days\b"
)
QUOTE = "[\"“‘']([^\"”’']{12,})[\"”’']"
STOPWORDS = (
    "the a an and or but of in on at to for with without from is are was were be been being it its this that these those they "
    "them their there here as by not no than then so very"
).split()


def content_tokens(x: str) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"[a-z][a-z\-']{2,}"), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, STOPWORDS)))


def validate(
    claims: DataFrame, evidence: DataFrame, vague: str = VAGUE, temporal: str = TEMPORAL, settings: Settings = DEFAULT
) -> DataFrame:
    """(claim_id, n_refs, outcome) of claims (claim_id, claim, refs) against evidence (ref, body, date).

    The first rule that fails names the outcome: missing_ref, low_support, vague, temporal, quote_not_found,
    aspect_unsupported; else accepted. Repeated references count once."""
    n = evidence.agg(F.count("*").alias("n")).scalar()
    support = F.when(n < settings.small_corpus, settings.small_corpus_support).otherwise(settings.claim_support)
    tokens = content_tokens("claim")
    said = claims.withColumns({"tokens": tokens, "quote": F.lower(F.regexp_extract("claim", QUOTE, 1))})
    cited = said.select("claim_id", "claim", "tokens", "quote", F.explode_outer(F.array_distinct("refs")).alias("ref"))
    known = evidence.select("ref", F.lower("body").alias("body"), "date", F.lit(True).alias("found"))
    rows = cited.join(known, "ref", "left")
    supports = F.size(F.array_intersect("tokens", content_tokens("body"))) > 0
    facts = rows.groupBy("claim_id").agg(
        F.first("claim").alias("claim"),
        F.count("ref").alias("n_refs"),
        F.count_if(F.col("ref").isNotNull() & F.col("found").isNull()).alias("n_missing"),
        F.count_distinct("date").alias("n_dates"),
        F.datediff(F.max("date"), F.min("date")).alias("days"),
        F.max("quote").alias("quote"),
        F.coalesce(F.max(F.contains("body", "quote")), F.lit(False)).alias("quoted"),
        F.max(F.size("tokens")).alias("n_tokens"),
        F.count_if(supports).alias("n_support"),
    )
    changes = F.col("claim").rlike(temporal) & ~((F.col("n_dates") >= 2) & (F.col("days") >= settings.temporal_days))
    unsupported = (F.col("n_tokens") > 0) & (F.col("n_support") < F.greatest(F.lit(2), F.floor((F.col("n_refs") + 1) / 2)))
    outcome = (
        F.when(F.col("n_missing") > 0, "missing_ref")
        .when(F.col("n_refs") < support, "low_support")
        .when(F.col("claim").rlike(vague), "vague")
        .when(changes, "temporal")
        .when((F.col("quote") != "") & ~F.col("quoted"), "quote_not_found")
        .when(unsupported, "aspect_unsupported")
        .otherwise("accepted")
    )
    return facts.select("claim_id", "n_refs", outcome.alias("outcome"))


def evaluate(claims: DataFrame, block: list[str], side: str, passed: Column, large: Column, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(blocks, totals). A block passes with `least` passed claims on its negative side, and as many on its positive side if it has any there.

    totals is one row: how many claims and blocks there are and passed, with percentages, and the claims' figures on large corpora."""
    ok = F.coalesce(passed, F.lit(False))
    up = F.col(side) == "positive"
    blocks = claims.groupBy(*block).agg(F.count_if(ok & up).alias("n_positive"), F.count_if(ok & ~up).alias("n_negative"), F.count_if(up).alias("_all"))
    enough = (F.col("n_positive") >= F.when(F.col("_all") > 0, least).otherwise(0)) & (F.col("n_negative") >= least)
    blocks = blocks.withColumn("passed", enough).drop("_all")
    rate = lambda a, b: F.round(F.try_divide(100.0 * a, b), 1)
    n, good, big, good_big = F.count("*"), F.count_if(ok), F.count_if(large), F.count_if(ok & large)
    totals = claims.agg(n.alias("claims"), good.alias("claims_passed"), rate(good, n).alias("claims_percent"), big.alias("large"), good_big.alias("large_passed"))
    own = blocks.agg(F.count("*").alias("n"), F.count_if("passed").alias("k"))
    totals = totals.withColumns({"blocks": own.select("n").scalar(), "blocks_passed": own.select("k").scalar()})
    return blocks, totals.withColumn("blocks_percent", rate(F.col("blocks_passed"), F.col("blocks")))
