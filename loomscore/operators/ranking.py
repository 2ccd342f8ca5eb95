"""Candidate recordings of an item: hard rejections, weighted score, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..settings import DEFAULT, Settings

# Title patterns, weights and penalties.
TRAILER = r"(?i)\b(trailer|teaser|announcement|announce|reveal|cinematic|opening\s+movie)\b"
OFF_FORMAT = (
    r"(?i)\b(review|tier\s*list|news|ost|soundtrack|speedrun|all\s+cutscenes|the\s+movie|tips|guide|how\s+to|best\s+settings|"
    r"benchmark|fps\s+test|mods?|ranking|every\s+ending|all\s+endings|explained|lore|theory|reaction)\b"
)
PLAY = (
    r"(?i)\b(let'?s\s*play|playthrough|walkthrough|full\s+game|gameplay|first\s+look|blind\s+run|no\s+commentary|part\s*\d+|"
    r"episode\s*\d+|ep\.?\s*\d+)\b"
)
NO_COMMENTARY = r"(?i)\bno\s+commentary\b"
SHORTS = r"(?i)#shorts\b"
COMPILATION = r"(?i)\b(compilation|montage|highlights|best\s+moments)\b"
FIRST_PART = r"(?i)\b(part|episode|ep\.?)\s*0*1\b|\bpilot\b"
WEIGHTS = {"popularity": 0.32, "title_relevance": 0.28, "format_fit": 0.14, "engagement": 0.12, "recency_fit": 0.08, "series_signal": 0.06}
PENALTIES = {"no_commentary": 0.25, "shorts": 0.15, "compilation": 0.10, "no_captions": 0.20}


def reject_reason(covered: Column, languages: tuple[str, ...] = ("en",), least_cover: float = 0.5, settings: Settings = DEFAULT) -> Column:
    """The first of nine rules that a candidate breaks, or null."""
    language = F.lower(F.substring_index(F.coalesce("language", F.lit("")), "-", 1))
    return (
        F.when(~F.coalesce(F.col("live") == "none", F.lit(True)), "live_broadcast")
        .when(F.col("title").rlike(TRAILER), "trailer")
        .when(F.col("title").rlike(OFF_FORMAT), "off_format")
        .when(F.col("duration").isNull(), "duration_unknown")
        .when(F.col("duration") < settings.video_min_seconds, "too_short")
        .when(F.col("duration") > settings.video_max_seconds, "too_long")
        .when(covered < least_cover, "title_mismatch")
        .when((language != "") & ~language.isin(*languages), "language")
        .when(~F.col("embeddable") & ~F.col("captions"), "not_embeddable_no_captions")
    )


def rank(candidates: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """candidates (item_id, item_title, video_id, title, channel_id, duration, views, likes, published, released, captions, live,
    language, embeddable) with reason, score (0-100; null if rejected), rank and selected."""
    covered = text.coverage(text.words(F.lower("item_title")), text.words(F.lower(F.regexp_replace("title", "[^A-Za-z0-9 ]", " "))))
    rows = candidates.withColumn("covered", covered)
    rows = rows.withColumn("reason", reject_reason(F.col("covered"), settings=settings))
    per = Window.partitionBy("item_id")
    top = F.max(F.when(F.col("reason").isNull(), F.col("views"))).over(per)
    of_channel = F.count("channel_id").over(Window.partitionBy("item_id", "channel_id"))
    rows = rows.withColumns({"top": top, "of_channel": of_channel})
    popularity = F.when((F.col("views") > 0) & (F.col("top") > 0), F.log10(F.col("views") + 1) / F.log10(F.col("top") + 1)).otherwise(0.0)
    relevance = 0.6 * F.col("covered") + 0.4 * F.col("title").rlike(PLAY).cast("double")
    fit = (
        F.when(F.coalesce(F.col("duration"), F.lit(0)) == 0, 0.0)
        .when(F.col("duration").between(1800, 10800), 1.0)
        .when(F.col("duration") < 1800, F.col("duration") / 1800.0)
        .otherwise(F.exp(-(F.col("duration") - 10800) / 7200.0))
    )
    engagement = F.when((F.col("likes") > 0) & (F.col("views") > 0), F.least(F.lit(1.0), F.col("likes") / F.col("views") / 0.05)).otherwise(0.0)
    days = F.datediff("published", "released")
    recency = F.when(days >= 0, F.exp(-days / 120.0)).otherwise(0.0)
    series = F.when(F.col("channel_id").isNotNull() & (F.col("of_channel") >= 3), 1.0).otherwise(0.0)
    parts = {"popularity": popularity, "title_relevance": relevance, "format_fit": fit, "engagement": engagement, "recency_fit": recency, "series_signal": series}
    total = sum((WEIGHTS[k] * v for k, v in parts.items()), F.lit(0.0))
    marks = {"no_commentary": F.col("title").rlike(NO_COMMENTARY), "shorts": F.col("title").rlike(SHORTS), "compilation": F.col("title").rlike(COMPILATION), "no_captions": ~F.col("captions")}
    loss = sum((F.when(v, PENALTIES[k]).otherwise(0.0) for k, v in marks.items()), F.lit(0.0))
    score = F.round(F.greatest(F.lit(0.0), total - loss) * 100, 4)
    rows = rows.withColumn("score", F.when(F.col("reason").isNull(), score))
    order = per.orderBy(F.desc(F.coalesce("score", F.lit(-1.0))), F.desc(F.col("title").rlike(FIRST_PART)), F.desc_nulls_last("duration"), "video_id")
    rows = rows.withColumn("rank", F.row_number().over(order))
    return rows.withColumn("selected", (F.col("rank") == 1) & F.coalesce(F.col("score") >= settings.video_min_score, F.lit(False))).drop("top", "of_channel", "covered")
