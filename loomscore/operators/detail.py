"""Items with their children: scans, lookups, pages with totals, summaries with their claims, assembled details."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..settings import DEFAULT, Settings


def children(rows: DataFrame, key: str, name: str, order: Sequence[Column | str], *columns: str) -> DataFrame:
    """(key, name): the rows of each key as an array of structs of the columns, in order. An item's children are few."""
    ranks = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = F.struct(F.struct(*[o.alias(f"o{k}") for k, o in enumerate(ranks)]).alias("at"), F.struct(*columns).alias("row"))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(placed)).alias("x"))
    return listed.select(key, F.transform("x", lambda x: x["row"]).alias(name))


def with_children(items: DataFrame, key: str, **parts: DataFrame) -> DataFrame:
    """items with an array of structs for each part (see children); an item without rows in a part has an empty array."""
    for name, part in parts.items():
        kind = part.schema[name].dataType.simpleString()
        items = items.join(part, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return items


def in_order(rows: DataFrame, key: str, value: object, flag: str, position: str) -> DataFrame:
    """The rows of one key, those flagged first, then by position."""
    return rows.filter(F.col(key) == F.lit(value)).orderBy(F.desc(flag), position)


def keyed(rows: DataFrame, keys: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows that keys name; keys without a row give nothing, a key asked twice gives its row once."""
    return rows.join(keys.select(*by).distinct(), list(by), "left_semi")


def resolve(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """incoming (slug, source_id) with item_id: of the known item with that source id, else of that slug, else null."""
    by_id = known.filter("source_id IS NOT NULL").groupBy("source_id").agg(F.min("item_id").alias("_by_id"))
    by_slug = known.groupBy("slug").agg(F.min("item_id").alias("_by_slug"))
    rows = incoming.join(by_id, "source_id", "left").join(by_slug, "slug", "left")
    return rows.withColumn("item_id", F.coalesce("_by_id", "_by_slug")).drop("_by_id", "_by_slug")


def page(rows: DataFrame, order: Sequence[Column], offset: int, limit: int, deepest: int = 10_000) -> DataFrame:
    """One page of rows with total (of all rows) and has_more, by a count beside a top-k rather than a window over everything."""
    if not 0 <= offset <= deepest:
        raise ValueError(f"offset must be from 0 to {deepest}")
    total = rows.agg(F.count("*").alias("n")).scalar()
    cut = rows.orderBy(*order).offset(offset).limit(limit)
    return cut.withColumn("total", total).withColumn("has_more", F.col("total") > offset + limit)


def page_numbers(current: int, last: int, around: int = 2) -> list[int | None]:
    """The numbers that a pager shows: the first, the last, those around the current one; None stands for a gap."""
    shown = sorted({1, last, *range(max(1, current - around), min(last, current + around) + 1)})
    out: list[int | None] = []
    for n in shown:
        if out and n - out[-1] > 1:
            out.append(None)
        out.append(n)
    return out


def newest_reviews(reviews: DataFrame, group: str, value: object, offset: int, limit: int) -> DataFrame:
    """A page of a group's reviews, newest first; those without a date come last, the larger id first among equals."""
    return page(reviews.filter(F.col(group) == F.lit(value)), [F.desc_nulls_last("published"), F.desc("review_id")], offset, limit)


def side_claims(claims: DataFrame, side: str) -> DataFrame:
    """(summary_id, claims): the accepted claims of one side, in their order."""
    own = claims.filter((F.col("side") == side) & (F.col("validation") == "accepted"))
    return children(own, "summary_id", "claims", ["position"], "claim", "aspect", "refs")


def acceptance(claims: DataFrame) -> DataFrame:
    """(summary_id, accepted, total, rate): the share of claims that were accepted."""
    counted = claims.groupBy("summary_id").agg(F.count_if(F.col("validation") == "accepted").alias("accepted"), F.count("*").alias("total"))
    return counted.withColumn("rate", F.col("accepted") / F.col("total"))


def empty_note(side: Column | str, positives: Column | str, negatives: Column | str) -> Column:
    """What to say where a side has no claims: nothing of the kind was written, or nothing was said often enough."""
    side, up, down = (F.col(x) if isinstance(x, str) else x for x in (side, positives, negatives))
    negative = F.when((down == 0) & (up > 0), "only_praise").otherwise("no_repeated_complaint")
    positive = F.when((up == 0) & (down > 0), "only_complaints").otherwise("no_repeated_praise")
    return F.when(side == "negative", negative).otherwise(positive)


def summary_rows(summaries: DataFrame, claims: DataFrame) -> DataFrame:
    """summaries (summary_id, n_reviews, ...) with the accepted claims of both sides, the acceptance rate (1.0 without claims), and
    notes in place of a side that is empty."""
    rows = summaries
    for side in ("positive", "negative"):
        rows = rows.join(side_claims(claims, side).withColumnRenamed("claims", side), "summary_id", "left")
    rows = rows.join(acceptance(claims).select("summary_id", "rate"), "summary_id", "left").withColumn("rate", F.coalesce("rate", F.lit(1.0)))
    sizes = {s: F.coalesce(F.size(s), F.lit(0)) for s in ("positive", "negative")}
    notes = {
        "positive_note": F.when(sizes["positive"] <= 0, empty_note(F.lit("positive"), "n_reviews", sizes["negative"])),
        "negative_note": F.when(sizes["negative"] <= 0, empty_note(F.lit("negative"), "n_reviews", F.lit(0))),
    }
    return rows.withColumns(notes)


def preferred(summaries: DataFrame, leads: DataFrame, audience: str) -> DataFrame:
    """(item_id, summary_id): of an item's fresh summaries for an audience that of the lead channel, else the least id."""
    own = summaries.filter((F.col("audience") == audience) & (F.col("status") == "fresh")).join(leads, "item_id", "left")
    rank = F.struct(F.when(F.col("channel_id") == F.col("lead_channel"), 0).otherwise(1).alias("other"), "summary_id")
    return own.groupBy("item_id").agg(F.min(rank).alias("x")).select("item_id", "x.summary_id")


def signals(told: DataFrame, most: Mapping[str, int] = {"positive": 3, "negative": 2}) -> DataFrame:  # noqa: B006
    """(item_id, strengths, watch_outs) lifted from claims, never made: those of the critics' summary, else of the players'.

    told: item_id, critic and player, each a struct with the arrays positive and negative, or null."""
    pick = lambda side: F.slice(
        F.coalesce(
            F.when(F.size(F.col(f"critic.{side}")) > 0, F.col(f"critic.{side}")), F.col(f"player.{side}"), F.array().cast("array<string>")
        ),
        1,
        most[side],
    )
    return told.select("item_id", pick("positive").alias("strengths"), pick("negative").alias("watch_outs"))


def detail(items: DataFrame, channels: DataFrame, tags: DataFrame, similar: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One nested row for each item: its scores and verdict, its channels (lead first) with theirs, its tags, its neighbours in rank.

    items: item_id, title, critic, critic_count, user, user_count; channels: item_id, channel_id, is_lead, critic, critic_count, user,
    user_count; tags: item_id, tag; similar: item_id, other_id, rank, similarity. `pending`: there are channels, but none has a valid score."""
    scored = lambda rows: rows.withColumns(
        {"critic_score": scores.score_struct("critic", "critic_count", 100, 1, settings), "player_score": scores.score_struct("user", "user_count", 10, settings.zero_min_ratings, settings)}
    )
    listed = children(scored(channels), "item_id", "channels", [~F.col("is_lead"), "channel_id"], "channel_id", "is_lead", "critic_score", "player_score")
    own = scored(items)
    rows = with_children(
        own,
        "item_id",
        channels=listed,
        tags=children(tags, "item_id", "tags", ["tag"], "tag"),
        similar=children(similar, "item_id", "similar", ["rank"], "other_id", "similarity"),
    )
    verdict = scores.verdict(F.col("critic_score.normalized"), F.col("player_score.normalized"), settings)
    valid = F.exists("channels", lambda c: c["critic_score"]["status"] == "valid")
    best = F.array_max(F.transform("channels", lambda c: c["critic_score"]["normalized"]))
    return rows.withColumns({"verdict": verdict, "best_channel_score": best, "pending": (F.size("channels") > 0) & ~valid})
