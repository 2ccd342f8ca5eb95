"""Catalogue operators: rollups, facets, filters, sorts, rails, search."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..settings import DEFAULT, Settings


def best_of(score: Column, *carried: Column) -> Column:
    """The largest score with the least carried values among ties, as one aggregate."""
    return F.max(F.when(score.isNotNull(), F.struct(score.alias("score"), *carried)))


def rollup(channels: DataFrame) -> DataFrame:
    """One row for each item: best critic (any count), best user (count over 0), sums and the lead channel; ties: least channel."""
    back = (-F.col("channel_id")).alias("tie")
    best_critic = best_of(F.col("critic"), back, F.col("critic_count").alias("count"))
    rated = F.when(F.col("user_count") > 0, F.col("user"))
    best_user = best_of(rated, back, F.col("user_count").alias("count"))
    rows = channels.groupBy("item_id").agg(
        best_critic.alias("c"),
        best_user.alias("u"),
        F.coalesce(F.min(F.when(F.col("is_lead"), F.col("channel_id"))), F.min("channel_id")).alias("lead_channel"),
        F.sum("user_count").alias("user_total"),
        F.count("*").alias("n_channels"),
    )
    return rows.select(
        "item_id",
        F.col("c.score").alias("critic"),
        F.coalesce("c.count", F.lit(0)).cast("long").alias("critic_count"),
        F.col("u.score").alias("user"),
        F.coalesce("u.count", F.lit(0)).cast("long").alias("user_count"),
        "lead_channel",
        "user_total",
        "n_channels",
    )


def with_effective(items: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    critic = scores.effective("critic", "critic_count", settings.zero_min_ratings)
    user = scores.effective("user", "user_count", settings.zero_min_ratings)
    rows = items.withColumns({"eff_critic": critic, "eff_user": user})
    return rows.withColumn("gap", scores.gap(F.col("eff_critic"), F.col("eff_user")))


SORTS = {
    "score": F.desc_nulls_last,
    "user": F.desc_nulls_last,
    "date": F.desc_nulls_last,
    "title": F.asc_nulls_last,
    "gap": F.desc_nulls_last,
}
COLUMNS = {"score": "eff_critic", "user": "eff_user", "date": "release_date", "title": "title", "gap": "gap"}


def sorted_page(items: DataFrame, by: str, offset: int = 0, limit: int = 24) -> DataFrame:
    """One page; missing values last, newest id first among ties. Offsets over 10,000 are refused."""
    if not 0 <= offset <= 10_000:
        raise ValueError("offset must be from 0 to 10000")
    return items.orderBy(SORTS[by](COLUMNS[by]), F.desc("item_id")).offset(offset).limit(limit)


def band(items: DataFrame, name: str) -> DataFrame:
    """Cumulative score bands."""
    least = {"excellent": 85, "good": 70, "mixed": 50}
    return items.filter(F.col("eff_critic").isNull() if name == "unrated" else F.col("eff_critic") >= least[name])


def released(items: DataFrame, window: str, as_of: str, year: int) -> DataFrame:
    date = F.col("release_date")
    kept = {
        "last30": date.between(F.date_sub(F.lit(as_of).cast("date"), 30), F.lit(as_of).cast("date")),
        "year": F.year(date) == year,
        "earlier": date.isNull() | (F.year(date) < year),
    }
    return items.filter(kept[window])


def facet(links: DataFrame, items: DataFrame, key: str, dimension: DataFrame | None = None) -> DataFrame:
    """Distinct filtered items for each key; with a dimension, keys without any count 0.

    The items' ids are hashed where they are dealt to, so links are neither sorted nor held."""
    counted = links.join(items.select("item_id").hint("shuffle_hash"), "item_id", "left_semi").groupBy(key).agg(F.countDistinct("item_id").alias("n_items"))
    if dimension is None:
        return counted
    return dimension.join(counted, key, "left").withColumn("n_items", F.coalesce("n_items", F.lit(0).cast("long")))


def _named(facet: str) -> Callable[[Column], Column]:
    return lambda value: F.struct(F.lit(facet).alias("facet"), value.alias("value"))


def facets(items: DataFrame, dimensions: Mapping[str, Column], filters: Mapping[str, Column]) -> DataFrame:
    """(facet, value, n_items): the counts of every dimension of one request, from one scan and one aggregate.

    items has one row for each item; a dimension is an array of its values (null or empty: none). Filters are conditions on an
    item's row; a null one fails. Each item gets a mask of the filters that it fails, so a dimension with a filter of its own name counts the
    items that fail no other. The facet `total` (value null) counts those that fail none."""
    bits = {name: 1 << k for k, name in enumerate(filters)}
    failed = F.lit(0)
    for name, holds in filters.items():
        failed = failed + F.when(F.coalesce(holds, F.lit(False)), 0).otherwise(bits[name])
    rows = items.withColumn("_failed", failed)
    told = []
    for name, values in dimensions.items():
        some = F.array_distinct(F.filter(values, lambda v: v.isNotNull()))
        named = F.transform(some.cast("array<string>"), _named(name))
        told.append(F.when((F.col("_failed").bitwiseAND(~bits.get(name, 0))) == 0, named))
    everything = F.array(F.struct(F.lit("total").alias("facet"), F.lit(None).cast("string").alias("value")))
    told.append(F.when(F.col("_failed") == 0, everything))
    each = rows.select(F.explode(F.flatten(F.array(*[F.coalesce(t, F.array().cast("array<struct<facet:string,value:string>>")) for t in told]))).alias("x"))
    return each.groupBy("x.facet", "x.value").agg(F.count("*").alias("n_items"))


def tagged(items: DataFrame, links: DataFrame, key: str, wanted: Sequence[object]) -> DataFrame:
    """Items with any of the wanted tags; without any wanted, all items."""
    if not wanted:
        return items
    return items.join(links.filter(F.col(key).isin(*wanted)).select("item_id"), "item_id", "left_semi")


def channel_line(channels: DataFrame, points: int = DEFAULT.channel_gap) -> DataFrame:
    """(item_id, channel_id, behind): how far an item's lead channel lies behind its best one, if by `points` or more."""
    lead = F.coalesce(F.min(F.when(F.col("is_lead"), F.col("channel_id"))), F.min("channel_id"))
    best = channels.groupBy("item_id").agg(F.max("critic").alias("top"), lead.alias("channel_id"))
    behind = F.col("top") - F.col("critic")
    return channels.join(best, ["item_id", "channel_id"]).select("item_id", "channel_id", F.when(behind >= points, behind).alias("behind"))


def rails(now: str, recent: int = 30) -> dict[str, tuple[Column, str, int]]:
    """Of each rail: which items it takes, by what it is sorted (largest first), how many it shows. In the order of their priority."""
    today = F.lit(now).cast("date")
    return {
        "just_released": (F.col("release_date").between(F.date_sub(today, recent), today), "release_date", 12),
        "highest_rated": ((F.col("eff_critic") >= 85) & (F.col("critic_count") >= 1), "eff_critic", 12),
        "biggest_gaps": (F.col("gap") >= 10, "gap", 12),
        "recently_updated": (F.col("updated_at").isNotNull(), "updated_at", 5),
    }


def rail(items: DataFrame, one: tuple[Column, str, int]) -> DataFrame:
    where, by, n = one
    return items.filter(where).orderBy(F.desc_nulls_last(by), F.desc("item_id")).limit(n)


def spotlight(items: DataFrame, wanted: dict[str, tuple[Column, str, int]]) -> DataFrame:
    """(item_id, title, rail): the first row of the first rail that has any. One aggregate over the items, whatever the number of rails."""
    tops = [
        F.max(F.when(where, F.struct(F.col(by).alias("by"), "item_id", "title"))).alias(name) for name, (where, by, _) in wanted.items()
    ]
    found = items.agg(*tops)
    first = F.coalesce(*[F.when(F.col(n).isNotNull(), F.struct(F.col(f"{n}.item_id"), F.col(f"{n}.title"), F.lit(n).alias("rail"))) for n in wanted])
    return found.select(first.alias("x")).filter("x IS NOT NULL").select("x.*")


def channel_budget(channels: DataFrame, most: int = 3, least_volume: int = 0) -> DataFrame:
    """The channels of each item to read: the lead first, then others with at least least_volume, by volume; `most` at most."""
    order = Window.partitionBy("item_id").orderBy(F.desc("is_lead"), F.desc("volume"), "channel_id")
    open_ = channels.filter(F.col("is_lead") | (F.col("volume") >= least_volume))
    return open_.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most).drop("_k")


def suggest(items: DataFrame, needle: str, limit: int = 8) -> DataFrame:
    """Titles that start with or contain the needle, prefixes first; fewer than two characters find nothing."""
    key = F.col("title_norm")
    hits = items.filter(key.contains(needle) & F.lit(len(needle) >= 2))
    ranked = hits.withColumn("prefix", F.when(key.startswith(needle), 0).otherwise(1))
    return ranked.orderBy("prefix", F.desc_nulls_last("critic"), "item_id").limit(limit)


def search(items: DataFrame, needle: str, least: float = 0.25) -> DataFrame:
    """Items whose title starts with, contains or resembles the needle by trigrams."""
    own = text.trigrams("title_norm")
    likeness = text.overlap(own, text.trigrams(F.lit(needle)))
    rows = items.withColumn("likeness", likeness)
    return rows.filter(F.col("title_norm").contains(needle) | (F.col("likeness") > least))
