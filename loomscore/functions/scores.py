"""Scores under the rule that missing is not zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import DEFAULT, Settings
from .text import col


def effective(raw: Column | str, count: Column | str, zero_min: int = DEFAULT.zero_min_ratings) -> Column:
    """A raw score counts if it is present, somebody gave it, and a zero was given often enough."""
    raw, count = col(raw), F.coalesce(col(count), F.lit(0))
    return F.when((count > 0) & ~((raw == 0) & (count < zero_min)), raw)


def gap(critic: Column, user: Column) -> Column:
    """Distance on the scale to 100, unrounded; null if either side is missing."""
    return F.abs(critic - user * 10)


def normalized(raw: Column | str, scale: int) -> Column:
    """On the scale to 100, rounded half to even."""
    return F.bround(col(raw).cast("double") * (100.0 / scale), 0).cast("int")


def tier(score: Column | str) -> Column:
    s = col(score)
    return F.when(s.isNull(), "none").when(s >= 85, "excellent").when(s >= 70, "good").when(s >= 50, "mixed").otherwise("poor")


def score_struct(raw: Column | str, count: Column | str, scale: int, zero_min: int, settings: Settings = DEFAULT) -> Column:
    value = effective(raw, count, zero_min)
    n = F.coalesce(col(count), F.lit(0))
    status = (
        F.when(value.isNotNull(), "valid").when(col(raw).isNull(), "missing").when(n <= 0, "unrated").otherwise("not_enough")
    )
    points = normalized(value, scale)
    return F.struct(
        status.alias("status"),
        value.cast("double").alias("value"),
        points.alias("normalized"),
        tier(points).alias("tier"),
        (value.isNotNull() & (n < settings.low_sample)).alias("low_sample"),
    )


def verdict(critic: Column, user: Column, settings: Settings = DEFAULT) -> Column:
    """The kind of agreement between two normalised scores."""
    delta = critic - user
    return (
        F.when(critic.isNull() & user.isNull(), "none")
        .when(critic.isNull(), "player_only")
        .when(user.isNull(), "critic_only")
        .when(F.abs(delta) < settings.agreement, "agree")
        .when(delta > 0, "players_lower")
        .otherwise("players_higher")
    )


def consensus(critic: Column, user: Column, settings: Settings = DEFAULT) -> Column:
    """(note, tone) of the agreement."""
    delta = critic - user
    note = (
        F.when(delta.isNull(), "one_sided")
        .when(F.abs(delta) < settings.agreement, "agree")
        .when(delta > 0, "lower")
        .otherwise("higher")
    )
    return F.struct(note.alias("note"), F.when(note == "lower", "warning").otherwise("neutral").alias("tone"))
