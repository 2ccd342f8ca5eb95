"""Idempotent merges as pure functions: (target, delta) -> rows; writing is up to the caller, or to `stored`.

A delta that repeats a key counts as one row of it: of an insert the first, of an update the last, by `seq`, or by the rows' own values where
that is not given or ties. A null in a key equals nothing, as in a unique index: such rows are new ones, each for itself."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(delta: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Of rows that repeat a key, the one given last. An aggregate: nothing is sorted."""
    rest = [c for c in delta.columns if c not in keys]
    last = delta.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_x"))
    return last.select(*keys, *[F.col(f"_x.`{c}`").alias(c) for c in rest]).select(*delta.columns)


def replace_groups(target: DataFrame, rows: DataFrame, by: Sequence[str], groups: DataFrame) -> DataFrame:
    """target with the named groups' rows replaced; a group without new rows is empty afterwards.

    The groups, of each one row, are hashed in the tasks that they are dealt over, so neither side is sorted or held."""
    named = groups.select(*by).distinct().hint("shuffle_hash")
    return target.join(named, list(by), "left_anti").unionByName(rows.join(named, list(by), "left_semi"))


def one_each(delta: DataFrame, keys: Sequence[str], seq: str | None = None, last: bool = True) -> DataFrame:
    """One row of each key, the last or the first; rows with a null in their key stay as they are. An aggregate, combined before the shuffle."""
    rest = [c for c in delta.columns if c not in keys]
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    if not rest:
        return delta.filter(~null).distinct().unionByName(delta.filter(null))
    order = F.struct(*([F.col(seq).alias("_seq")] if seq else []), *[F.col(c).alias(f"_{k}") for k, c in enumerate(rest)])
    one = delta.filter(~null).groupBy(*keys).agg((F.max if last else F.min)(order).alias("_x"))
    named = one.select(*keys, *[F.col(f"_x._{k}").alias(c) for k, c in enumerate(rest)]).select(*delta.columns)
    return named.unionByName(delta.filter(null))


def insert_ignore(target: DataFrame, delta: DataFrame, keys: Sequence[str], seq: str | None = None) -> DataFrame:
    """The rows of delta that an insert would add."""
    return one_each(delta, keys, seq, last=False).join(target.select(*keys), list(keys), "left_anti").select(*delta.columns)


def classify(target: DataFrame, delta: DataFrame, keys: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """delta with action: inserted, updated or unchanged (null-safe)."""
    old = target.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in compared], F.lit(True).alias("_known"))
    rows = delta.join(old, list(keys), "left")
    moved = F.lit(False)
    for c in compared:
        moved = moved | ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    action = F.when(F.col("_known").isNull(), "inserted").when(moved, "updated").otherwise("unchanged")
    return rows.withColumn("action", action).drop("_known", *[f"_old_{c}" for c in compared])


def upsert(target: DataFrame, delta: DataFrame, keys: Sequence[str], updated: Sequence[str], supplied: Mapping[str, Column] | None = None, seq: str | None = None) -> DataFrame:
    """target with delta's rows; on known keys only the named columns change, and of those in `supplied` only where its condition on delta's row holds.

    Columns that delta lacks are null in new rows."""
    supplied = supplied or {}
    delta = one_each(delta, keys, seq)
    told = [F.coalesce(supplied.get(c, F.lit(True)), F.lit(False)).alias(f"_told_{c}") for c in updated]
    new = delta.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in delta.columns if c not in keys], *told, F.lit(True).alias("_in"))
    both = target.withColumn("_at", F.lit(True)).join(new, list(keys), "full")
    rows = {}
    for c in target.columns:
        if c in keys:
            continue
        fresh = F.col(f"_new_{c}") if c in delta.columns else F.lit(None)
        kept = F.when(F.col("_in") & F.col(f"_told_{c}"), fresh).otherwise(F.col(c)) if c in updated else F.col(c)
        rows[c] = F.when(F.col("_at"), kept).otherwise(fresh)
    return both.select(*keys, *[rows[c].alias(c) for c in target.columns if c not in keys])


def moved(target: DataFrame, delta: DataFrame, key: str, score: str) -> DataFrame:
    """Keys whose score changed; a new key counts only with a score."""
    old = target.select(key, F.col(score).alias("before"), F.lit(True).alias("_known"))
    rows = delta.select(key, F.col(score).alias("after")).join(old, key, "left")
    change = F.when(F.col("_known"), ~F.col("before").eqNullSafe(F.col("after"))).otherwise(F.col("after").isNotNull())
    return rows.filter(change).drop("_known")


def single_lead(rows: DataFrame, group: str, flag: str, position: str) -> DataFrame:
    """Exactly one lead for each group: the first flagged row, else the first."""
    group_rows = Window.partitionBy(group)
    first = F.coalesce(F.min(F.when(F.col(flag), F.col(position))).over(group_rows), F.min(position).over(group_rows))
    return rows.withColumn(flag, F.col(position) == first)


def prune(rows: DataFrame, group: str, version: str, keep: int, current: str) -> DataFrame:
    """The versions to delete: not current, beyond the newest `keep`."""
    order = Window.partitionBy(group).orderBy(F.desc(version))
    return rows.filter(~F.col(current)).withColumn("_k", F.row_number().over(order)).filter(F.col("_k") > keep).drop("_k")


def next_versions(history: DataFrame, fresh: DataFrame, group: str) -> DataFrame:
    """fresh rows with version: one more than the group's largest."""
    top = history.groupBy(group).agg(F.max("version").alias("_top"))
    return fresh.join(top, group, "left").withColumn("version", F.coalesce("_top", F.lit(0)) + 1).drop("_top")


def link_changes(current: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Links to insert and to delete. One aggregate, combined before the shuffle: nothing is sorted or joined."""
    both = current.select(*keys, F.lit(True).alias("_had")).unionByName(wanted.select(*keys, F.lit(False).alias("_had")))
    links = both.groupBy(*keys).agg(F.bool_or("_had").alias("_in"), F.bool_or(~F.col("_had")).alias("_asked"))
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    change = F.array(F.when(F.col("_asked") & (~F.col("_in") | null), "insert"), F.when(F.col("_in") & (~F.col("_asked") | null), "delete"))
    return links.select(*keys, F.explode(F.array_compact(change)).alias("change"))
