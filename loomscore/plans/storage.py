"""Queries of tables on storage: merges that read and rewrite what they touch, a maintained rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stored
from .base import ITEM_CHANNELS, item_channels, query, table, work_folder

# Three deltas over the lines of parts: rows that repeat keys, rows of new keys, and a null key.
_TARGET = "target AS (SELECT l_partkey AS k, l_suppkey AS s, CAST(max(l_quantity) AS BIGINT) AS q, min(l_returnflag) AS flag FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL)"
_NEW = "delta AS (SELECT l_partkey AS k, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS flag, l_orderkey * 10 + l_linenumber AS seq FROM lineitem WHERE l_linenumber >= 3 AND l_partkey % 3 = 0)"


def _target(spark: SparkSession, d: str) -> stored.StoredTable:
    rows = table(spark, d, "lineitem").filter("l_linenumber <= 3").groupBy(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"))
    rows = rows.agg(F.max("l_quantity").cast("long").alias("q"), F.min("l_returnflag").alias("flag"))
    return stored.StoredTable(spark, work_folder(spark), ["k"], buckets=16).create(rows)


def _delta(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").filter("l_linenumber >= 3 AND l_partkey % 3 = 0")
    return rows.select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("long").alias("q"), F.col("l_returnflag").alias("flag"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


@query(f"""WITH {_TARGET}, {_NEW}, one AS (SELECT * FROM delta QUALIFY row_number() OVER (PARTITION BY k, s ORDER BY seq DESC) = 1)
SELECT coalesce(t.k, o.k) AS k, coalesce(t.s, o.s) AS s, CASE WHEN o.k IS NOT NULL AND (t.k IS NULL OR o.q > 20) THEN o.q ELSE t.q END AS q, coalesce(t.flag, o.flag) AS flag FROM target t FULL JOIN one o ON t.k = o.k AND t.s = o.s""")
def stored_upsert(spark, d):
    """The last row of a key in the delta counts; a quantity changes only if it is over 20, a flag only in new rows."""
    target = _target(spark, d)
    target.upsert(_delta(spark, d), ["k", "s"], ["q"], {"q": F.col("q") > 20}, "seq")
    return target.read()


@query(f"""WITH {_TARGET}, {_NEW} SELECT k, s, q, flag FROM delta WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.k = delta.k AND t.s = delta.s) QUALIFY row_number() OVER (PARTITION BY k, s ORDER BY seq) = 1""")
def stored_insert(spark, d):
    """What an insert adds, once for each new key; done again it adds nothing."""
    target, delta = _target(spark, d), _delta(spark, d)
    added = target.insert_ignore(delta, ["k", "s"], "seq")
    again = target.insert_ignore(delta, ["k", "s"], "seq")
    return added.union(again).select("k", "s", "q", "flag")


@query(f"""WITH {_TARGET} SELECT k, s, q, flag FROM target WHERE k % 5 <> 0 UNION ALL SELECT DISTINCT l_partkey, l_suppkey, 0::BIGINT, 'new' FROM lineitem WHERE l_partkey % 10 = 0 AND l_linenumber = 1""")
def stored_groups(spark, d):
    """Every fifth part's rows are replaced; every other of those parts has none afterwards."""
    target = _target(spark, d)
    lines = table(spark, d, "lineitem")
    rows = lines.filter("l_partkey % 10 = 0 AND l_linenumber = 1").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"), F.lit(0).cast("long").alias("q"), F.lit("new").alias("flag")).distinct()
    target.replace_groups(rows, lines.filter("l_partkey % 5 = 0").select(F.col("l_partkey").alias("k")))
    return target.read()


_CHANGES = """changes AS (SELECT item_id, channel_id, CASE WHEN item_id % 2 = 0 THEN critic + 1 END AS critic, critic_count + 1 AS critic_count, CASE WHEN channel_id % 2 = 0 THEN "user" / 2 END AS "user",
    CASE WHEN channel_id % 2 = 0 THEN user_count + 1 ELSE 0 END AS user_count, channel_id % 4 = 1 AS is_lead FROM ic WHERE item_id % 7 = 0 AND channel_id % 3 > 0
    UNION ALL SELECT item_id, channel_id + 1000000, 99, 7, NULL, 0, false FROM ic WHERE item_id % 7 = 0 AND channel_id % 3 = 0)"""


@query(f"""WITH {ITEM_CHANNELS}, {_CHANGES}, named AS (SELECT DISTINCT item_id FROM changes),
now_ AS (SELECT coalesce(o.item_id, c.item_id) AS item_id, coalesce(o.channel_id, c.channel_id) AS channel_id, CASE WHEN c.item_id IS NULL THEN o.critic ELSE c.critic END AS critic, CASE WHEN c.item_id IS NULL THEN o.critic_count ELSE c.critic_count END AS critic_count,
    CASE WHEN o.item_id IS NULL OR c."user" IS NOT NULL OR c.user_count > 0 THEN c."user" ELSE o."user" END AS "user", CASE WHEN o.item_id IS NULL OR c."user" IS NOT NULL OR c.user_count > 0 THEN c.user_count ELSE o.user_count END AS user_count,
    CASE WHEN c.item_id IS NOT NULL THEN c.is_lead WHEN o.item_id IN (SELECT item_id FROM named) THEN false ELSE o.is_lead END AS is_lead
    FROM ic o FULL JOIN changes c ON o.item_id = c.item_id AND o.channel_id = c.channel_id)
SELECT item_id, max(critic) AS critic, coalesce(arg_max(critic_count, (critic, -channel_id)) FILTER (WHERE critic IS NOT NULL), 0) AS critic_count, round(max("user") FILTER (WHERE user_count > 0), 6) AS "user",
    coalesce(arg_max(user_count, ("user", -channel_id)) FILTER (WHERE "user" IS NOT NULL AND user_count > 0), 0) AS user_count, coalesce(min(channel_id) FILTER (WHERE is_lead), min(channel_id)) AS lead_channel, CAST(sum(user_count) AS BIGINT) AS user_total, count(*) AS n_channels
FROM now_ GROUP BY item_id""")
def maintained_rollup(spark, d):
    """Rollups kept up through two deltas: some channels' scores move, user scores only where they are supplied, some channels are new, leads move."""
    own = item_channels(spark, d)
    kept = stored.MaintainedRollup(spark, work_folder(spark), buckets=16).create(own)
    seventh, even = own.filter("item_id % 7 = 0"), F.col("channel_id") % 2 == 0
    moved = seventh.filter("channel_id % 3 > 0").select(
        "item_id", "channel_id", F.when(F.col("item_id") % 2 == 0, F.col("critic") + 1).alias("critic"), (F.col("critic_count") + 1).alias("critic_count"), F.when(even, F.col("user") / 2).alias("user"),
        F.when(even, F.col("user_count") + 1).otherwise(0).alias("user_count"), (F.col("channel_id") % 4 == 1).alias("is_lead"),
    )
    new = seventh.filter("channel_id % 3 = 0").select(
        "item_id", (F.col("channel_id") + 1_000_000).alias("channel_id"), F.lit(99).alias("critic"), F.lit(7).cast("long").alias("critic_count"), F.lit(None).cast("double").alias("user"), F.lit(0).cast("long").alias("user_count"), F.lit(False).alias("is_lead"),
    )
    kept.apply(moved.union(new).filter("item_id % 2 = 0"))
    kept.apply(moved.union(new).filter("item_id % 2 = 1"))
    return kept.read().withColumn("user", F.round("user", 6))
