"""The catalogue read from the test tables, as DataFrames and as the same SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog
from .registry import ORACLE_SQL, QUERIES

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = "2026-06-01"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that checks it."""

    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder under the one that driver and executors share; only where Spark runs in this one process may there be none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="streams-")
    return f"{base}/work-{uuid.uuid4().hex}"


def item_channels(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a part (item) at a supplier (channel), from sums of whole numbers only."""
    sums = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("channel_id")).agg(
        F.sum(F.col("l_quantity").cast("int")).alias("q"),
        F.sum(F.round(F.col("l_discount") * 100).cast("int")).alias("d"),
        F.count("*").alias("n"),
    )
    critic = F.when(F.col("q") % 7 == 0, None).when(F.col("q") % 11 == 0, 0).otherwise(F.expr("least(100, 2 * q div n)")).cast("int")
    user = F.when(F.col("q") % 5 == 0, None).when(F.col("q") % 13 == 0, 0.0).otherwise(10 - F.col("d") / F.col("n"))
    return sums.select(
        "item_id",
        "channel_id",
        critic.alias("critic"),
        F.col("n").alias("critic_count"),
        user.alias("user"),
        (F.col("n") * (F.col("channel_id") % 8) * 5).alias("user_count"),
        (F.col("channel_id") % 3 == 0).alias("is_lead"),
    )


ITEM_CHANNELS = """ic0 AS (
    SELECT l_partkey AS item_id, l_suppkey AS channel_id, sum(CAST(l_quantity AS INT)) AS q, sum(CAST(round(l_discount * 100) AS INT)) AS d, count(*) AS n
    FROM lineitem GROUP BY ALL
), ic AS (
    SELECT item_id, channel_id, CAST(CASE WHEN q % 7 = 0 THEN NULL WHEN q % 11 = 0 THEN 0 ELSE least(100, 2 * q // n) END AS INT) AS critic, n AS critic_count,
           CASE WHEN q % 5 = 0 THEN NULL WHEN q % 13 = 0 THEN 0.0::DOUBLE ELSE 10 - d::DOUBLE / n END AS "user",
           n * (channel_id % 8) * 5 AS user_count, channel_id % 3 = 0 AS is_lead
    FROM ic0
)"""


def items(spark: SparkSession, d: str) -> DataFrame:
    """Parts with a release date (some lack one) and their rolled-up scores."""
    parts = table(spark, d, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("title"),
        F.lower("p_name").alias("title_norm"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("type"),
        F.col("p_size").alias("size"),
        F.when(F.col("p_partkey") % 17 != 0, F.date_add(F.lit("2019-01-01").cast("date"), (F.col("p_partkey") * 37 % 2700).cast("int"))).alias("release_date"),
    )
    return parts.join(catalog.rollup(item_channels(spark, d)), "item_id", "left")


ITEMS = f"""WITH {ITEM_CHANNELS}, roll AS (
    SELECT item_id, arg_max(critic, (critic, -channel_id)) AS critic, coalesce(arg_max(critic_count, (critic, -channel_id)) FILTER (WHERE critic IS NOT NULL), 0) AS critic_count,
           arg_max("user", ("user", -channel_id)) FILTER (WHERE "user" IS NOT NULL AND user_count > 0) AS "user",
           coalesce(arg_max(user_count, ("user", -channel_id)) FILTER (WHERE "user" IS NOT NULL AND user_count > 0), 0) AS user_count,
           coalesce(min(channel_id) FILTER (WHERE is_lead), min(channel_id)) AS lead_channel, CAST(sum(user_count) AS BIGINT) AS user_total, count(*) AS n_channels
    FROM ic GROUP BY item_id
), roll2 AS (SELECT * REPLACE ((SELECT max(critic) FROM ic WHERE ic.item_id = roll.item_id) AS critic) FROM roll),
items AS (
    SELECT p_partkey AS item_id, p_name AS title, lower(p_name) AS title_norm, p_brand AS brand, p_type AS type, p_size AS size,
           CASE WHEN p_partkey % 17 <> 0 THEN DATE '2019-01-01' + CAST(p_partkey * 37 % 2700 AS INT) END AS release_date, roll2.* EXCLUDE (item_id)
    FROM part LEFT JOIN roll2 ON p_partkey = roll2.item_id
), eff0 AS (
    SELECT *, CASE WHEN critic_count > 0 AND NOT (critic = 0 AND critic_count < 20) THEN critic END AS eff_critic,
           CASE WHEN user_count > 0 AND NOT ("user" = 0 AND user_count < 20) THEN "user" END AS eff_user FROM items
), eff AS (SELECT *, abs(eff_critic - eff_user * 10) AS gap FROM eff0)
"""
