"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle
from .mixing import word_count


def place(loads: np.ndarray, shards: int, first: int = 0) -> np.ndarray:
    """The shard of each unit, taken from the largest down: where the dot product of its load with the residual capacity is highest.

    loads: units by dimensions; of each dimension a shard has an even part of the units' sum as its capacity, so a dimension counts
    by the square of its sum. `first` is where ties start."""
    spare = np.tile(loads.sum(axis=0) / shards, (shards, 1))
    chosen = np.empty(len(loads), np.int64)
    order = np.lexsort((np.arange(len(loads)), -loads[:, 0]))
    turn = (np.arange(shards) + first) % shards
    spare_turned = spare[turn]
    for k in order:
        best = int(np.argmax(spare_turned @ loads[k]))
        chosen[k] = turn[best]
        spare_turned[best] -= loads[k]
    return chosen


def shard_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shards: int = 40,
    overhead: int = 16,
    parts: int = 8,
    block_units: int = 20_000,
    slot_run: int = 100_000,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) under the law `bytes`: near-equal sums of sizes.

    Units are groups of equal texts. A group with over 1/(shards * parts) of all bytes or rows is split by hash into
    units below that: at most 2 * shards * parts groups are so large, hence the broadcast. Units are dealt by hash into
    blocks of about block_units; each block fills all shards with its own even part of their capacity, so the imbalance is that of
    the smallest units and no task sees more than a block. The law asks for near-equal bytes, so tokens and rows enter the dot product
    with `weights`. Slots are gapless in a shard: a block's rows of a shard are numbered in runs of about slot_run, and what stands
    before a run comes from sums on two levels, of about a thousand blocks and of the runs within them.

    size: UTF-8 bytes and `overhead`; a null text has none and counts as the empty one; tokens are words. Repeated rows are
    separate rows, a null key stays, other columns are not read, an empty table gives an empty result."""
    rows = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"),
        word_count(text).alias("tokens"),
    )
    rows = settle(rows)
    total = rows.agg(F.sum("size").alias("size"), F.count("*").alias("rows")).first()
    if not total["rows"]:
        return rows.selectExpr("key", "size", "text_crc32", "'bytes' AS law", "0 AS shard", "0L AS slot", "cast(NULL AS int) AS grown_shard").withColumnRenamed("key", key)
    most = shards * parts
    groups = rows.groupBy("_hash").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    share = F.greatest(F.col("b") * most / F.lit(total["size"]), F.col("n") * most / F.lit(total["rows"]))
    large = groups.filter((share > 1) & (F.col("n") > 1)).select("_hash", F.ceil(2 * share).cast("int").alias("_parts"))
    rows = rows.join(F.broadcast(large), "_hash", "left")
    # The row's number keeps rows of one key and text apart; it is drawn once.
    rows = rows.withColumn("_draw", F.xxhash64("key", F.monotonically_increasing_id()))
    part = F.pmod("_draw", F.coalesce("_parts", F.lit(1))).cast("int")
    rows = settle(rows.withColumns({"_part": part, "_split": F.col("_parts").isNotNull()}).drop("_parts"))
    units = rows.groupBy("_hash", "_part", "_split").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    units = settle(units)
    blocks = max(1, round(units.count() / block_units))
    units = units.withColumn("_block", F.pmod(F.xxhash64("_hash", "_part"), F.lit(blocks)).cast("int"))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_hash", "_part"]).reset_index(drop=True)
        loads = frame[["size", "tokens", "rows"]].to_numpy(np.float64)
        loads = loads / np.maximum(loads.sum(axis=0), 1) * np.sqrt(weights)
        frame["shard"] = place(loads, shards, 7 * int(frame["_block"].iloc[0])).astype(np.int32)
        frame["_runs"] = -(-frame.groupby("shard")["rows"].transform("sum") // slot_run)
        return frame[["_hash", "_part", "_split", "_block", "shard", "_runs"]]

    placed = settle(units.groupBy("_block").applyInPandas(fill, "_hash long, _part int, _split boolean, _block int, shard int, _runs long"))
    unit = ["_hash", "_part", "_split"]
    split = rows.filter("_split").join(F.broadcast(placed.filter("_split")), unit)  # the parts of at most 2 * shards * parts groups
    found = split.unionByName(rows.filter("NOT _split").join(placed.filter("NOT _split"), unit))
    found = found.withColumn("_run", F.pmod(F.xxhash64("_draw"), F.col("_runs")).cast("int"))
    counts = settle(found.groupBy("shard", "_block", "_run").agg(F.count("*").alias("n")).withColumn("_many", F.floor(F.col("_block") / 1000)))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("shard", "_many").agg(F.sum("n").alias("n"))
    sums = sums.select("shard", "_many", F.coalesce(F.sum("n").over(before("shard").orderBy("_many")), F.lit(0)).alias("_past"))
    inner = F.coalesce(F.sum("n").over(before("shard", "_many").orderBy("_block", "_run")), F.lit(0))
    bases = settle(counts.withColumn("_inner", inner).join(sums, ["shard", "_many"]).select("shard", "_block", "_run", (F.col("_past") + F.col("_inner")).alias("_base")))
    within = Window.partitionBy("shard", "_block", "_run").orderBy("key", "text_crc32", "size")
    slot = F.col("_base") + F.row_number().over(within) - 1
    result = found.join(bases, ["shard", "_block", "_run"]).withColumn("slot", slot.cast("long"))
    return result.select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
