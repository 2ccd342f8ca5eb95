"""Tables on storage that take merges: Parquet in buckets of a key's hash, of which a change reads and rewrites those that it touches.

A change is repeatable. What the touched buckets shall hold is written beside the table first, with a note of which they are; then the
buckets are overwritten from it, and the note goes last. Whoever opens the table after a crash finds either no note, and drops what was
written beside it, or the note, and overwrites once more: the table is as it was before the change, or as it is after it. One writer at a
time, as with any table of files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from . import catalog, merge

BUCKET = "_bucket"


class _Folder:
    """Files of a path, wherever Spark's paths lead."""

    def __init__(self, spark: SparkSession, path: str):
        context = spark.sparkContext
        self.jvm, self.path = context._jvm, path
        self.system = self.of("").getFileSystem(context._jsc.hadoopConfiguration())

    def of(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.system.exists(self.of(name))

    def delete(self, name: str) -> None:
        self.system.delete(self.of(name), True)

    def put(self, name: str, text: str) -> None:
        """A small file, whole or not at all: written under another name and renamed."""
        made = self.of(f"{name}.{uuid.uuid4().hex}")
        out = self.system.create(made, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.system.delete(self.of(name), False)
        self.system.rename(made, self.of(name))

    def get(self, name: str) -> str:
        found = self.system.open(self.of(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8")
        finally:
            found.close()


class StoredTable:
    """A table of rows that belong to groups of `by` (a part of every key that merges go by)."""

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.by, self.buckets = spark, path, list(by), buckets
        self.folder = _Folder(spark, path)
        self.recover()

    def create(self, rows: DataFrame) -> StoredTable:
        self.folder.delete("rows")
        self._bucketed(rows).write.partitionBy(BUCKET).parquet(f"{self.path}/rows")
        self.folder.put("schema", rows.schema.json())
        return self

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.folder.get("schema")))

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        """One file for each bucket and writing task that has rows of it."""
        bucket = F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")
        return rows.withColumn(BUCKET, bucket).repartition(BUCKET)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the rows' groups: `buckets` numbers at most."""
        bucket = F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")
        return sorted(r[0] for r in rows.select(bucket.alias(BUCKET)).distinct().collect())

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows, of some buckets only if they are named: other files are not opened."""
        own = self.schema
        path = f"{self.path}/rows"
        rows = self.spark.read.schema(StructType(own.fields).add(BUCKET, IntegerType())).parquet(path)
        if buckets is not None:
            rows = rows.filter(F.col(BUCKET).isin(list(buckets)))
        return rows.drop(BUCKET)

    def recover(self) -> None:
        """Finish a change that was told whole, drop one that was not."""
        if self.folder.exists("change/told"):
            self._overwrite()
        elif self.folder.exists("change"):
            self.folder.delete("change")

    def rewrite(self, buckets: list[int], rows: DataFrame) -> None:
        """The buckets hold these rows afterwards, and no others."""
        if not buckets:
            return
        self._stage(buckets, rows)
        self._overwrite()

    def _stage(self, buckets: list[int], rows: DataFrame) -> None:
        self.folder.delete("change")
        self._bucketed(rows).write.partitionBy(BUCKET).parquet(f"{self.path}/change/rows")
        filled = [b for b in buckets if self.folder.exists(f"change/rows/{BUCKET}={b}")]
        self.folder.put("change/told", json.dumps({"filled": filled, "empty": [b for b in buckets if b not in filled]}))

    def _overwrite(self) -> None:
        told = json.loads(self.folder.get("change/told"))
        if told["filled"]:
            staged = self.spark.read.schema(StructType(self.schema.fields).add(BUCKET, IntegerType())).parquet(f"{self.path}/change/rows")
            writer = staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")  # its files are of one bucket each: no shuffle
            writer.partitionBy(BUCKET).parquet(f"{self.path}/rows")
        for b in told["empty"]:
            self.folder.delete(f"rows/{BUCKET}={b}")
        self.folder.delete("change/told")
        self.folder.delete("change")

    def replace_groups(self, rows: DataFrame, groups: DataFrame) -> None:
        """The named groups hold these rows; rows of other groups are not taken, a named group without rows is empty."""
        buckets = self.touched(groups)
        self.rewrite(buckets, merge.replace_groups(self.read(buckets), rows, self.by, groups))

    def upsert(self, delta: DataFrame, keys: Sequence[str], updated: Sequence[str], supplied: Mapping[str, Column] | None = None, seq: str | None = None) -> None:
        buckets = self.touched(delta)
        self.rewrite(buckets, merge.upsert(self.read(buckets), delta, keys, updated, supplied, seq).select(*self.schema.names))

    def insert_ignore(self, delta: DataFrame, keys: Sequence[str], seq: str | None = None) -> DataFrame:
        """Adds the rows whose key is new, and returns them."""
        buckets = self.touched(delta)
        kept = f"{self.path}/inserted-{uuid.uuid4().hex}"
        merge.insert_ignore(self.read(buckets), delta, keys, seq).write.parquet(kept)
        added = self.spark.read.schema(delta.schema).parquet(kept)
        new = self.touched(added)
        self.rewrite(new, self.read(new).unionByName(added, allowMissingColumns=True))
        return added


class MaintainedRollup:
    """Channels of items and what is rolled up of them, both on storage; a delta reads and rewrites the buckets of the items that it names.

    Scores of users change only where a delta supplies them: a sync that knows nothing of them must not wipe out what a later pass has
    fetched. A channel that is not in a delta stays, but leads no longer."""

    KEYS = ("item_id", "channel_id")
    CHANGED = ("critic", "critic_count", "user", "user_count", "is_lead")

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.channels = StoredTable(spark, f"{path}/channels", ["item_id"], buckets)
        self.rollups = StoredTable(spark, f"{path}/rollups", ["item_id"], buckets)

    def create(self, channels: DataFrame) -> MaintainedRollup:
        self.channels.create(channels)
        self.rollups.create(catalog.rollup(self.channels.read()))
        return self

    def apply(self, delta: DataFrame) -> None:
        """A delta (item_id, channel_id, critic, critic_count, user, user_count, is_lead), each channel once. It is worked out once, beside the table, however often it is read."""
        folder, path = self.channels.folder, f"{self.channels.path}/delta"
        folder.delete("delta")  # of a change that broke off
        delta.write.parquet(path)
        delta = self.channels.spark.read.schema(delta.schema).parquet(path)
        supplied = F.col("user").isNotNull() | (F.coalesce("user_count", F.lit(0)) > 0)
        items = delta.select("item_id").distinct()
        buckets = self.channels.touched(items)
        led = self.channels.read(buckets)
        led = led.join(items.withColumn("_named", F.lit(True)), "item_id", "left").withColumn("is_lead", F.col("is_lead") & F.col("_named").isNull()).drop("_named")
        merged = merge.upsert(led, delta, self.KEYS, self.CHANGED, {"user": supplied, "user_count": supplied})
        self.channels.rewrite(buckets, merged.select(*self.channels.schema.names))
        self.rollups.replace_groups(catalog.rollup(self.channels.read(buckets).join(items, "item_id", "left_semi")), items)
        folder.delete("delta")

    def read(self) -> DataFrame:
        return self.rollups.read()
