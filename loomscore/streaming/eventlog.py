"""An append-only event log as a resumable stream: `spark.readStream.format("event_log")`.

An offset is the id up to which events have been read, so a reader that comes back goes on where its checkpoint ends. One that
is more than `backlog` events behind when it starts jumps to the latest, as does one without a cursor: both are told only what happens from then
on. The offset says whether it was the first of its run, so a batch that is planned again after a failure is the same batch."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


#: Rows that a task holds of a file.
BATCH = 8192


@dataclass
class Ids(InputPartition):
    """Events after one id up to another."""

    after: int
    upto: int


class LogReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = schema.names
        self.path, self.key = re.sub(r"^file:/+", "/", options["path"]), options.get("key", "event_id")
        self.backlog, self.limit = int(options.get("backlog", 2000)), int(options.get("limit", 200))
        self.task_rows = int(options.get("rows_per_task", 50_000))
        self.cursor = int(options["cursor"]) if "cursor" in options else None
        self.at, self.begun = -1, False  # what this run has read up to; whether it has told its first batch

    def latest_id(self) -> int:
        """From the statistics of the log's files; only files without any are read."""
        top = -1
        for piece in self._log().get_fragments():
            for group in piece.row_groups:
                found = (group.statistics or {}).get(self.key)
                value = found["max"] if found else pc.max(piece.to_table(columns=[self.key])[self.key]).as_py()
                top = max(top, -1 if value is None else value)
        return top

    def _log(self) -> ds.Dataset:
        return ds.dataset(self.path, format="parquet", exclude_invalid_files=False)

    def initialOffset(self) -> dict:
        return {"upto": self.latest_id() if self.cursor is None else self.cursor, "first": False}

    def latestOffset(self) -> dict:
        latest = self.latest_id()
        if not self.begun:  # where the run begins, only the batch's start will tell
            self.begun = True
            return {"upto": latest, "first": True}
        return {"upto": max(self.at, min(latest, self.at + self.limit)), "first": False}

    def partitions(self, start: dict, end: dict) -> Sequence[Ids]:
        after, upto = start["upto"], end["upto"]
        self.at = upto
        if end["first"] and upto - after > self.backlog:
            after = upto
        return [Ids(k, min(k + self.task_rows, upto)) for k in range(after, upto, self.task_rows)] or [Ids(upto, upto)]

    def read(self, partition: Ids) -> Iterator[pa.RecordBatch]:
        """Files are read a few thousand rows at a time, however long their row groups are; groups whose statistics lie outside are not opened."""
        if partition.after >= partition.upto:
            return
        log = self._log()
        shape = pa.schema([log.schema.field(name) for name in self.names])
        for piece in log.get_fragments():
            groups = [g.id for g in piece.row_groups if self._meets(g, partition)]
            if not groups:
                continue
            with pq.ParquetFile(piece.path, filesystem=log.filesystem, pre_buffer=False) as file:
                known = set(file.schema_arrow.names)
                wanted = [name for name in dict.fromkeys([*self.names, self.key]) if name in known]
                for batch in file.iter_batches(BATCH, groups, wanted, use_threads=False):
                    own = pc.and_(pc.greater(batch[self.key], partition.after), pc.less_equal(batch[self.key], partition.upto))
                    kept = batch.filter(own)
                    if kept.num_rows:
                        yield pa.RecordBatch.from_arrays([kept[f.name].cast(f.type) if f.name in known else pa.nulls(kept.num_rows, f.type) for f in shape], schema=shape)

    def _meets(self, group: ds.RowGroupInfo, ids: Ids) -> bool:
        found = (group.statistics or {}).get(self.key)
        return not found or (found["max"] > ids.after and found["min"] <= ids.upto)


class EventLog(DataSource):
    """Options: path (of a Parquet log; pyarrow's file systems open it), key, cursor (where a reader without a checkpoint begins; none: at the latest),
    backlog, limit (events of a batch after the first), rows_per_task."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def streamReader(self, schema: StructType) -> LogReader:
        return LogReader(schema, dict(self.options))


def follow(spark: SparkSession, path: str, schema: StructType, **options: object) -> DataFrame:
    """The log as a stream of the schema's columns. With backlog and limit high, whole ranges of ids are read by many tasks."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the processes that plan a read need not find this package
    spark.dataSource.register(EventLog)
    return spark.readStream.format("event_log").schema(schema).options(path=path, **options).load()
