"""Paged listings as a Spark data source: `spark.read.format("paged_listing")`.

A listing answers an offset with a page of items and their total number. How long its pages are is measured, not believed: the
first page is opened when a query is planned, and its length is the step. Pages are dealt out to tasks in runs. No offset at or past the total
is ever asked for, since sources answer it with an error.

`path` is a folder that `write_pages` made (a folder offset=N for each page; pyarrow's file systems open it), or an http address that takes
offset, limit, sortBy and metaScoreMin. The condition `least_score` and the limit `cap` reach the source: the address gets the condition as metaScoreMin, and
of a folder sorted by falling score a binary search finds the page after which none can hold such a score. They are options rather than
conditions that Spark pushes down, since in Spark 4.1 what one query pushes into a Python source stays there for other queries of the same DataFrame."""

from __future__ import annotations

import datetime
import json
import re
import sys
import urllib.parse
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "source_id long, slug string, title string, release_date date, score int, page_offset long, position int"
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.date32(), pa.int32(), pa.int64(), pa.int32()]
_NAMES = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]
#: Fixed value: only items with a score are asked of an address.
LEAST_SCORE = 1


@dataclass(frozen=True)
class Page:
    total: int
    items: list[dict]


def _page(body: str) -> Page:
    data = json.loads(body).get("data") or {}
    return Page(int(data.get("totalResults") or 0), data.get("items") or [])


class FilePages:
    """The pages of a folder."""

    def __init__(self, path: str):
        self.path = re.sub(r"^file:/+", "/", path)

    def open(self, offset: int) -> Page:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        for found in system.get_file_info(fs.FileSelector(f"{root}/offset={offset}", allow_not_found=True)):
            if found.is_file and found.size and not found.base_name.startswith(("_", ".")):
                with system.open_input_stream(found.path) as f:
                    return _page(f.read().decode("utf-8"))
        return Page(0, [])


class WebPages:
    """The pages of an address."""

    def __init__(self, address: str, limit: int, sort: str, least: int):
        self.address = address
        self.asked = {"limit": limit, "metaScoreMin": max(LEAST_SCORE, least), **({"sortBy": sort} if sort else {})}

    def open(self, offset: int) -> Page:
        with urllib.request.urlopen(f"{self.address}?{urllib.parse.urlencode({'offset': offset, **self.asked})}", timeout=30) as f:
            return _page(f.read().decode("utf-8"))


@dataclass
class Run(InputPartition):
    """Pages from one offset up to another."""

    start: int
    end: int


def _date(x: str | None) -> datetime.date | None:
    try:
        return datetime.date.fromisoformat((x or "")[:10])
    except ValueError:
        return None


def _score(item: dict) -> int | None:
    score = (item.get("criticScoreSummary") or {}).get("score")
    return None if score is None else round(score)


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.sort = options["path"], options.get("sort", "")
        self.limit, self.run_pages = int(options.get("limit", 24)), int(options.get("pages_per_task", 8))
        self.cap = int(options["cap"]) if "cap" in options else None
        self.max_pages = int(options["max_pages"]) if "max_pages" in options else None
        self.least = int(options["least_score"]) if "least_score" in options else None
        if self.limit < 1 or self.run_pages < 1:
            raise ValueError("a page has at least one row, a task at least one page")

    @property
    def pages(self) -> FilePages | WebPages:
        return WebPages(self.path, self.limit, self.sort, self.least or 0) if self.path.startswith("http") else FilePages(self.path)

    def partitions(self) -> Sequence[Run]:
        first = self.pages.open(0)
        step = len(first.items)
        if not step:
            return [Run(0, 0)]
        end = min(first.total, self.cap if self.cap is not None else first.total)
        if self.max_pages is not None:
            end = min(end, self.max_pages * step)
        if self.least is not None and self.sort == "-score" and not self.path.startswith("http"):
            end = min(end, step * self._pages_with(self.least, first, -(-end // step), step))
        span = step * self.run_pages
        return [Run(at, min(at + span, end)) for at in range(0, end, span)] or [Run(0, 0)]

    def _pages_with(self, least: int, first: Page, n_pages: int, step: int) -> int:
        """How many pages of falling scores begin with one of at least `least`."""
        low, high = 0, n_pages  # the pages before `low` do, those from `high` on do not
        while low < high:
            middle = (low + high) // 2
            page = first if middle == 0 else self.pages.open(middle * step)
            score = _score(page.items[0]) if page.items else None
            if score is not None and score >= least:
                low = middle + 1
            else:
                high = middle
        return low

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        at = partition.start
        while at < partition.end:
            items = self.pages.open(at).items
            if not items:
                return
            rows = [(x.get("id"), x.get("slug"), x.get("title"), _date(x.get("releaseDate")), _score(x), at, k) for k, x in enumerate(items)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)
            at += len(items)


class PagedListing(DataSource):
    """Options: path, sort (-score or another order, as the listing was made), least_score, cap (no page begins at or past so many rows),
    max_pages, pages_per_task, limit (what an address is asked for; what it gives is measured)."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ListingReader:
        return ListingReader(dict(self.options))


def read_listing(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """A listing's items (see SCHEMA), each with its page's offset and its place in the page; with least_score, those that have it."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the processes that plan a read need not find this package
    spark.dataSource.register(PagedListing)
    rows = spark.read.format("paged_listing").options(path=path, **options).load()
    return rows.filter(F.col("score") >= options["least_score"]) if "least_score" in options else rows


def write_pages(items: DataFrame, path: str, order: Sequence[Column], length: int = 24) -> None:
    """Items (source_id, slug, title, release_date, score) as a listing of pages of `length` in a folder, in the order given.

    Rows are sorted by range; their places are counted in each range and summed over the ranges, so no task holds all rows."""
    spark = items.sparkSession
    raw = f"{path}/_sorted"
    numbered = items.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    numbered.write.parquet(raw)  # the ranges are cut once
    rows = spark.read.schema(numbered.schema).parquet(raw).withColumn("_range", F.shiftright("_id", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("_range").agg(F.count("*").alias("n"))  # a row for each range
    ranges = ranges.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_id") - F.shiftleft("_range", 33)
    item = F.struct(
        F.col("source_id").alias("id"),
        "slug",
        "title",
        F.coalesce(F.col("release_date").cast("string"), F.lit("")).alias("releaseDate"),
        F.struct("score").alias("criticScoreSummary"),
    )
    total = rows.agg(F.count("*")).scalar()
    paged = rows.join(F.broadcast(ranges), "_range").select(place.alias("place"), item.alias("item"), total.alias("total"))
    paged = paged.withColumn("offset", F.floor(F.col("place") / length) * length).groupBy("offset", "total")
    pages = paged.agg(F.array_sort(F.collect_list(F.struct("place", "item"))).alias("all"))
    body = F.struct(F.struct(F.col("total").alias("totalResults"), F.transform("all", lambda x: x["item"]).alias("items")).alias("data"))
    pages.select("offset", F.to_json(body).alias("value")).write.partitionBy("offset").mode("append").text(path)
