"""Sitemaps as rows, through Spark's XML functions: an index names shards, a shard names places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col

_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "true"}
_PLACE = "array<struct<loc: string, lastmod: string>>"
#: Fixed value: how an item's address ends.
SLUG = r"/game/([^/]+)/?$"


def _places(body: Column | str) -> Column:
    """The places (loc, lastmod) of a document, of an index or of a shard; null for a document that is neither."""
    parsed = F.from_xml(col(body), f"sitemap {_PLACE}, url {_PLACE}", _OPTIONS)
    return F.concat(F.coalesce(parsed["sitemap"], F.array()), F.coalesce(parsed["url"], F.array()))


def sitemap_places(documents: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, position, loc, lastmod) of the places of sitemap documents, in order.

    CDATA and entities are read as XML has them, prefixes of names are ignored, empty places left out; a document that is no XML gives no rows, and
    so does a null one."""
    rows = documents.select(key, F.posexplode(_places(body)).alias("position", "x"))
    loc = F.trim(F.regexp_replace("x.loc", r"^\s+|\s+$", ""))
    return rows.select(key, "position", loc.alias("loc"), F.col("x.lastmod").alias("lastmod")).filter("loc <> ''")


def slug_of(loc: Column | str) -> Column:
    """The slug of an item's place, without its query; null for a place of another kind."""
    return F.nullif(F.regexp_extract(F.substring_index(col(loc), "?", 1), SLUG, 1), F.lit(""))


def sitemap_slugs(shards: DataFrame, body: str = "body") -> DataFrame:
    """The distinct item slugs of shards."""
    places = sitemap_places(shards.select(F.lit(None).cast("string").alias("_key"), F.col(body).alias("body")), "_key")
    return places.select(slug_of("loc").alias("slug")).filter("slug IS NOT NULL").distinct()


def indexed_slugs(indexes: DataFrame, shards: DataFrame, address: str = "address", body: str = "body") -> DataFrame:
    """(shard, slug) of the shards that an index names: indexes (body), shards (address, body). A shard named twice counts once."""
    named = sitemap_places(indexes.select(F.lit(None).cast("string").alias("_key"), F.col(body).alias("body")), "_key").select(F.col("loc").alias("shard")).distinct()
    own = shards.select(F.col(address).alias("shard"), F.col(body).alias("body")).join(named, "shard", "left_semi")
    return sitemap_places(own, "shard").select("shard", slug_of("loc").alias("slug")).filter("slug IS NOT NULL").distinct()


def read_shard_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, loc) of shard files, however large: Spark cuts them between their `url` elements, so one file is read by many tasks."""
    rows = spark.read.format("xml").options(rowTag="url", **_OPTIONS).schema("loc string").load(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("loc", r"^\s+|\s+$", "").alias("loc")).filter("loc <> ''")
