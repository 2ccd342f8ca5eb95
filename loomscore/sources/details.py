"""Nested JSON of listings, item details, score statistics and reviews as rows; harvest files.

Fields that a schema does not name are ignored. A detail without its product is drift: such payloads give no row, and
`drifted` returns them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records, text
from ..functions.text import col

# The names of the source's fields.
SUMMARY = "struct<score: double, max: int, reviewCount: long, positiveCount: long, neutralCount: long, negativeCount: long, sentiment: string>"
NAMED = "struct<id: long, name: string>"
IMAGES = "array<struct<bucketPath: string, typeName: string>>"
LISTED = f"struct<id: long, slug: string, title: string, releaseDate: string, premiereYear: int, rating: string, criticScoreSummary: {SUMMARY}, userScore: struct<score: double>, image: struct<bucketPath: string>>"
PRODUCT = (
    "struct<id: long, slug: string, title: string, description: string, rating: string, mustPlay: boolean, premiereYear: int, releaseDate: string, "
    f"production: struct<companies: array<struct<id: long, name: string, typeName: string>>>, images: {IMAGES}, "
    "video: struct<title: string, videoTitle: string, duration: long, embedUrl: string, manifestUrl: string>, "
    f"genres: array<{NAMED}>, platforms: array<struct<id: long, name: string, slug: string, isLeadPlatform: boolean, releaseDate: string, relatedGameId: long, criticScoreSummary: {SUMMARY}>>, "
    f"gameTaxonomy: struct<franchises: array<{NAMED}>, family: {NAMED}>>"
)
COMPONENTS = f"components array<struct<meta: struct<componentName: string>, data: struct<item: {PRODUCT}>>>"
CRITIC = "struct<quote: string, score: double, url: string, date: string, author: string, publicationName: string, publicationSlug: string>"
PLAYER = "struct<id: string, quote: string, score: double, date: string, author: string, spoiler: boolean, version: int, thumbsUp: int, thumbsDown: int>"


def pick(options: Column, field: str, name: str) -> Column:
    """The first element whose field is `name`, else the first element, else null."""
    return F.coalesce(F.get(F.filter(options, lambda o: o[field] == name), F.lit(0)), F.get(options, F.lit(0)))


def image_of(images: Column, kind: str) -> Column:
    """The path of the first image of a kind that has one, else that of the first image."""
    named = F.get(F.filter(images, lambda o: (o["typeName"] == kind) & (o["bucketPath"] != "")), F.lit(0))
    return F.coalesce(named["bucketPath"], F.get(images, F.lit(0))["bucketPath"])


def score_columns(summary: Column) -> dict[str, Column]:
    """A score and its counts: counts are 0 where missing, a missing score stays null, scores are rounded to even."""
    count = lambda name: F.coalesce(summary[name], F.lit(0)).cast("long")
    return {
        "score": F.bround(summary["score"], 0).cast("int"),
        "n_reviews": count("reviewCount"),
        "n_positive": count("positiveCount"),
        "n_neutral": count("neutralCount"),
        "n_negative": count("negativeCount"),
        "sentiment": summary["sentiment"],
    }


def listing_items(pages: DataFrame, body: str = "body") -> DataFrame:
    """One row for each item of listing pages, with the page's total."""
    parsed = F.from_json(col(body), f"data struct<totalResults: long, items: array<{LISTED}>>")["data"]
    rows = pages.select(parsed["totalResults"].alias("total"), F.explode(parsed["items"]).alias("x"))
    return rows.select(
        F.col("x.slug").alias("slug"),
        F.col("x.title").alias("title"),
        F.col("x.id").alias("source_id"),
        records.lenient_date("x.releaseDate").alias("release_date"),
        F.bround("x.criticScoreSummary.score", 0).cast("int").alias("critic"),
        F.col("x.criticScoreSummary.reviewCount").alias("critic_count"),
        F.col("x.userScore.score").alias("user"),
        F.col("x.image.bucketPath").alias("cover"),
        F.coalesce("total", F.lit(0)).alias("total"),
    )


def products(payloads: DataFrame, body: str = "body") -> DataFrame:
    """payloads with `product`: the item of the component of that name, null where there is none."""
    components = F.from_json(col(body), COMPONENTS)["components"]
    own = F.get(F.filter(components, lambda c: c["meta"]["componentName"] == "product"), F.lit(0))
    # Inlined: a condition on the product would else be moved below, where every part of it parses the text anew.
    return payloads.drop("product").select("*", F.inline(F.array(F.struct(own["data"]["item"].alias("product")))))


def drifted(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Payloads without a product, or with one that has neither slug nor title."""
    return products(payloads, body).filter("product.slug IS NULL OR product.title IS NULL").drop("product")


def _sound(payloads: DataFrame, body: str) -> DataFrame:
    return products(payloads, body).filter("product.slug IS NOT NULL AND product.title IS NOT NULL")


def _item_columns(p: Column) -> dict[str, Column]:
    """A product's own fields, its first franchise and its family."""
    video = p["video"]
    return {
        "slug": p["slug"],
        "title": p["title"],
        "title_norm": text.normalize_title(p["title"]),
        "source_id": p["id"],
        "description": text.clean_body(p["description"]),
        "rating": p["rating"],
        "must_play": F.coalesce(p["mustPlay"], F.lit(False)),
        "year": p["premiereYear"],
        "release_date": records.lenient_date(p["releaseDate"]),
        "cover": image_of(p["images"], "mainImage"),
        "card": image_of(p["images"], "cardImage"),
        "video_url": F.coalesce(video["embedUrl"], video["manifestUrl"]),
        "video_title": F.coalesce(video["videoTitle"], video["title"]),
        "franchise": F.get(p["gameTaxonomy"]["franchises"], F.lit(0))["name"],
        "family_id": p["gameTaxonomy"]["family"]["id"],
    }


def detail_items(payloads: DataFrame, body: str = "body") -> DataFrame:
    """One row for each payload: the item's own fields, its first franchise and its family."""
    return _sound(payloads, body).select(*[c.alias(k) for k, c in _item_columns(F.col("product")).items()])


def detail_channels(payloads: DataFrame, body: str = "body") -> DataFrame:
    """One row for each channel of an item, with its scores. Exactly one is lead: the first so marked, else the first.

    The lead is marked in the list before it is exploded, so that no row of a channel carries all of them."""
    rows = _sound(payloads, body).select(F.col("product.slug").alias("slug"), F.col("product.platforms").alias("all"))
    marked = F.transform("all", lambda x: F.coalesce(x["isLeadPlatform"], F.lit(False)))
    lead = F.greatest(F.array_position(marked, F.lit(True)) - 1, F.lit(0)).alias("lead")
    rows = rows.select("slug", F.inline(F.array(F.struct(lead, "all")))).select("slug", "lead", F.posexplode("all").alias("position", "x"))
    made = score_columns(F.col("x.criticScoreSummary"))
    return rows.select(
        "slug",
        "position",
        F.coalesce("x.slug", text.slug("x.name")).alias("channel"),
        F.col("x.name").alias("name"),
        (F.col("position") == F.col("lead")).alias("is_lead"),
        records.lenient_date("x.releaseDate").alias("release_date"),
        *[c.alias(k) for k, c in made.items()],
    )


def detail_tags(payloads: DataFrame, body: str = "body") -> DataFrame:
    rows = _sound(payloads, body).select(F.col("product.slug").alias("slug"), F.posexplode("product.genres").alias("position", "x"))
    return rows.select("slug", "position", text.slug("x.name").alias("tag"), F.col("x.name").alias("name"))


def _role(company: Column) -> Column:
    return F.when(F.lower(company["typeName"]) == "developer", "developer").otherwise("publisher")


def detail_companies(payloads: DataFrame, body: str = "body") -> DataFrame:
    """One row for each company and role (developer, or publisher for any other) of an item, in the order of first mention."""
    rows = _sound(payloads, body).select(F.col("product.slug").alias("slug"), F.posexplode("product.production.companies").alias("position", "x"))
    rows = rows.select("slug", "position", text.slug("x.name").alias("company"), _role(F.col("x")).alias("role"), F.col("x.name").alias("name"))
    first = rows.groupBy("slug", "company", "role").agg(F.min(F.struct("position", "name")).alias("x"))
    return first.select("slug", "company", "role", "x.position", "x.name")


def change_fingerprint(payloads: DataFrame, body: str = "body") -> DataFrame:
    """payloads with slug and print, one row for each that has a product: a print over what should set off work when it changes. Times and the counts of
    user ratings move all the time and are left out.

    A payload's channels, tags and companies are sorted in its own row: it is parsed once, and nothing is shuffled or joined."""
    p = F.col("product")
    platforms, genres, companies = lists = p["platforms"], p["genres"], p["production"]["companies"]
    names = F.concat(*(F.coalesce(F.transform(x, lambda e: e["name"]), F.array().cast("array<string>")) for x in lists))
    rows = _sound(payloads, body).withColumn("_names", text.in_one(names))
    rows = rows.withColumn("_slugs", text.slugs("_names"))
    n_channels, n_tags = (F.greatest(F.size(x), F.lit(0)) for x in (platforms, genres))
    slug = lambda e, k: F.when(e["name"].isNotNull(), F.get("_slugs", k))

    def channel(e: Column, k: Column) -> Column:
        made = score_columns(e["criticScoreSummary"])
        return F.concat_ws(":", F.coalesce(e["slug"], slug(e, k)), F.coalesce(made["score"].cast("string"), F.lit("-")), made["n_reviews"].cast("string"))

    tag = lambda e, k: slug(e, k + n_channels)
    company = lambda e, k: F.concat_ws(":", _role(e), slug(e, k + n_channels + n_tags))
    said = lambda x, f: F.when(F.size(x) > 0, F.array_join(F.sort_array(f(x)), "|"))
    fields = {n: c for n, c in _item_columns(p).items() if n in ("slug", "title", "description", "cover", "video_url", "release_date", "rating", "franchise")} | {
        "channels": said(platforms, lambda x: F.transform(x, channel)),
        "tags": said(genres, lambda x: F.transform(x, tag)),
        "companies": said(companies, lambda x: F.array_distinct(F.transform(x, company))),
    }
    # Columns of their own first: the print reads each several times.
    rows = rows.select(*payloads.columns, F.struct(*[c.alias(n) for n, c in fields.items()]).alias("_own"))
    return rows.select(*payloads.columns, F.col("_own")["slug"].alias("slug"), records.fingerprint({n: F.col("_own")[n] for n in fields}).alias("print"))


def score_stats(payloads: DataFrame, key: str, body: str = "body", scale: int = 100) -> DataFrame:
    """(key, score, scale, counts, sentiment) of score statistics; the score is not rounded."""
    item = F.from_json(col(body), f"data struct<item: {SUMMARY}>")["data"]["item"]
    made = score_columns(item) | {"score": item["score"]}
    return payloads.select(key, F.coalesce(F.nullif(item["max"], F.lit(0)), F.lit(scale)).alias("scale"), *[c.alias(k) for k, c in made.items()])


def critic_reviews(pages: DataFrame, group: str, body: str = "body") -> DataFrame:
    """Critics' reviews have no id: publication, date and text are the key. Without publication and text there is no review."""
    rows = pages.select(group, F.explode(F.from_json(col(body), f"data struct<items: array<{CRITIC}>>")["data"]["items"]).alias("x"))
    publication = F.coalesce(F.nullif(F.col("x.publicationSlug"), F.lit("")), text.slug(F.coalesce("x.publicationName", F.lit(""))))
    rows = rows.select(group, "x", text.clean_body("x.quote").alias("body"), publication.alias("publication"), records.lenient_date("x.date").alias("published"))
    rows = rows.filter("publication <> '' OR body IS NOT NULL").withColumn("body_hash", text.body_hash(F.coalesce("body", F.lit(""))))
    key = F.sha2(F.concat_ws("|", "publication", F.coalesce(F.col("published").cast("string"), F.lit("")), "body_hash"), 256)
    return rows.select(
        group,
        key.alias("key"),
        "body",
        "body_hash",
        F.col("x.score").alias("score"),
        F.col("x.score").alias("score_100"),
        "published",
        F.nullif("x.author", F.lit("")).alias("author"),
        F.nullif("publication", F.lit("")).alias("publication"),
        F.length(F.coalesce("body", F.lit(""))).alias("n_chars"),
    )


def player_reviews(pages: DataFrame, group: str, body: str = "body") -> DataFrame:
    """Players' reviews go by their id, those without one by author and text. Scores out of ten also count out of a hundred."""
    rows = pages.select(group, F.explode(F.from_json(col(body), f"data struct<items: array<{PLAYER}>>")["data"]["items"]).alias("x"))
    own = F.nullif(F.col("x.id"), F.lit(""))
    rows = rows.select(group, "x", text.clean_body("x.quote").alias("body"), own.alias("id")).filter("id IS NOT NULL OR body IS NOT NULL")
    rows = rows.withColumn("body_hash", text.body_hash(F.coalesce("body", F.lit(""))))
    made = F.sha2(F.concat_ws("|", F.coalesce("x.author", F.lit("")), "body_hash"), 256)
    return rows.select(
        group,
        F.substring(F.coalesce("id", made), 1, 64).alias("key"),
        "body",
        "body_hash",
        F.col("x.score").alias("score"),
        (F.col("x.score") * 10).alias("score_100"),
        records.lenient_date("x.date").alias("published"),
        F.nullif("x.author", F.lit("")).alias("author"),
        F.coalesce("x.spoiler", F.lit(False)).alias("is_spoiler"),
        F.length(F.coalesce("body", F.lit(""))).alias("n_chars"),
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(file, body) of harvested JSON documents as text for the parsers above: one a line where every line of a file is one, else one a file.

    Files are read by lines, so one of many documents is cut among tasks; only the lines of others are put together again."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("body"))
    rows = rows.filter(F.trim("body") != "")
    parted = rows.filter(F.try_parse_json("body").isNull()).select("file").distinct()
    whole = rows.join(parted, "file", "left_semi").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("place", "body"))).alias("x"))
    whole = whole.select("file", F.array_join(F.transform("x", lambda p: p["body"]), "\n").alias("body"))
    return rows.join(parted, "file", "left_anti").select("file", "body").union(whole)


def listing_anchors(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, slug, position) of the links to items on listing pages, each slug where it comes first."""
    links = F.regexp_extract_all(col(html), F.lit(r'(?i)<a\b[^>]*\bhref="([^"]*)"'), F.lit(1))
    rows = pages.select(key, F.posexplode(links).alias("position", "link"))
    slug = F.regexp_extract(F.substring_index("link", "?", 1), r"([^/]+)/?$", 1)
    return rows.select(key, slug.alias("slug"), "position").filter("slug <> ''").groupBy(key, "slug").agg(F.min("position").alias("position"))
