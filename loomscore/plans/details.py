"""Queries of the nested JSON, sitemap and page parsers. The payloads are made of the test tables, and the SQL reads those tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import details, markup, paged, xmlmap
from .base import ITEM_CHANNELS, item_channels, query, table, work_folder

_SLUG = "'item-' || p_partkey"
_SOUND = "p_partkey % 23 <> 0"


def payloads(spark: SparkSession, d: str) -> DataFrame:
    """(body) for each part: a detail document; every 23rd has no product (drift)."""
    channel = F.struct(
        F.concat(F.lit("Shop "), "channel_id").alias("name"),
        (F.col("channel_id") % 3 == 0).alias("isLeadPlatform"),
        F.lit("").alias("releaseDate"),
        F.struct(F.col("critic").alias("score"), F.col("critic_count").alias("reviewCount"), F.expr("critic_count div 2").alias("positiveCount")).alias("criticScoreSummary"),
    )
    own = item_channels(spark, d).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("channel_id", channel.alias("x")))).alias("channels"))
    rows = table(spark, d, "part").join(own, F.col("p_partkey") == F.col("item_id"), "left")
    words = F.split("p_type", " ")
    company = lambda name, kind: F.struct(name.alias("name"), F.lit(kind).alias("typeName"))
    item = F.struct(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("item-"), "p_partkey").alias("slug"),
        F.col("p_name").alias("title"),
        F.concat(F.lit(" <b>"), "p_name", F.lit("</b>\r\n\r\n\r\n\r\nsize "), "p_size", F.lit("  ")).alias("description"),
        F.lit(2000).alias("premiereYear"),
        F.when(F.col("p_size") % 2 == 0, F.lit("2001-02-03")).otherwise("").alias("releaseDate"),
        (F.col("p_size") % 5 == 0).alias("mustPlay"),
        F.struct(F.array(company(F.col("p_brand"), "Developer"), company(F.col("p_brand"), "developer"), company(F.element_at(words, 1), "Publisher")).alias("companies")).alias("production"),
        F.array(F.struct(F.lit("a.jpg").alias("bucketPath"), F.lit("other").alias("typeName")), F.struct(F.concat(F.lit("m"), "p_size", F.lit(".jpg")).alias("bucketPath"), F.lit("mainImage").alias("typeName"))).alias("images"),
        F.transform(words, lambda w: F.struct(w.alias("name"))).alias("genres"),
        F.coalesce(F.transform("channels", lambda c: c["x"]), F.array()).alias("platforms"),
        F.struct(F.array(F.struct(F.col("p_brand").alias("name"))).alias("franchises"), F.struct(F.col("p_size").cast("long").alias("id")).alias("family")).alias("gameTaxonomy"),
        F.lit("never read").alias("unknownField"),
    )
    name = F.when(F.col("p_partkey") % 23 == 0, "other").otherwise("product")
    component = F.to_json(F.struct(F.struct(name.alias("componentName")).alias("meta"), F.struct(item.alias("item")).alias("data")))
    body = F.concat(F.lit('{"components":[{"meta":{"componentName":"first"},"data":{}},'), component, F.lit("]}"))
    return rows.select(body.alias("body"))


@query(f"""SELECT {_SLUG} AS slug, p_name AS title, p_partkey AS source_id, p_name || chr(10) || chr(10) || 'size ' || p_size AS description, p_size % 5 = 0 AS must_play,
    CASE WHEN p_size % 2 = 0 THEN DATE '2001-02-03' END AS release_date, 'm' || p_size || '.jpg' AS cover, 'a.jpg' AS card, p_brand AS franchise, CAST(p_size AS BIGINT) AS family_id FROM part WHERE {_SOUND}""")
def detail_items(spark, d):
    rows = details.detail_items(payloads(spark, d))
    return rows.select("slug", "title", "source_id", "description", "must_play", "release_date", "cover", "card", "franchise", "family_id")


@query(f"""WITH {ITEM_CHANNELS}, x AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY channel_id) - 1 AS position FROM ic JOIN part ON p_partkey = item_id WHERE {_SOUND})
SELECT {_SLUG} AS slug, CAST(position AS INT) AS position, 'shop-' || channel_id AS channel, position = coalesce(min(CASE WHEN is_lead THEN position END) OVER (PARTITION BY item_id), 0) AS is_lead, critic AS score, n_reviews, n_reviews // 2 AS n_positive
FROM (SELECT *, CAST(critic_count AS BIGINT) AS n_reviews FROM x)""")
def detail_channels(spark, d):
    rows = details.detail_channels(payloads(spark, d))
    return rows.select("slug", "position", "channel", "is_lead", "score", "n_reviews", "n_positive")


@query(f"""SELECT {_SLUG} AS slug, lower(regexp_replace(unnest(string_split(p_type, ' ')), '[^A-Za-z0-9]+', '-', 'g')) AS tag FROM part WHERE {_SOUND}""")
def detail_tags(spark, d):
    return details.detail_tags(payloads(spark, d)).select("slug", "tag")


@query(f"""SELECT {_SLUG} AS slug, lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '-', 'g')) AS company, 'developer' AS role, 0 AS position FROM part WHERE {_SOUND}
UNION ALL SELECT {_SLUG}, lower(string_split(p_type, ' ')[1]), 'publisher', 2 FROM part WHERE {_SOUND}""")
def detail_companies(spark, d):
    return details.detail_companies(payloads(spark, d)).select("slug", "company", "role", "position")


@query(f"""SELECT {_SLUG} AS slug, p_name AS title, p_partkey % 2 = 0 AS by_line FROM part WHERE {_SOUND}""")
def harvest_files(spark, d):
    """Harvested files: half of the documents a line each, half spread over the lines of files of their own kind."""
    path, bodies = work_folder(spark), payloads(spark, d)
    even = F.regexp_extract("body", "item-([0-9]+)", 1).cast("long") % 2 == 0
    bodies.filter(even).write.text(f"{path}/lines")
    wide = F.regexp_replace(F.concat(F.lit("[\n"), F.array_join(F.collect_list("body"), ",\n"), F.lit("\n]")), '"components":', '"components":\n')
    bodies.filter(~even).groupBy((F.crc32(F.col("body").cast("binary")) % 50).alias("file")).agg(wide.alias("value")).write.partitionBy("file").text(f"{path}/whole")
    one = details.read_payloads(spark, f"{path}/lines").select("body", F.lit(True).alias("by_line"))
    listed = details.read_payloads(spark, f"{path}/whole").select(F.explode(F.from_json("body", "array<string>")).alias("body"), F.lit(False).alias("by_line"))
    found = details.products(one.union(listed)).filter("product.slug IS NOT NULL")
    return found.select("product.slug", "product.title", "by_line")


@query("SELECT count(*) FILTER (WHERE p_partkey % 23 = 0) AS n FROM part")
def drifted_payloads(spark, d):
    return details.drifted(payloads(spark, d)).agg(F.count("*").alias("n"))


@query(f"""SELECT {_SLUG} AS slug, p_size % 7 = 0 AS moved FROM part WHERE {_SOUND}""")
def change_fingerprint(spark, d):
    """Whether a detail's fingerprint moves when its title does, and only then: the counts of user ratings move for all."""
    seventh = F.regexp_extract("body", r"size ([0-9]+) ", 1).cast("int") % 7 == 0
    titled = F.replace("body", F.lit('"title":"'), F.lit('"title":"New '))
    changed = F.when(seventh, titled).otherwise(F.replace("body", F.lit('"unknownField":"never'), F.lit('"unknownField":"ever')))
    before = details.change_fingerprint(payloads(spark, d).withColumn("changed", changed)).select("changed", F.col("print").alias("before"))
    return details.change_fingerprint(before, "changed").select("slug", (F.col("print") != F.col("before")).alias("moved"))


@query("""SELECT 'item-' || p_partkey AS slug, p_name AS title, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(round_even(p_size * 1.5, 0) AS INT) END AS critic, p_size / 10.0::DOUBLE AS "user", 'c.jpg' AS cover FROM part""")
def listing_items(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size").cast("int")
    item = F.struct(
        F.concat(F.lit("item-"), "p_partkey").alias("slug"),
        F.col("p_name").alias("title"),
        F.struct(F.when(size % 3 != 0, size * F.lit(1.5)).alias("score")).alias("criticScoreSummary"),
        F.struct((size / F.lit(10.0)).alias("score")).alias("userScore"),
        F.struct(F.lit("c.jpg").alias("bucketPath")).alias("image"),
    )
    pages = p.groupBy((F.col("p_partkey") % 500).alias("page")).agg(F.collect_list(item).alias("items"))
    body = F.to_json(F.struct(F.struct(F.size("items").alias("totalResults"), "items").alias("data")))
    return details.listing_items(pages.select(body.alias("body"))).select("slug", "title", "critic", "user", "cover")


@query("""SELECT p_partkey AS item_id, CASE WHEN p_size % 3 <> 0 THEN p_size / 4.0::DOUBLE END AS score, CASE WHEN p_size % 2 = 0 THEN 10 ELSE 100 END AS scale, CAST(p_size AS BIGINT) AS n_reviews, CAST(0 AS BIGINT) AS n_negative, 'mixed' AS sentiment FROM part""")
def score_stats(spark, d):
    size = F.col("p_size").cast("int")
    item = F.struct(F.when(size % 3 != 0, size / F.lit(4.0)).alias("score"), F.when(size % 2 == 0, 10).alias("max"), size.alias("reviewCount"), F.lit("mixed").alias("sentiment"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.to_json(F.struct(F.struct(item.alias("item")).alias("data"))).alias("body"))
    return details.score_stats(rows, "item_id").select("item_id", "score", "scale", "n_reviews", "n_negative", "sentiment")


_CLEAN = (
    f"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '{text.CONTROL}', '', 'g'), "
    r"'<[^>]{1,200}>', ' ', 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), '')"
)
_BODY_HASH = r"sha256(lower(trim(regexp_replace(coalesce(body, ''), '\s+', ' ', 'g'))))"


def _reviews(spark: SparkSession, d: str, item) -> DataFrame:
    body = F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("data")))
    return table(spark, d, "documents").select("doc_id", body.alias("body"))


@query(f"SELECT doc_id, {_CLEAN} AS body FROM documents")
def clean_body(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_body("text").alias("body"))


@query(f"""WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{text.CONTROL}', ' ', 'g'), '{text.PROMPT_ARTIFACT}', ' ', 'g'), '{text.TAG}', ' ', 'g'), '\\s+', ' ', 'g'), ' ') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 300 THEN regexp_replace(substr(t, 1, 300), ' [^ ]*$', '') || '…' ELSE t END AS said FROM c""")
def prompt_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.for_prompt("text", 300).alias("said"))


@query(f"""WITH c AS (SELECT doc_id, {_CLEAN} AS body, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'paper-' || doc_id % 9 END AS publication, CASE WHEN doc_id % 3 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 300 AS INT) END AS published, doc_id % 101 AS score FROM documents)
SELECT doc_id, sha256(publication || '|' || coalesce(CAST(published AS VARCHAR), '') || '|' || {_BODY_HASH}) AS key, published, CAST(score AS DOUBLE) AS score, CAST(length(coalesce(body, '')) AS INT) AS n_chars FROM c WHERE publication <> '' OR body IS NOT NULL""")
def critic_reviews(spark, d):
    i = F.col("doc_id")
    item = F.struct(
        F.col("text").alias("quote"),
        (i % 101).alias("score"),
        F.when(i % 3 == 0, "").otherwise(F.date_add(F.lit("2024-01-01").cast("date"), (i % 300).cast("int")).cast("string")).alias("date"),
        F.when(i % 2 == 0, "").otherwise(F.concat(F.lit("paper-"), i % 9)).alias("publicationSlug"),
        F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("Paper "), i % 9)).alias("publicationName"),
    )
    fixed = item.withField("publicationSlug", F.when(i % 4 == 0, "").otherwise(item["publicationSlug"]))
    return details.critic_reviews(_reviews(spark, d, fixed), "doc_id").select("doc_id", "key", "published", "score", "n_chars")


@query(f"""WITH c AS (SELECT doc_id, {_CLEAN} AS body, CASE WHEN doc_id % 4 <> 0 THEN 'r' || doc_id END AS id, 'a' || doc_id % 7 AS author FROM documents)
SELECT doc_id, CASE WHEN id IS NOT NULL THEN id ELSE sha256(author || '|' || {_BODY_HASH}) END AS key, CAST(doc_id % 11 * 10 AS DOUBLE) AS score_100, doc_id % 5 = 0 AS is_spoiler FROM c WHERE id IS NOT NULL OR body IS NOT NULL""")
def player_reviews(spark, d):
    i = F.col("doc_id")
    item = F.struct(
        F.when(i % 4 != 0, F.concat(F.lit("r"), i)).alias("id"),
        F.col("text").alias("quote"),
        (i % 11).alias("score"),
        F.concat(F.lit("a"), i % 7).alias("author"),
        F.when(i % 5 == 0, True).alias("spoiler"),
    )
    return details.player_reviews(_reviews(spark, d, item), "doc_id").select("doc_id", "key", "score_100", "is_spoiler")


def _shards(spark: SparkSession, d: str) -> DataFrame:
    """(address, body) of shards of a hundredth of the places each, given twice: once plain, once as CDATA with a query string. Names have a prefix, slugs an
    ampersand, images have places of their own, places of other kinds have no slug."""
    own = F.concat(F.lit("https://x.example/"), F.when(F.col("p_size") % 4 == 0, "news").otherwise("game"), F.lit("/"))
    image = F.lit("<image:image><image:loc>https://x.example/game/cover/</image:loc></image:image>")
    plain = F.concat(F.lit("<s:url><s:loc>\n"), own, F.lit("item&amp;"), "p_partkey", F.lit("/</s:loc>"), image, F.lit("</s:url>"))
    quoted = F.concat(F.lit("<s:url><s:loc><![CDATA["), own, F.lit("item&"), "p_partkey", F.lit("?ref=a/b/ ]]></s:loc></s:url>"))
    shards = table(spark, d, "part").groupBy((F.col("p_partkey") % 100).alias("k")).agg(F.array_join(F.collect_list(F.concat(plain, quoted)), "").alias("all"))
    opening = F.lit('<?xml version="1.0"?><s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://x.example/image">')
    return shards.select(F.concat(F.lit("shard&"), "k").alias("address"), F.concat(opening, "all", F.lit("</s:urlset>")).alias("body"))


@query("SELECT DISTINCT 'item&' || p_partkey AS slug FROM part WHERE p_size % 4 <> 0")
def sitemap_slugs(spark, d):
    return xmlmap.sitemap_slugs(_shards(spark, d))


@query("SELECT DISTINCT 'shard&' || p_partkey % 100 AS shard, 'item&' || p_partkey AS slug FROM part WHERE p_size % 4 <> 0 AND p_partkey % 100 % 3 = 0")
def sitemap_index(spark, d):
    """Places by way of an index that names every third shard, some of them twice, and one that is not there."""
    shards = _shards(spark, d)
    named = shards.filter(F.regexp_extract("address", "([0-9]+)$", 1).cast("int") % 3 == 0).select(F.replace("address", F.lit("&"), F.lit("&amp;")).alias("a"))
    entry = F.concat(F.lit("<sitemap><loc> "), "a", F.lit("</loc><lastmod>2024-01-01</lastmod></sitemap><sitemap><loc>"), "a", F.lit("</loc></sitemap>"))
    index = named.agg(F.array_join(F.collect_list(entry), "").alias("all"))
    body = F.concat(F.lit('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>nowhere</loc></sitemap>'), "all", F.lit("</sitemapindex>"))
    return xmlmap.indexed_slugs(index.select(body.alias("body")), shards)


@query("""WITH l AS (SELECT page_id, regexp_extract_all(html, '(?i)<a [^>]*href="([^"]*)"', 1) AS all_links FROM pages),
u AS (SELECT page_id, unnest(all_links) AS link, unnest(range(len(all_links))) AS position FROM l),
s AS (SELECT page_id, regexp_extract(string_split(link, '?')[1], '([^/]+)/?$', 1) AS slug, position FROM u)
SELECT page_id, slug, CAST(min(position) AS INT) AS position FROM s WHERE slug <> '' GROUP BY ALL""")
def listing_anchors(spark, d):
    return details.listing_anchors(table(spark, d, "pages"), "page_id")


def _marked_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of nested, void and unclosed elements, with a JSON-LD list and a block that is no JSON."""
    score = F.format_number(F.col("page_id") % 100 / F.lit(10.0), 1)
    block = F.to_json(F.array(*[F.struct(F.lit(kind).alias("@type"), F.col("url").alias("name"), F.lit("2022-02-25").alias("datePublished")) for kind in ("Other", "VideoGame")]))
    html = F.concat(
        F.lit('<html><head><meta property="OG:url" content="'), "url", F.lit('"><script type="application/ld+json">not { json</script><script type="application/ld+json">'), block,
        F.lit('</script></head><body><div class="x" data-testid="outer"><div data-testid="score"><span> '), score, F.lit('</span><br></div> of <b data-testid="all">10</b></i>'
        '</div><ul><li data-testid="first">one<li data-testid="second">two<b> and <i>more</ul><p data-testid="last">&amp; '), "url"
    )
    return table(spark, d, "pages").select("page_id", html.alias("html"))


@query("""SELECT page_id, unnest(['outer', 'score', 'all', 'first', 'second', 'last']) AS testid, unnest(['div', 'div', 'b', 'li', 'li', 'p']) AS tag,
    unnest([s || ' of 10', s, '10', 'one', 'two and more', '& ' || url]) AS said FROM (SELECT page_id, url, printf('%.1f', page_id % 100 / 10.0::DOUBLE) AS s FROM pages)""")
def page_elements(spark, d):
    found = markup.page_elements(_marked_pages(spark, d), "page_id").filter("testid IS NOT NULL")
    return found.select("page_id", "testid", "tag", F.col("text").alias("said"))


@query("SELECT page_id, 'VideoGame' AS kind, url AS name, '2022-02-25' AS published, page_id % 100 / 10.0::DOUBLE AS score, url AS meta_url FROM pages")
def page_items(spark, d):
    """What a page says of its item: its JSON-LD, the score in its header, its meta elements."""
    found = markup.page_elements(_marked_pages(spark, d), "page_id")
    score = found.filter("testid = 'score'").select("page_id", markup.testid_score("text").alias("score"))
    meta = markup.meta_tags(found, "page_id").filter("name = 'og:url'").select("page_id", F.col("content").alias("meta_url"))
    return markup.found_items(found, "page_id").select("page_id", "kind", "name", "published").join(score, "page_id").join(meta, "page_id")


@query(r"""SELECT page_id, CAST(len(regexp_extract_all(html, '<a ')) AS BIGINT) AS n_links, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS n_entries, len(regexp_extract(html, '<script>([^<]*)', 1)) > 0 AS scripted,
    trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS heading FROM pages""")
def page_outline(spark, d):
    """Every element of the pages as they are."""
    found = markup.page_elements(table(spark, d, "pages"), "page_id", every=True)
    return found.groupBy("page_id").agg(
        F.count_if(F.col("tag") == "a").alias("n_links"),
        F.count_if(F.col("tag") == "li").alias("n_entries"),
        F.max((F.col("tag") == "script") & (F.col("raw") != "")).alias("scripted"),
        F.max(F.when(F.col("tag") == "h1", F.col("text"))).alias("heading"),
    )


_LISTED = "listed AS (SELECT p_partkey AS source_id, 'item-' || p_partkey AS slug, p_name AS title, CASE WHEN p_partkey % 7 > 0 THEN p_size * 2 END AS score, row_number() OVER (ORDER BY CASE WHEN p_partkey % 7 > 0 THEN p_size END DESC NULLS LAST, p_partkey) - 1 AS place FROM part)"


def _listing(spark: SparkSession, d: str) -> str:
    """The parts as a listing of pages of 40, by falling score; some have none."""
    path, score = work_folder(spark), F.when(F.col("p_partkey") % 7 > 0, F.col("p_size") * 2).cast("int")
    items = table(spark, d, "part").select(F.col("p_partkey").alias("source_id"), F.concat(F.lit("item-"), "p_partkey").alias("slug"), F.col("p_name").alias("title"), F.lit(None).cast("date").alias("release_date"), score.alias("score"))
    paged.write_pages(items, path, [F.desc_nulls_last("score"), F.col("source_id")], 40)
    return path


@query(f"WITH {_LISTED} SELECT source_id, slug, title, CAST(score AS INT) AS score, CAST(place // 40 * 40 AS BIGINT) AS page_offset, CAST(place % 40 AS INT) AS position FROM listed")
def paged_listing(spark, d):
    return paged.read_listing(spark, _listing(spark, d)).drop("release_date")


@query(f"WITH {_LISTED} SELECT source_id, slug, CAST(score AS INT) AS score FROM listed WHERE score >= 70")
def paged_listing_best(spark, d):
    """Only pages that can hold such scores are opened."""
    return paged.read_listing(spark, _listing(spark, d), sort="-score", least_score=70).select("source_id", "slug", "score")
