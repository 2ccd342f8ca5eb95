"""Catalogue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import catalog, titles
from ..sources import extract
from .base import AS_OF, ITEM_CHANNELS, ITEMS, item_channels, items, query, table, work_folder


def effective(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_effective(items(spark, d))


@query(ITEMS + "SELECT item_id, title, eff_critic, eff_user, round(gap, 6) AS gap FROM eff WHERE gap >= 10 ORDER BY eff.gap DESC NULLS LAST, item_id DESC LIMIT 12")
def catalogue_query(spark, d):
    """The items on which critics and audience differ most."""
    wide = effective(spark, d).filter("gap >= 10").orderBy(F.desc_nulls_last("gap"), F.desc("item_id")).limit(12)
    return wide.select("item_id", "title", "eff_critic", "eff_user", F.round("gap", 6).alias("gap"))


@query(ITEMS + "SELECT item_id, eff_critic, round(eff_user, 6) AS eff_user, round(gap, 6) AS gap FROM eff")
def effective_scores(spark, d):
    return effective(spark, d).select("item_id", "eff_critic", F.round("eff_user", 6).alias("eff_user"), F.round("gap", 6).alias("gap"))


@query(ITEMS + "SELECT item_id, critic, critic_count, round(\"user\", 6) AS user_score, user_count, lead_channel, user_total, n_channels FROM items")
def rollup_best(spark, d):
    rows = items(spark, d)
    return rows.select("item_id", "critic", "critic_count", F.round("user", 6).alias("user_score"), "user_count", "lead_channel", "user_total", "n_channels")


_STRUCT = """
SELECT item_id, channel_id,
       CASE WHEN v IS NOT NULL THEN 'valid' WHEN "user" IS NULL THEN 'missing' WHEN user_count <= 0 THEN 'unrated' ELSE 'not_enough' END AS status,
       n AS normalized, CASE WHEN n IS NULL THEN 'none' WHEN n >= 85 THEN 'excellent' WHEN n >= 70 THEN 'good' WHEN n >= 50 THEN 'mixed' ELSE 'poor' END AS tier,
       v IS NOT NULL AND user_count < 20 AS low_sample
FROM (SELECT *, CAST(round_even(v * 10, 0) AS INT) AS n FROM (SELECT *, CASE WHEN user_count > 0 AND NOT ("user" = 0 AND user_count < 20) THEN "user" END AS v FROM ic))"""


@query(f"WITH {ITEM_CHANNELS} {_STRUCT}")
def score_struct(spark, d):
    made = item_channels(spark, d).withColumn("s", scores.score_struct("user", "user_count", 10, 20))
    return made.select("item_id", "channel_id", "s.status", "s.normalized", "s.tier", "s.low_sample")


@query(f"WITH {ITEM_CHANNELS} SELECT tier, count(*) AS n FROM ({_STRUCT}) GROUP BY tier")
def tiers(spark, d):
    return score_struct(spark, d).groupBy("tier").agg(F.count("*").alias("n"))


_SIDES = ITEMS + ", sides AS (SELECT item_id, CASE WHEN critic_count > 0 AND NOT (critic = 0 AND critic_count < 1) THEN critic END AS c, CAST(round_even(eff_user * 10, 0) AS INT) AS u FROM eff)"


def _sides(spark, d):
    critic = scores.normalized(scores.effective("critic", "critic_count", 1), 100)
    return effective(spark, d).select("item_id", critic.alias("c"), scores.normalized("eff_user", 10).alias("u"))


@query(_SIDES + """SELECT item_id, CASE WHEN c IS NULL AND u IS NULL THEN 'none' WHEN c IS NULL THEN 'player_only' WHEN u IS NULL THEN 'critic_only'
    WHEN abs(c - u) < 7 THEN 'agree' WHEN c > u THEN 'players_lower' ELSE 'players_higher' END AS kind, c - u AS delta FROM sides""")
def verdict_kind(spark, d):
    c, u = F.col("c"), F.col("u")
    return _sides(spark, d).select("item_id", scores.verdict(c, u).alias("kind"), (c - u).alias("delta"))


@query(_SIDES + """SELECT item_id, CASE WHEN c - u IS NULL THEN 'one_sided' WHEN abs(c - u) < 7 THEN 'agree' WHEN c > u THEN 'lower' ELSE 'higher' END AS note,
    CASE WHEN c - u >= 7 THEN 'warning' ELSE 'neutral' END AS tone FROM sides""")
def consensus(spark, d):
    return _sides(spark, d).withColumn("s", scores.consensus(F.col("c"), F.col("u"))).select("item_id", "s.note", "s.tone")


@query(ITEMS + """, best AS (SELECT item_id, max(critic) AS top FROM ic GROUP BY item_id)
SELECT l.item_id, l.channel_id, CASE WHEN top - l.critic >= 10 THEN top - l.critic END AS behind
FROM ic l JOIN best USING (item_id) JOIN roll USING (item_id) WHERE l.channel_id = roll.lead_channel""")
def channel_line(spark, d):
    return catalog.channel_line(item_channels(spark, d))


for _by, _column, _way in (("score", "eff_critic", "DESC"), ("user", "eff_user", "DESC"), ("date", "release_date", "DESC"), ("gap", "gap", "DESC"), ("title", "title", "ASC")):

    def _sorted(spark, d, by=_by):
        page = catalog.sorted_page(effective(spark, d), by, 0, 24)
        return page.select("item_id", "title", "eff_critic", "release_date")

    query(ITEMS + f"SELECT item_id, title, eff_critic, release_date FROM eff ORDER BY {_column} {_way} NULLS LAST, item_id DESC LIMIT 24", f"catalog_sort_{_by}")(_sorted)


@query(ITEMS + "SELECT item_id, title FROM eff WHERE eff_critic >= 50 ORDER BY eff_critic DESC NULLS LAST, item_id DESC LIMIT 10 OFFSET 20")
def catalog_page(spark, d):
    return catalog.sorted_page(catalog.band(effective(spark, d), "mixed"), "score", 20, 10).select("item_id", "title")


for _band in ("excellent", "good", "mixed", "unrated"):
    query(
        ITEMS + "SELECT item_id FROM eff WHERE " + {"excellent": "eff_critic >= 85", "good": "eff_critic >= 70", "mixed": "eff_critic >= 50", "unrated": "eff_critic IS NULL"}[_band],
        f"band_{_band}",
    )(lambda spark, d, band=_band: catalog.band(effective(spark, d), band).select("item_id"))

for _window, _where in (
    ("last30", f"release_date BETWEEN DATE '{AS_OF}' - 30 AND DATE '{AS_OF}'"),
    ("year", "year(release_date) = 2026"),
    ("earlier", "release_date IS NULL OR year(release_date) < 2026"),
):
    query(ITEMS + f"SELECT item_id, release_date FROM eff WHERE {_where}", f"released_{_window}")(
        lambda spark, d, window=_window: catalog.released(effective(spark, d), window, AS_OF, 2026).select("item_id", "release_date")
    )


def _links(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("channel_id"))


@query(ITEMS + "SELECT l_suppkey AS channel_id, count(DISTINCT l_partkey) AS n_items FROM lineitem WHERE l_partkey IN (SELECT item_id FROM eff WHERE eff_critic >= 85) GROUP BY 1")
def channel_facets(spark, d):
    return catalog.facet(_links(spark, d), catalog.band(effective(spark, d), "excellent"), "channel_id")


@query(ITEMS + """SELECT s_suppkey AS channel_id, s_name AS name, count(DISTINCT x.l_partkey) AS n_items FROM supplier
    LEFT JOIN (SELECT * FROM lineitem WHERE l_partkey IN (SELECT item_id FROM eff WHERE eff_critic >= 95)) x ON l_suppkey = s_suppkey GROUP BY ALL""")
def channel_facets_all(spark, d):
    dimension = table(spark, d, "supplier").select(F.col("s_suppkey").alias("channel_id"), F.col("s_name").alias("name"))
    return catalog.facet(_links(spark, d), effective(spark, d).filter("eff_critic >= 95"), "channel_id", dimension)


@query("SELECT p_type AS tag, count(DISTINCT p_partkey) AS n_items FROM part GROUP BY 1 ORDER BY 2 DESC, 1")
def tag_facets(spark, d):
    links = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("tag"))
    return catalog.facet(links, links, "tag").orderBy(F.desc("n_items"), "tag")


_OPEN = "eff_critic >= 70", "release_date IS NULL OR year(release_date) < 2026", "item_id IN (SELECT l_partkey FROM lineitem WHERE l_suppkey IN (1, 3, 5))", "brand IN ('Brand#13', 'Brand#5', 'Brand#21')"
_FACET = "SELECT '{0}' AS facet, CAST({1} AS VARCHAR) AS value, count(DISTINCT eff.item_id) AS n_items FROM eff {2} WHERE {3} GROUP BY ALL"


@query(ITEMS + " UNION ALL ".join((
    _FACET.format("channel", "l_suppkey", "JOIN lineitem ON l_partkey = eff.item_id", " AND ".join(f"({_OPEN[k]})" for k in (0, 1, 3))),
    _FACET.format("tag", "brand", "", " AND ".join(f"({_OPEN[k]})" for k in (0, 1, 2))),
    _FACET.format("size", "size", "", " AND ".join(f"({x})" for x in _OPEN)),
    f"SELECT 'total', NULL, count(*) FROM eff WHERE {' AND '.join(f'({x})' for x in _OPEN)}",
)))
def request_facets(spark, d):
    """All facets of one request, each without its own filter, and its total, from one scan of the items."""
    channels = _links(spark, d).groupBy("item_id").agg(F.collect_set("channel_id").alias("channels"))
    rows = effective(spark, d).join(channels, "item_id", "left")
    earlier = F.col("release_date").isNull() | (F.year("release_date") < 2026)
    filters = {
        "band": F.col("eff_critic") >= 70,
        "released": earlier,
        "channel": F.arrays_overlap("channels", F.array(*[F.lit(k).cast("long") for k in (1, 3, 5)])),
        "tag": F.col("brand").isin("Brand#13", "Brand#5", "Brand#21"),
    }
    dimensions = {"channel": F.col("channels"), "tag": F.array("brand"), "size": F.array("size")}
    return catalog.facets(rows, dimensions, filters)


@query("SELECT p_partkey AS item_id FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_suppkey IN (1, 2, 3))")
def semi_tag_filter(spark, d):
    wanted = table(spark, d, "lineitem").filter(F.col("l_suppkey").isin(1, 2, 3))
    parts = table(spark, d, "part")
    return parts.join(wanted, parts.p_partkey == wanted.l_partkey, "left_semi").select(F.col("p_partkey").alias("item_id"))


@query("SELECT p_partkey AS item_id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45)")
def anti_unreferenced(spark, d):
    used = table(spark, d, "lineitem").filter("l_quantity >= 45")
    parts = table(spark, d, "part")
    return parts.join(used, parts.p_partkey == used.l_partkey, "left_anti").select(F.col("p_partkey").alias("item_id"))


@query(ITEMS + "SELECT item_id, title FROM items WHERE contains(title_norm, 're') ORDER BY CASE WHEN starts_with(title_norm, 're') THEN 0 ELSE 1 END, critic DESC NULLS LAST, item_id LIMIT 8")
def suggest(spark, d):
    return catalog.suggest(items(spark, d), "re").select("item_id", "title")


_GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""WITH g AS (SELECT p_partkey AS item_id, lower(p_name) AS t, {_GRAMS.format(x='p_name')} AS a, {_GRAMS.format(x="'red widgit'")} AS b FROM part),
s AS (SELECT item_id, t, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE AS likeness FROM g)
SELECT item_id, round(likeness, 6) AS likeness FROM s WHERE contains(t, 'red widgit') OR likeness > 0.25""")
def trigram_search(spark, d):
    return catalog.search(items(spark, d), "red widgit").select("item_id", F.round("likeness", 6).alias("likeness"))


_TITLES = f"t AS (SELECT DISTINCT title, {_GRAMS.format(x='title')} AS grams FROM (SELECT trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages UNION SELECT p_name FROM part) WHERE title <> '')"


@query(f"""WITH {_TITLES}, n AS (SELECT DISTINCT p_name || ' ' || split_part(p_type, ' ', 1) AS needle, {_GRAMS.format(x="p_name || ' ' || split_part(p_type, ' ', 1)")} AS asked FROM part
    UNION SELECT title, grams FROM t WHERE title NOT IN (SELECT p_name FROM part))
SELECT needle, title, round(likeness, 6) AS likeness FROM (SELECT needle, title, len(list_intersect(grams, asked)) / len(list_distinct(list_concat(grams, asked)))::DOUBLE AS likeness FROM n, t WHERE len(grams) > 0) WHERE likeness > 0.25""")
def title_matches(spark, d):
    """Every needle (names of parts with a word of their type, titles of pages) against every title (of pages and parts), by one stored index."""
    pages = table(spark, d, "pages").select(extract.html_title("html").alias("title"))
    parts = table(spark, d, "part")
    index = titles.trigram_index(pages.union(parts.select("p_name")), "title").write(work_folder(spark))
    names = parts.select("p_name").distinct()
    needles = parts.select(F.concat_ws(" ", "p_name", F.substring_index("p_type", " ", 1)).alias("needle")).union(pages.join(names, F.col("title") == F.col("p_name"), "left_anti"))
    return titles.resembling(index, needles, "needle").withColumn("likeness", F.round("likeness", 6))


_RAILS = {
    "just_released": (f"release_date BETWEEN DATE '{AS_OF}' - 30 AND DATE '{AS_OF}'", "release_date", 12),
    "highest_rated": ("eff_critic >= 85 AND critic_count >= 1", "eff_critic", 12),
    "biggest_gaps": ("gap >= 10", "gap", 12),
}


def _rails():
    return {k: v for k, v in catalog.rails(AS_OF).items() if k in _RAILS}


for _name, (_where, _by, _n) in _RAILS.items():
    query(ITEMS + f"SELECT item_id, title FROM eff WHERE {_where} ORDER BY {_by} DESC NULLS LAST, item_id DESC LIMIT {_n}", f"rails_{_name}")(
        lambda spark, d, name=_name: catalog.rail(effective(spark, d), _rails()[name]).select("item_id", "title")
    )


@query(ITEMS + "SELECT item_id, title FROM eff WHERE item_id % 4 > 0 ORDER BY DATE '2020-01-01' + CAST(item_id * 7 % 300 AS INT) DESC, item_id DESC LIMIT 5")
def rails_recently_updated(spark, d):
    i = F.col("item_id")
    rows = effective(spark, d).withColumn("updated_at", F.when(i % 4 > 0, F.date_add(F.lit("2020-01-01").cast("date"), (i * 7 % 300).cast("int"))))
    return catalog.rail(rows, catalog.rails(AS_OF)["recently_updated"]).select("item_id", "title")


@query(ITEMS + f"""SELECT item_id, title, rail FROM (
    (SELECT 0 AS k, 'just_released' AS rail, item_id, title, row_number() OVER (ORDER BY release_date DESC NULLS LAST, item_id DESC) AS r FROM eff WHERE {_RAILS['just_released'][0]})
    UNION ALL (SELECT 1, 'highest_rated', item_id, title, row_number() OVER (ORDER BY eff_critic DESC NULLS LAST, item_id DESC) FROM eff WHERE {_RAILS['highest_rated'][0]})
    UNION ALL (SELECT 2, 'biggest_gaps', item_id, title, row_number() OVER (ORDER BY gap DESC NULLS LAST, item_id DESC) FROM eff WHERE {_RAILS['biggest_gaps'][0]}))
    ORDER BY k, r LIMIT 1""")
def spotlight(spark, d):
    return catalog.spotlight(effective(spark, d), _rails())


@query(ITEMS + "SELECT count(*) AS n_items, count(eff_critic) AS n_critic, count(eff_user) AS n_user, max(release_date) AS newest FROM eff")
def global_stats(spark, d):
    return effective(spark, d).agg(
        F.count("*").alias("n_items"), F.count("eff_critic").alias("n_critic"), F.count("eff_user").alias("n_user"), F.max("release_date").alias("newest")
    )


@query("SELECT count(*) AS n_covered FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) >= 25)")
def coverage_having(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").count().filter("count >= 25").agg(F.count("*").alias("n_covered"))


@query("""SELECT item_id, channel_id FROM (SELECT l_partkey AS item_id, l_suppkey AS channel_id, l_suppkey % 3 = 0 AS flag, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)
    WHERE flag OR volume >= 30 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY flag DESC, volume DESC, channel_id) <= 3""")
def channel_budget(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("channel_id")).agg(F.sum("l_quantity").alias("volume"))
    return catalog.channel_budget(rows.withColumn("is_lead", F.col("channel_id") % 3 == 0), 3, 30).select("item_id", "channel_id")


@query(ITEMS + """SELECT item_id FROM eff WHERE item_id IN (SELECT l_partkey FROM lineitem WHERE l_suppkey IN (1, 3)) AND item_id IN (SELECT p_partkey FROM part WHERE p_brand IN ('Brand#13', 'Brand#5'))""")
def tag_filter_two(spark, d):
    """Items on any of two channels and with any of two tags."""
    brands = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("tag"))
    return catalog.tagged(catalog.tagged(effective(spark, d), _links(spark, d), "channel_id", [1, 3]), brands, "tag", ["Brand#13", "Brand#5"]).select("item_id")


@query("""WITH t AS (SELECT p_partkey AS item_id, string_split(lower(p_name || ' ' || p_type), ' ') AS w FROM part)
SELECT item_id, round(len(list_intersect(list_distinct(w), ['red', 'widget', 'small'])) / 3.0, 6) AS covered,
       round(len(list_intersect(w, ['red', 'widget', 'small'])) / len(list_distinct(list_concat(w, ['red', 'widget', 'small'])))::DOUBLE, 6) AS shared FROM t""")
def token_overlap(spark, d):
    own = text.words(F.lower(F.concat_ws(" ", "p_name", "p_type")))
    asked = F.array(*map(F.lit, ("red", "widget", "small")))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("item_id"), F.round(text.coverage(asked, own), 6).alias("covered"), F.round(text.overlap(own, asked), 6).alias("shared")
    )
