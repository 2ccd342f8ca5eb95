"""Queries of items with their children, pages, summaries and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, detail, merge, snapshots
from .base import ITEMS, item_channels, items, query, table
from .catalogue import effective


@query("""SELECT c_custkey, count(o_orderkey) AS n, coalesce(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderdate, o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def item_children(spark, d):
    own = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    listed = detail.children(own, "c_custkey", "orders", ["o_orderdate", "o_orderkey"], "o_orderkey", "o_orderstatus")
    rows = detail.with_children(table(spark, d, "customer").select("c_custkey"), "c_custkey", orders=listed)
    said = F.transform("orders", lambda o: F.concat(o["o_orderkey"], F.lit(":"), o["o_orderstatus"]))
    return rows.select("c_custkey", F.size("orders").cast("long").alias("n"), F.array_join(said, ",").alias("orders"))


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN p1.p_partkey END, p2.p_partkey) AS item_id FROM orders LEFT JOIN part p1 ON p1.p_partkey = o_custkey AND o_orderkey % 3 > 0 LEFT JOIN part p2 ON 'item-' || p2.p_partkey = 'item-' || o_orderkey % 300""")
def resolve_ids(spark, d):
    known = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_partkey").alias("source_id"), F.concat(F.lit("item-"), "p_partkey").alias("slug"))
    k = F.col("o_orderkey")
    asked = table(spark, d, "orders").select("o_orderkey", F.when(k % 3 > 0, F.col("o_custkey")).alias("source_id"), F.concat(F.lit("item-"), k % 300).alias("slug"))
    return detail.resolve(asked, known).select("o_orderkey", "item_id")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey % 1009 = 0)")
def keyed_rows(spark, d):
    asked = table(spark, d, "lineitem").filter("l_orderkey % 1009 = 0").select(F.col("l_suppkey").alias("s_suppkey"))
    return detail.keyed(table(spark, d, "supplier").select("s_suppkey", "s_name"), asked, ["s_suppkey"])


@query("SELECT l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey = 7 ORDER BY l_returnflag = 'R' DESC, l_linenumber")
def children_in_order(spark, d):
    rows = table(spark, d, "lineitem").withColumn("lead", F.col("l_returnflag") == "R")
    return detail.in_order(rows, "l_orderkey", 7, "lead", "l_linenumber").select("l_linenumber", "l_partkey", "l_suppkey")


@query(ITEMS + "SELECT item_id, n AS total, n > 30 AS has_more FROM (SELECT *, count(*) OVER () AS n FROM eff WHERE eff_critic >= 50) ORDER BY eff_critic DESC NULLS LAST, item_id DESC LIMIT 10 OFFSET 20")
def page_with_total(spark, d):
    rows = catalog.band(effective(spark, d), "mixed")
    return detail.page(rows, [F.desc_nulls_last("eff_critic"), F.desc("item_id")], 20, 10).select("item_id", "total", "has_more")


@query("""SELECT doc_id, count(*) OVER () AS total FROM documents WHERE source = 'src0' ORDER BY CASE WHEN doc_id % 5 > 0 THEN doc_id % 40 END DESC NULLS LAST, doc_id DESC LIMIT 6""")
def newest_reviews(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", "source", i.alias("review_id"), F.when(i % 5 > 0, i % 40).alias("published"))
    return detail.newest_reviews(rows, "source", "src0", 0, 6).select("doc_id", "total")


_CLAIMS = """c AS (SELECT l_orderkey AS summary_id, l_linenumber * 1000000 + l_partkey * 1000 + l_suppkey AS position, CASE WHEN l_shipdate >= TIMESTAMP '1995-06-01' THEN 'positive' ELSE 'negative' END AS side, CASE l_returnflag WHEN 'R' THEN 'rejected' ELSE 'accepted' END AS validation FROM lineitem)"""


def claims(spark, d):
    key = F.col("l_linenumber") * 1_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("summary_id"),
        key.alias("position"),
        F.when(F.col("l_shipdate") >= F.lit("1995-06-01").cast("timestamp"), "positive").otherwise("negative").alias("side"),
        F.when(F.col("l_returnflag") == "R", "rejected").otherwise("accepted").alias("validation"),
        key.cast("string").alias("claim"),
        F.lit("a").alias("aspect"),
        F.array(F.lit("C00")).alias("refs"),
    )


@query(f"""WITH {_CLAIMS}, s AS (SELECT o_orderkey AS summary_id, o_orderkey % 3 AS n_reviews FROM orders),
a AS (SELECT summary_id, string_agg(position, ',' ORDER BY position) FILTER (WHERE side = 'positive' AND validation = 'accepted') AS p, string_agg(position, ',' ORDER BY position) FILTER (WHERE side = 'negative' AND validation = 'accepted') AS n,
    count(*) FILTER (WHERE side = 'negative' AND validation = 'accepted') AS nn, count(*) FILTER (WHERE validation = 'accepted') / count(*)::DOUBLE AS rate FROM c GROUP BY 1)
SELECT summary_id, coalesce(p, '') AS positive, coalesce(n, '') AS negative, round(coalesce(rate, 1.0), 6) AS rate, CASE WHEN p IS NULL THEN CASE WHEN n_reviews = 0 AND coalesce(nn, 0) > 0 THEN 'only_complaints' ELSE 'no_repeated_praise' END END AS positive_note,
    CASE WHEN n IS NULL THEN CASE WHEN n_reviews > 0 THEN 'only_praise' ELSE 'no_repeated_complaint' END END AS negative_note FROM s LEFT JOIN a USING (summary_id)""")
def summary_rows(spark, d):
    summaries = table(spark, d, "orders").select(F.col("o_orderkey").alias("summary_id"), (F.col("o_orderkey") % 3).alias("n_reviews"))
    said = lambda side: F.coalesce(F.array_join(F.transform(side, lambda c: c["claim"]), ","), F.lit("")).alias(side)
    rows = detail.summary_rows(summaries, claims(spark, d))
    return rows.select("summary_id", said("positive"), said("negative"), F.round("rate", 6).alias("rate"), "positive_note", "negative_note")


@query("""SELECT l_partkey AS item_id, arg_min(l_orderkey * 10 + l_linenumber, (CASE WHEN l_suppkey = lead THEN 0 ELSE 1 END, l_orderkey * 10 + l_linenumber)) AS summary_id
    FROM lineitem JOIN (SELECT l_partkey AS k, max(l_suppkey) AS lead FROM lineitem GROUP BY 1) ON k = l_partkey WHERE l_returnflag = 'A' AND l_quantity >= 10 GROUP BY 1""")
def preferred_summary(spark, d):
    rows = table(spark, d, "lineitem").withColumnsRenamed({"l_partkey": "item_id", "l_suppkey": "channel_id"})
    leads = rows.groupBy("item_id").agg(F.max("channel_id").alias("lead_channel"))
    made = rows.select(
        "item_id", "channel_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("summary_id"), F.when(F.col("l_returnflag") == "A", "critic").otherwise("player").alias("audience"),
        F.when(F.col("l_quantity") >= 10, "fresh").otherwise("failed").alias("status"),
    )
    return detail.preferred(made, leads, "critic")


@query("""SELECT p_partkey AS item_id, CASE WHEN p_size % 3 > 0 THEN list_transform(range(p_size % 5), lambda i: 'p' || i)[1:3] ELSE [] END AS strengths, CASE WHEN p_size % 2 = 0 THEN ['n1', 'n2'] ELSE ['m'] END AS watch_outs FROM part WHERE p_size % 5 > 0""")
def signal_chips(spark, d):
    """Strengths and watch-outs out of two summaries; without criticism from critics that of the players counts."""
    size = F.col("p_size").cast("int")
    ups = F.transform(F.sequence(F.lit(0), size % 5 - 1), lambda i: F.concat(F.lit("p"), i))
    none = F.array().cast("array<string>")
    critic = F.struct(F.when(size % 3 > 0, ups).otherwise(none).alias("positive"), F.when(size % 2 == 0, F.array(*map(F.lit, ("n1", "n2", "n3")))).otherwise(none).alias("negative"))
    player = F.struct(none.alias("positive"), F.array(F.lit("m")).alias("negative"))
    told = table(spark, d, "part").filter("p_size % 5 > 0").select(F.col("p_partkey").alias("item_id"), critic.alias("critic"), player.alias("player"))
    return detail.signals(told)


@query(ITEMS + """, ch AS (SELECT item_id, string_agg(channel_id, ',' ORDER BY NOT is_lead, channel_id) AS channels, max(critic) FILTER (WHERE critic_count > 0) AS best, count(*) FILTER (WHERE critic IS NOT NULL) AS valid FROM ic GROUP BY 1)
SELECT item_id, coalesce(channels, '') AS channels, best, coalesce(valid = 0, false) AS pending, CAST(CASE WHEN critic_count > 0 THEN critic END AS INT) AS critic FROM items LEFT JOIN ch USING (item_id)""")
def item_detail(spark, d):
    tags = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.explode(F.split("p_type", " ")).alias("tag"))
    near = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("other_id"), F.col("l_linenumber").alias("rank"), F.lit(0.5).alias("similarity"))
    rows = detail.detail(items(spark, d), item_channels(spark, d), tags, near)
    said = F.array_join(F.transform("channels", lambda c: c["channel_id"].cast("string")), ",")
    return rows.select("item_id", said.alias("channels"), F.col("best_channel_score").alias("best"), "pending", F.col("critic_score.normalized").alias("critic"))


@query("""WITH l AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) AS k FROM orders) SELECT o_custkey, o_orderstatus, o_orderkey FROM l WHERE k = 1""")
def last_wins(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    return merge.last_wins(rows, ["o_custkey", "o_orderstatus"], "o_orderkey")


@query("SELECT o_custkey, o_orderkey, coalesce(top, 0) + 1 AS version FROM orders LEFT JOIN (SELECT o_custkey AS k, max(o_orderkey % 100) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON k = o_custkey WHERE o_orderstatus <> 'F'")
def version_numbers(spark, d):
    """The version that a customer's next order would have: one more than the largest of the finished ones."""
    o = table(spark, d, "orders")
    history = o.filter("o_orderstatus = 'F'").select("o_custkey", (F.col("o_orderkey") % 100).alias("version"))
    return merge.next_versions(history, o.filter("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey"), "o_custkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey AS part FROM lineitem WHERE l_orderkey % 2 = 1 UNION ALL SELECT o_orderkey, 0, o_custkey FROM orders WHERE o_orderkey % 2 = 0")
def replace_groups(spark, d):
    """Lines of the even orders replaced by one line each."""
    old = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"))
    new = table(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.col("o_custkey").alias("part"))
    return merge.replace_groups(old, new, ["l_orderkey"], new.select("l_orderkey"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name || ' new' ELSE n_name END AS n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation
UNION ALL SELECT n_nationkey + 100, n_name || ' new', 99 FROM nation WHERE n_nationkey % 10 = 0""")
def reference_upserts(spark, d):
    """Reference rows: a known one takes the new name and nothing else, an unknown one comes in whole."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))
    fresh = n.select("n_nationkey", F.concat("n_name", F.lit(" new")).alias("n_name"), F.lit(99).cast("long").alias("n_regionkey"))
    delta = fresh.filter("n_nationkey % 2 = 0").union(fresh.filter("n_nationkey % 10 = 0").withColumn("n_nationkey", F.col("n_nationkey") + 100))
    return merge.upsert(n, delta, ["n_nationkey"], ["n_name"])


@query("""WITH o AS (SELECT o_custkey AS item_id, string_agg(o_orderkey, ',' ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS old, string_agg(o_orderkey, ',' ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS new FROM orders GROUP BY 1)
SELECT item_id, coalesce(new, old) AS attempts FROM o WHERE coalesce(new, old) IS NOT NULL""")
def transcript_upsert(spark, d):
    """Arrays of attempts: what is stored for an item is replaced as a whole where there is news of it."""

    def attempts(status):
        rows = table(spark, d, "orders").filter(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("item_id"))
        return rows.agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("attempts"))

    rows = merge.upsert(attempts("F"), attempts("O"), ["item_id"], ["attempts"])
    return rows.select("item_id", F.array_join(F.transform("attempts", lambda a: a["o_orderkey"].cast("string")), ",").alias("attempts"))


@query("""WITH k AS (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS x FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL), m AS (SELECT o_custkey, o_orderstatus, max(o_orderkey) AS x FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL)
SELECT m.o_custkey, m.o_orderstatus, coalesce(k.x, m.x) AS x, k.x IS NULL AS created FROM m LEFT JOIN k ON k.o_custkey = m.o_custkey AND k.o_orderstatus = m.o_orderstatus""")
def gap_save(spark, d):
    o = table(spark, d, "orders")
    by = ["o_custkey", "o_orderstatus"]
    known = o.filter("o_orderkey % 3 = 0").groupBy(*by).agg(F.min("o_orderkey").alias("x"))
    made = o.filter("o_orderkey % 2 = 0").groupBy(*by).agg(F.max("o_orderkey").alias("x"))
    return snapshots.save_once(known, made, by)


@query("""WITH t AS (SELECT l_partkey, l_suppkey, max(l_quantity) AS score, bool_or(l_returnflag = 'R') AS rejected FROM lineitem WHERE l_quantity < 25 GROUP BY ALL), n AS (SELECT l_partkey, l_suppkey, max(l_quantity) AS score FROM lineitem WHERE l_quantity >= 25 GROUP BY ALL)
SELECT coalesce(t.l_partkey, n.l_partkey) AS l_partkey, coalesce(t.l_suppkey, n.l_suppkey) AS l_suppkey, coalesce(n.score, t.score) AS score, coalesce(rejected, false) AS rejected FROM t FULL JOIN n ON t.l_partkey = n.l_partkey AND t.l_suppkey = n.l_suppkey""")
def candidate_upsert(spark, d):
    """Candidates found again take the new score and stay rejected if they were; those not found again stay."""
    rows = table(spark, d, "lineitem")
    by = ["l_partkey", "l_suppkey"]
    known = rows.filter("l_quantity < 25").groupBy(*by).agg(F.max("l_quantity").alias("score"), F.bool_or(F.col("l_returnflag") == "R").alias("rejected"))
    found = rows.filter("l_quantity >= 25").groupBy(*by).agg(F.max("l_quantity").alias("score")).withColumn("rejected", F.lit(False))
    return merge.upsert(known, found, by, ["score"])
