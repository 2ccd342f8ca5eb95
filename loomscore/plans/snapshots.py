"""Snapshot and version queries on lineitem (snapshots: suppliers, members: parts), orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import snapshots
from .base import query, table

_MEMBERS = "m AS (SELECT l_suppkey AS snapshot_id, l_partkey AS review_id, l_orderkey * 10 + l_linenumber AS position FROM lineitem)"


def members(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("snapshot_id"), F.col("l_partkey").alias("review_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))


@query("SELECT o_custkey, o_orderstatus, o_orderkey AS snapshot_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_snapshot(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderstatus", F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("built_at"))
    return snapshots.latest(rows, ["o_custkey", "o_orderstatus"]).drop("built_at")


@query("""WITH k AS (SELECT o_custkey AS gp, o_orderdate AS content_hash, min(o_orderkey) AS known FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL)
SELECT o_orderkey AS asked, coalesce(known, o_orderkey) AS snapshot_id, known IS NULL AS created FROM orders LEFT JOIN k ON gp = o_custkey AND content_hash = o_orderdate""")
def create_or_return(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("gp"), F.col("o_orderdate").alias("content_hash"), F.col("o_orderkey").alias("snapshot_id"))
    found = snapshots.create_or_return(o.filter("snapshot_id % 2 = 0"), o.withColumn("asked", F.col("snapshot_id")), ["gp"])
    return found.select("asked", "snapshot_id", "created")


@query(f"WITH {_MEMBERS} SELECT snapshot_id, count(*) AS n, sha256(string_agg('C' || review_id, ',' ORDER BY position, 'C' || review_id)) AS refs FROM m GROUP BY 1")
def member_refs(spark, d):
    found = snapshots.member_refs(members(spark, d).withColumn("ref", F.concat(F.lit("C"), "review_id")))
    return found.select("snapshot_id", F.size("refs").cast("long").alias("n"), F.sha2(F.array_join("refs", ","), 256).alias("refs"))


@query(f"""WITH {_MEMBERS}, d AS (SELECT DISTINCT snapshot_id, review_id FROM m), p AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier)
SELECT a, b, (SELECT count(*) FROM d x JOIN d y USING (review_id) WHERE x.snapshot_id = p.a AND y.snapshot_id = p.b) AS shared FROM p""")
def snapshot_overlap(spark, d):
    pairs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    return snapshots.overlap(members(spark, d), pairs)


@query("SELECT source, CAST(least(120, floor(24000 * 3.5 * 0.75 / (avg(least(length(coalesce(text, '')), 1500)) + 60))) AS INT) AS budget FROM documents GROUP BY 1")
def review_budget(spark, d):
    return snapshots.review_budget(table(spark, d, "documents"), "source", "text", 24_000, 120)


@query("""SELECT conv_id, sha256(string_agg('[T' || turn || '] ' || CASE WHEN turn % 2 = 0 THEN '(' || turn || ') ' ELSE '' END || coalesce(text, ''), chr(10) ORDER BY turn)) AS corpus FROM conversations GROUP BY 1""")
def corpus_text(spark, d):
    rows = table(spark, d, "conversations")
    turns = rows.select("conv_id", F.col("turn").alias("position"), F.concat(F.lit("T"), "turn").alias("ref"), F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("score"), "text")
    return snapshots.corpus_text(turns, "conv_id").withColumn("corpus", F.sha2("corpus", 256))


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS gap_id, CAST(l_quantity AS INT) AS n, CASE WHEN l_suppkey % 2 = 0 THEN 5 ELSE 20 END AS threshold, l_partkey % 17 = 0 AS same_input,
    CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'failed' ELSE 'fresh' END AS status, l_partkey % 7 > 0 AS same_recipe, CAST(l_quantity AS INT) - l_partkey % 13 AS overlap, CASE WHEN l_suppkey % 3 > 0 THEN l_partkey % 100 END AS score_then, l_partkey % 100 + l_suppkey % 5 AS score_now, l_shipdate AS generated_at FROM lineitem),
f AS (SELECT *, greatest(0, n - overlap) AS fresh FROM r)
SELECT gap_id, CASE WHEN n < threshold THEN 'below_threshold' WHEN same_input THEN 'identical_input' WHEN status IS NULL THEN 'first' WHEN status = 'failed' THEN 'retry_after_failure' WHEN NOT same_recipe THEN 'recipe_changed' WHEN fresh >= 10 THEN 'new_reviews'
    WHEN n > 0 AND fresh >= 0.2 * n THEN 'new_ratio' WHEN abs(score_now - score_then) >= 3 THEN 'score_moved' WHEN epoch(TIMESTAMP '1997-01-01') - epoch(generated_at) > 90 * 86400 AND fresh > 0 THEN 'staleness' ELSE 'not_enough_change' END AS reason FROM f""")
def regeneration(spark, d):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    n = F.col("l_quantity").cast("int")
    rows = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("gap_id"),
        n.alias("n_reviews"),
        F.when(supp % 2 == 0, 5).otherwise(20).alias("threshold"),
        (part % 17 == 0).alias("same_input"),
        F.when(part % 5 == 0, None).when(part % 5 == 1, "failed").otherwise("fresh").alias("status"),
        (part % 7 > 0).alias("same_recipe"),
        (n - part % 13).alias("overlap"),
        F.when(supp % 3 > 0, part % 100).alias("score_then"),
        (part % 100 + supp % 5).alias("score_now"),
        F.col("l_shipdate").alias("generated_at"),
    )
    return snapshots.decide(rows, "1997-01-01").select("gap_id", "reason")


@query("""WITH h AS (SELECT o_custkey AS gp, CAST(o_orderkey AS VARCHAR) AS fp, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 AS cur FROM orders WHERE o_orderkey % 2 = 0),
n AS (SELECT o_custkey AS gp, CAST(o_orderkey AS VARCHAR) AS fp, CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'fresh' END AS status FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 4 = 0),
f AS (SELECT n.* FROM n LEFT JOIN h ON h.gp = n.gp AND h.fp = n.fp WHERE h.fp IS NULL), t AS (SELECT gp, max(version) AS top FROM h GROUP BY 1),
v AS (SELECT f.*, coalesce(top, 0) + row_number() OVER (PARTITION BY f.gp ORDER BY fp) AS version FROM f LEFT JOIN t ON t.gp = f.gp), l AS (SELECT gp, max(version) AS cur FROM v WHERE status = 'fresh' GROUP BY 1)
SELECT h.gp, fp, version, h.cur AND l.cur IS NULL AS is_current FROM h LEFT JOIN l ON l.gp = h.gp UNION ALL SELECT v.gp, fp, version, coalesce(version = l.cur, false) FROM v LEFT JOIN l ON l.gp = v.gp""")
def save_versions(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("gp"), F.col("o_orderkey").cast("string").alias("fingerprint"), "o_orderkey")
    order = Window.partitionBy("gp").orderBy("o_orderkey")
    last = F.row_number().over(Window.partitionBy("gp").orderBy(F.desc("o_orderkey"))) == 1
    old = o.filter("o_orderkey % 2 = 0").select("gp", "fingerprint", F.lit("fresh").alias("status"), F.row_number().over(order).cast("long").alias("version"), last.alias("is_current"))
    made = o.filter("o_orderkey % 2 = 1 OR o_orderkey % 4 = 0").select("gp", "fingerprint", F.when(F.col("o_orderkey") % 3 == 0, "failed").otherwise("fresh").alias("status"))
    made = made.union(made)
    return snapshots.save_versions(old, made, ["gp"]).select("gp", F.col("fingerprint").alias("fp"), "version", "is_current")


@query("SELECT s_suppkey AS snapshot_id FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey % 997 = 0) AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey % 1009 = 0)")
def unused_snapshots(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("snapshot_id"))
    return snapshots.unused(table(spark, d, "supplier").select(F.col("s_suppkey").alias("snapshot_id")), rows.filter("l_orderkey % 997 = 0"), rows.filter("l_orderkey % 1009 = 0"))


@query("""WITH r AS (SELECT p_partkey AS gap_id, CASE WHEN p_size % 11 > 0 THEN p_size + 40 END AS critic, p_partkey % 100 AS player, p_size AS n_critic, CASE WHEN p_partkey % 6 = 0 THEN ' ' ELSE 'why' END AS said FROM part),
c AS (SELECT p_partkey AS gap_id, count(DISTINCT l_suppkey) FILTER (WHERE l_suppkey % 2 = 0) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1)
SELECT gap_id, CASE WHEN critic IS NULL THEN 'no_valid_scores' WHEN abs(critic - player) < 7 THEN 'small_gap' WHEN n_critic < 5 THEN 'few_reviews' WHEN trim(said) = '' OR n < 3 THEN 'unsupported' ELSE 'explained' END AS verdict FROM r JOIN c USING (gap_id)""")
def gap_gate(spark, d):
    size, key = F.col("p_size").cast("int"), F.col("p_partkey")
    refs = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("gap_id")).agg(F.collect_list("l_suppkey").alias("refs"))
    rows = table(spark, d, "part").select(
        key.alias("gap_id"), F.when(size % 11 > 0, size + 40).alias("critic"), (key % 100).alias("player"), size.alias("n_critic"), F.lit(99).alias("n_player"), F.when(key % 6 == 0, " ").otherwise("why").alias("explanation")
    )
    known = table(spark, d, "lineitem").filter("l_suppkey % 2 = 0").select(F.col("l_partkey").alias("gap_id"), F.col("l_suppkey").alias("ref"))
    return snapshots.gap_gate(rows.join(refs, "gap_id", "left"), known).select("gap_id", "verdict")


@query("""WITH c AS (SELECT l_orderkey, max(l_linenumber) AS chosen FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l.l_orderkey, l_linenumber, CASE WHEN chosen IS NULL THEN l_linenumber = 1 ELSE l_linenumber = chosen END AS selected FROM lineitem l LEFT JOIN c ON c.l_orderkey = l.l_orderkey""")
def exclusive_flag(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") == 1).alias("selected"), "l_returnflag")
    chosen = rows.filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("l_linenumber"))
    return snapshots.exclusive(rows.drop("l_returnflag"), chosen, "l_orderkey", "l_linenumber", "selected")


@query("""WITH a AS (SELECT conv_id, turn, role, CASE WHEN turn % 4 = 3 THEN NULL ELSE text END AS text FROM conversations), u AS (SELECT conv_id, min((turn, role, text)) FILTER (WHERE length(trim(coalesce(text, ''), ' ')) >= 40) AS x FROM a GROUP BY 1)
SELECT a.conv_id, any_value(x[3]) AS text, any_value(x[2]) AS source, list(CASE WHEN text IS NULL THEN 'unavailable' WHEN length(trim(text, ' ')) >= 40 THEN 'ok' ELSE 'too_short' END ORDER BY turn, role) AS states FROM a JOIN u ON u.conv_id = a.conv_id GROUP BY a.conv_id""")
def first_usable(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("seq"), F.col("role").alias("source"), F.when(F.col("turn") % 4 != 3, F.col("text")).alias("text"))
    found = snapshots.first_usable(turns, "conv_id", 40)
    return found.select("conv_id", "text", "source", F.transform("attempts", lambda a: a["state"]).alias("states"))


@query("""SELECT p_partkey AS item_id, CASE WHEN p_size % 7 = 0 THEN 'skipped_low_interest' WHEN p_size % 6 = 0 THEN 'discover' WHEN p_size % 5 = 0 THEN 'transcript' WHEN length(p_name) < 12 THEN 'transcript_too_short' WHEN p_size % 4 = 0 THEN 'summarise' WHEN p_size % 3 = 0 THEN 'done' ELSE 'retry_summary' END AS stage FROM part""")
def video_chain(spark, d):
    size = F.col("p_size").cast("int")
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.when(size % 7 == 0, "low_interest").alias("interest"),
        F.when(size % 6 != 0, size).alias("video_id"),
        F.when(size % 5 != 0, F.col("p_name")).alias("transcript"),
        F.lit(12).alias("least_chars"),
        F.when(size % 4 == 0, None).when(size % 3 == 0, "fresh").otherwise("failed").alias("summary_status"),
    )
    return snapshots.video_chain(rows).select("item_id", "stage")


@query("SELECT l_partkey AS gp, min(l_shipmode) AS reason, 'skipped' AS status, false AS is_current FROM (SELECT l_partkey, l_shipinstruct AS l_shipmode FROM (SELECT l_partkey, CASE WHEN l_quantity < 25 THEN 'few' ELSE 'late' END AS l_shipinstruct FROM lineitem WHERE l_returnflag = 'R')) WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) GROUP BY 1")
def skip_records(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("gp"), "l_returnflag", "l_quantity", F.when(F.col("l_quantity") < 25, "few").otherwise("late").alias("reason"))
    return snapshots.skip_records(rows.filter("l_quantity = 50"), rows.filter("l_returnflag = 'R'"), ["gp"])


@query("SELECT l_returnflag AS validation, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1996-06-01' GROUP BY 1")
def claim_outcomes(spark, d):
    claims = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("summary_id"), F.col("l_returnflag").alias("validation"))
    made = table(spark, d, "orders").select(F.col("o_orderkey").alias("summary_id"), F.col("o_orderdate").alias("generated_at"))
    return snapshots.claim_outcomes(claims, made, "1996-06-01")
