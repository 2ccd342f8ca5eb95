"""Queries of the scalar functions for records, on documents, events, orders, part, nation and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records
from .base import query, table

_KIND = "CASE WHEN {0} IS NULL THEN 'z' ELSE 's' || length({0}) || ':' || {0} END"


@query(f"""SELECT doc_id, sha256('{{' || 'chars=' || coalesce('n' || n_chars, 'z') || ',half=' || coalesce('n' || CASE WHEN n_chars % 2 = 0 THEN CAST(n_chars // 2 AS VARCHAR) ELSE CAST(n_chars / 2.0 AS VARCHAR) END, 'z')
    || ',lang=' || {_KIND.format('lang')} || ',long=' || CASE WHEN n_chars > 500 THEN 'btrue' ELSE 'bfalse' END || ',source=' || {_KIND.format('source')} || '}}') AS print FROM (SELECT * REPLACE (CAST(n_chars AS BIGINT) AS n_chars) FROM documents)""")
def fingerprint(spark, d):
    fields = {"source": F.col("source"), "lang": F.col("lang"), "chars": F.col("n_chars"), "half": F.col("n_chars") / F.lit(2.0), "long": F.col("n_chars") > 500}
    return table(spark, d, "documents").select("doc_id", records.fingerprint(fields).alias("print"))


@query("""SELECT doc_id, sha256(doc_id || '|' || lang || '|' || source || '|v2') AS recipe FROM documents""")
def recipe_fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", records.recipe("doc_id", "lang", "source", F.lit("v2")).alias("recipe"))


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'purchase', 'view') THEN event_type ELSE 'other' END AS label,
    coalesce(CASE event_type WHEN 'click' THEN 'a click' WHEN 'error' THEN 'a failure' END, event_type) AS said FROM events""")
def known_labels(spark, d):
    wording = {"click": "a click", "error": "a failure"}
    return table(spark, d, "events").select("event_id", records.known_label("event_type", ["click", "purchase", "view"]).alias("label"), records.labelled("event_type", wording).alias("said"))


@query("""SELECT item_id, CASE WHEN n > 0 THEN 'kept' ELSE 'none' END AS kept FROM (SELECT p_partkey AS item_id, (CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END) AS n FROM part)""")
def known_map_keys(spark, d):
    """Of maps with one key each, those keys that are labels."""
    made = F.create_map(F.concat(F.lit("k"), F.col("p_size") % 3), F.lit("v"))
    kept = records.known_keys(made, ["k0", "k9"])
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.when(F.size(kept) > 0, "kept").otherwise("none").alias("kept"))


PRICES = {"click": (0.5, 1.5), "purchase": (2.5, 10.0)}


@query("""SELECT event_type, round(sum(CASE event_type WHEN 'click' THEN (i * 0.5::DOUBLE + o * 1.5::DOUBLE) / 1e6 WHEN 'purchase' THEN (i * 2.5::DOUBLE + o * 10.0::DOUBLE) / 1e6 ELSE 0.0 END), 6) AS dollars, CAST(sum(i + o) AS BIGINT) AS tokens
    FROM (SELECT event_type, CAST(user_id % 1000 * 40 AS BIGINT) AS i, CAST(event_id % 500 AS BIGINT) AS o FROM events) GROUP BY 1""")
def token_cost(spark, d):
    rows = table(spark, d, "events").select("event_type", (F.col("user_id") % 1000 * 40).alias("i"), (F.col("event_id") % 500).alias("o"))
    price = records.cost("event_type", "i", "o", PRICES)
    return rows.groupBy("event_type").agg(F.round(F.sum(price), 6).alias("dollars"), F.sum(F.col("i") + F.col("o")).cast("long").alias("tokens"))


@query("SELECT o_orderkey, least(900.0::DOUBLE, 5.0::DOUBLE * pow(2.0::DOUBLE, greatest(0, o_orderkey % 12 - 1))) AS ceiling FROM orders")
def retry_backoff(spark, d):
    return table(spark, d, "orders").select("o_orderkey", records.backoff_ceiling(F.col("o_orderkey") % 12, 5.0, 900.0).alias("ceiling"))


_CUT = " ".join(f"CASE WHEN contains(w, '{m}') THEN length(w) - strpos(reverse(w), '{m[::-1]}') - {len(m)} + 2 ELSE 0 END," for m in (". ", "! ", "? ", ".", "!", "?"))[:-1]


@query(f"""SELECT doc_id, CASE WHEN length(t) > 400 AND e - 1 > 200 THEN trim(substr(w, 1, e)) ELSE t END AS said
    FROM (SELECT *, greatest({_CUT}) AS e FROM (SELECT doc_id, trim(text, ' ') AS t, substr(trim(text, ' '), 1, 401) AS w FROM documents))""")
def sentence_trim(spark, d):
    return table(spark, d, "documents").select("doc_id", records.trim_to_sentence("text", 400).alias("said"))


@query(r"""SELECT page_id, NOT starts_with(ltrim(html, ' '), '#EXTM3U') AND coalesce(list_sum(list_transform(regexp_extract_all(html, 'https?://\S+'), lambda u: length(u))), 0) <= 0.3 * length(html) AS speech FROM pages""")
def subtitle_check(spark, d):
    return table(spark, d, "pages").select("page_id", records.looks_like_subtitles("html").alias("speech"))


@query("""SELECT conv_id, string_agg(text, ' ' ORDER BY turn, role, text) FILTER (WHERE trim(text, ' ') <> '') AS said FROM conversations GROUP BY conv_id""")
def json3_captions(spark, d):
    """Conversations written as caption files, an event for each turn, and read back."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("utf8")))).alias("turns"))
    body = F.to_json(F.struct(F.transform("turns", lambda t: F.struct(F.array(F.struct(t["utf8"].alias("utf8"))).alias("segs"))).alias("events")))
    return turns.select("conv_id", F.nullif(records.json3_text(body), F.lit("")).alias("said"))


@query("""SELECT o_orderkey, CASE WHEN n < 0 THEN '-' ELSE '' END || regexp_replace(CAST(abs(n) AS VARCHAR), '(\\d)(\\d\\d\\d)$', '\\1 \\2') AS thousands, CASE WHEN n >= 1000 THEN round_even(n / 1000.0, 0)::BIGINT || 'K' ELSE CAST(n AS VARCHAR) END AS compact,
    CASE WHEN n = 0 THEN '—' WHEN n >= 3600 THEN printf('%d:%02d:%02d', n // 3600, n % 3600 // 60, n % 60) ELSE printf('%d:%02d', n // 60, n % 60) END AS clock FROM (SELECT o_orderkey, CAST(o_orderkey * 37 % 90000 AS BIGINT) AS n FROM orders)""")
def display_forms(spark, d):
    n = F.col("o_orderkey") * 37 % 90000
    return table(spark, d, "orders").select("o_orderkey", records.thousands(n).alias("thousands"), records.compact(n).alias("compact"), records.clock(n).alias("clock"))


@query("""SELECT p_partkey AS item_id, TRY_CAST(CASE WHEN p_size % 4 = 0 THEN p_name ELSE ' ' || p_size || ' ' END AS BIGINT) AS n,
    CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN DATE '2024-02-28' + CAST(p_size AS INT) END AS day, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN TIMESTAMP '2024-02-28 10:00:00' END AS at FROM part""")
def lenient_parse(spark, d):
    """Numbers, dates and times as they come from outside: some are names, empty or no date at all."""
    size = F.col("p_size").cast("int")
    number = F.when(size % 4 == 0, F.col("p_name")).otherwise(F.concat(F.lit(" "), size, F.lit(" ")))
    day = F.when(size % 3 == 0, "").when(size % 3 == 1, F.date_add(F.lit("2024-02-28").cast("date"), size).cast("string")).otherwise("no date")
    at = F.when(size % 3 == 0, "").when(size % 3 == 1, "2024-02-28T10:00:00Z").otherwise("soon")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("item_id"), records.lenient_long(number).alias("n"), records.lenient_date(day).alias("day"), records.lenient_timestamp(at).cast("timestamp_ntz").alias("at")
    )


@query("""SELECT event_id, '***' AS token, CAST(user_id AS VARCHAR) AS user FROM events""")
def redacted_maps(spark, d):
    made = F.create_map(F.lit("api_token"), F.col("props"), F.lit("user"), F.col("user_id").cast("string"))
    clean = records.redact_map(made)
    return table(spark, d, "events").select("event_id", clean["api_token"].alias("token"), clean["user"].alias("user"))


@query("""SELECT event_id, '{"user":' || user_id || ',"inner":[{"Auth-Key":"***","n":' || event_id % 7 || '}],"password":"***"}' AS said FROM events""")
def redacted_json(spark, d):
    inner = F.array(F.struct(F.col("event_type").alias("Auth-Key"), (F.col("event_id") % 7).alias("n")))
    body = F.to_json(F.struct(F.col("user_id").alias("user"), inner.alias("inner"), F.lit("x").alias("password")))
    return table(spark, d, "events").select("event_id", records.redact_json(body).alias("said"))


@query("""SELECT n_nationkey, CASE WHEN n_name = 'CANADA' THEN 'CAN' WHEN contains(n_name, ' ') THEN upper(substr(array_to_string(list_transform(list_filter(string_split(n_name, ' '), lambda w: w <> ''), lambda w: w[1]), ''), 1, 4)) ELSE upper(substr(n_name, 1, 4)) END AS code,
    upper(array_to_string(list_transform(list_filter(string_split(regexp_replace(n_name, '[^A-Za-z0-9]', ' ', 'g'), ' '), lambda w: w <> '')[1:2], lambda w: w[1]), '')) AS initials FROM nation""")
def badge_codes(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", records.badge_code("n_name", "n_name", {"CANADA": "CAN"}).alias("code"), records.initials("n_name").alias("initials"))
