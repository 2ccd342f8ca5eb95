"""WARC archives written and read with Spark's text source, and boundary-chain verification of their records.

Every record starts with the magic line and ends with two line ends, so a text file whose line separator is
those two line ends is an archive. Read back with the magic line as the separator, large files are
split among tasks and every fragment starts where a record may start: a candidate. Magic inside a payload makes
false candidates; only those that the chain of record ends reaches from the start of the file are records."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, settle, shared_dir

MAGIC = "WARC/1.1\r\n"
BREAK = "\r\n\r\n"


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of a hexadecimal string whose length is a multiple of 5 digits."""
    group = lambda k: F.lpad(F.conv(F.substring(hexadecimal, 5 * k + 1, 5), 16, 32), 4, "0")
    digits = F.concat(*[group(k) for k in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", body: str = "html", at_least: int = 0) -> None:
    """One record a row, in files part-* of `path`. Of rows with equal bodies of at_least bytes or more, the one with the
    largest key is the response, the others are revisits of it: they keep the HTTP header (with the full length) and the digest, not the payload.

    A null body is the empty one, a null url is left out, line ends in a url are escaped, a null key never is a
    response that others refer to. Rows that repeat the largest key are all responses, those that repeat another are all revisits. Other
    columns are not read; an empty table gives files without records. Bodies shared by many rows are found by an aggregation with map-side partials."""
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(body), F.lit("")).alias("body"))
    rows = rows.withColumns({"digest": base32(F.sha1(F.col("body").cast("binary"))), "length": F.octet_length("body")})
    many = rows.filter(F.col("length") >= at_least).groupBy("digest").agg(F.max("key").alias("first"), F.count("*").alias("n"))
    many = settle(many.filter("n > 1 AND first IS NOT NULL").select("digest", "first"))
    rows = rows.join(many, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("length").cast("string"), F.lit(BREAK)
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("body")))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat_ws(
        "\r\n",
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name("key")),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name("first"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    record = F.concat(F.lit(MAGIC), header, F.lit(BREAK), block)
    rows.select(record.alias("value")).write.option("lineSep", BREAK).text(path)


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, row, value): what lies between two magic lines; row is ascending within a split.

    split and row tell places within one scan only: another scan may cut the files otherwise, so no two scans are ever joined."""
    read = spark.read.option("lineSep", MAGIC).text(path)
    return read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )


def _field(name: str, head: str = "head") -> Column:
    """A header field's value, or null."""
    found = F.regexp_extract(F.concat(F.lit("\r\n"), F.col(head), F.lit("\r\n")), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", F.trim(found))


def _parsed(fragments: DataFrame) -> DataFrame:
    """Of each fragment what its record says, if it is one: the record's bytes, the payload's facts."""
    cut = fragments.withColumn("head", F.substring_index("value", BREAK, 1))
    cut = cut.withColumn("n_head", F.octet_length("head") + len(BREAK)).withColumn("n_block", _field("Content-Length").try_cast("long"))
    cut = cut.withColumn("n_block", F.when(F.col("n_block").between(0, LONGEST), F.col("n_block")))
    raw = F.col("value").cast("binary")
    cut = cut.withColumn("n_raw", F.octet_length(raw))
    block = F.expr("substring(cast(value AS binary), cast(n_head + 1 AS int), cast(least(n_block, n_raw) AS int))")
    cut = cut.withColumn("block", block)
    http = F.substring_index(F.col("block").cast("string"), BREAK, 1)
    cut = cut.withColumn("http", http).withColumn("n_http", F.octet_length("http") + len(BREAK))
    payload = F.expr("substring(block, cast(n_http + 1 AS int))")
    return cut.select(
        *fragments.columns,
        (F.lit(len(MAGIC)) + F.col("n_head") + F.col("n_block") + len(BREAK)).alias("n_record"),
        (F.lit(len(MAGIC)) + F.col("n_raw")).alias("n_fragment"),
        _field("WARC-Type").alias("record_type"),
        F.regexp_extract(_field("WARC-Record-ID"), r"^<urn:page:(-?\d*)>$", 1).try_cast("long").alias("key"),
        F.regexp_extract(F.coalesce(_field("WARC-Refers-To"), F.lit("")), r"^<urn:page:(-?\d+)>$", 1).try_cast("long").alias("refers_to"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        _field("WARC-Target-URI").alias("url"),
        _field("Content-Length", "http").try_cast("long").alias("n_told"),
        F.octet_length(payload).cast("long").alias("n_found"),
        base32(F.sha1(payload)).alias("found_digest"),
    )


#: A told length beyond this many bytes is no length: no file is as long, and no sum of lengths and offsets overflows.
LONGEST = 1 << 53
#: Wide records are put together in runs of so many bytes of a file.
BLOCK = 1 << 26


def _chain(light: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of settled fragments of whole files: (the records that the chain reaches, the fragments of wide ones with their record's offset).

    Sums of fragment lengths, first within and then over the splits of a file, give each candidate's offset. Candidates that end
    where the next one of their split starts form runs, and a run ends in one successor: pointer jumping goes from run to run, from
    offset 0 on, its steps doubling each round. Of a reached run, the members from the point of entry on are records. Without magic in payloads
    a split is one run, so pointers are few whatever the records are."""
    split = Window.partitionBy("file", "split").orderBy("row")
    past = split.rowsBetween(Window.unboundedPreceding, -1)
    chained = (F.col("n_record") == F.col("n_fragment")) & F.lead("row").over(split).isNotNull()
    within = light.withColumns({"_in": F.coalesce(F.sum("n_fragment").over(past), F.lit(0)), "_chained": F.coalesce(chained, F.lit(False))})
    within = within.withColumn("run", F.coalesce(F.sum(F.when(F.col("_chained"), 0).otherwise(1)).over(past), F.lit(0)))
    files = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sums = light.groupBy("file", "split").agg(F.sum("n_fragment").alias("n"))
    whole = Window.partitionBy("file")
    bases = sums.withColumns({"_base": F.coalesce(F.sum("n").over(files), F.lit(0)), "file_end": F.sum("n").over(whole) - len(MAGIC)}).drop("n")
    # What precedes the first magic of a file is a fragment of its own, without magic: the offset of the next is 0 if it is empty.
    candidates = within.join(bases, ["file", "split"]).withColumn("offset", F.col("_base") + F.col("_in") - len(MAGIC)).drop("_in", "_base")
    candidates = settle(candidates.filter("offset >= 0"))
    release(light)
    place = ["file", "split", "run"]
    exits = candidates.filter("NOT _chained AND n_record IS NOT NULL").selectExpr(*place, "offset + n_record AS offset")
    entries = candidates.selectExpr("file", "offset", "split AS to_split", "run AS to_run")
    pointers = settle(exits.join(entries, ["file", "offset"]).withColumnRenamed("offset", "to_entry"))
    reached = settle(candidates.filter("offset = 0").select(*place, F.col("offset").alias("entry")))
    while not pointers.isEmpty():
        before = reached, pointers
        ahead = reached.join(pointers, place).selectExpr("file", "to_split AS split", "to_run AS run", "to_entry AS entry")
        reached = settle(reached.union(ahead))
        further = pointers.selectExpr("file", "split AS to_split", "run AS to_run", "to_split AS far_split", "to_run AS far_run", "to_entry AS far_entry")
        jumped = pointers.drop("to_entry").join(further, ["file", "to_split", "to_run"])
        pointers = settle(jumped.selectExpr(*place, "far_split AS to_split", "far_run AS to_run", "far_entry AS to_entry"))
        release(*before)
    records = candidates.join(reached, place).filter("offset >= entry").select("offset", "file_end", *[c for c in light.columns if c != "value"])
    # The fragments of a wide record lie in the blocks of the file that it touches: in each, the last start at or before a fragment owns it.
    # A record that tells of more than its file holds ends with the file.
    wide = records.filter("n_record > n_fragment").selectExpr("file", "offset AS start", "least(offset + n_record, file_end) AS stop")
    touched = wide.withColumn("block", F.explode(F.expr(f"sequence(start div {BLOCK}, (stop - 1) div {BLOCK})")))
    blocks = touched.select("file", "block").distinct()
    held = candidates.withColumn("block", F.expr(f"offset div {BLOCK}")).join(blocks, ["file", "block"])
    marks = touched.selectExpr("file", "block", f"greatest(start, block * {BLOCK}) AS offset", "start", "stop", "0 AS kind")
    held = held.select("file", "block", "offset", "value", F.lit(1).alias("kind")).unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy("file", "block").orderBy("offset", "kind").rowsBetween(Window.unboundedPreceding, 0)
    owned = held.withColumns({"start": F.last("start", True).over(order), "stop": F.last("stop", True).over(order)})
    return records, owned.filter("kind = 1 AND offset >= start AND offset < stop").select("file", "start", "offset", "value")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(key, url, record_type, payload_bytes, payload_digest, refers_to, intact) of the records of the archives in path.

    1. One scan settles light candidates (place, record length, header fields, digest of the payload). The raw text stays with those alone
       that do not end where the next candidate starts: the starts of records whose payload holds magic, and such magic itself.
    2. Boundary chains by pointer jumping (see _chain) tell records from magic in payloads.
    3. Records whose payload holds magic are put together from their fragments and parsed whole. Where such a payload holds a
       complete record, its fragment came without text: files with such records are scanned once more, with all texts, and verified by themselves.

    Whatever is joined comes from one settled scan, so a change of split sizes or a lost executor between two stages changes nothing.
    intact: the payload has the length and the digest that the record tells (for revisits, nothing to compare).
    Rows that repeat a key are records of their own, a null key is read as null. Empty files and an empty folder give no records; what follows a
    broken record in its file is not reached. A told length that is negative, no number, or beyond LONGEST is none."""
    columns = ["key", "url", "record_type", "payload_digest", "refers_to", "n_told", "n_found", "found_digest"]

    def joined(owned: DataFrame) -> DataFrame:
        parts = owned.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("all"))
        again = parts.select(F.array_join(F.transform("all", lambda x: x["value"]), MAGIC).alias("value"))
        return _parsed(again).select(*columns)

    odd = ~F.coalesce(F.col("n_record") == F.col("n_fragment"), F.lit(False))
    records, owned = _chain(settle(_parsed(_fragments(spark, path)).withColumn("value", F.when(odd, F.col("value")))))
    owned = settle(owned)
    lacking = settle(owned.filter("value IS NULL").select("file").distinct())
    if not lacking.isEmpty():
        again, more = _chain(settle(_parsed(_fragments(spark, path).join(lacking, "file", "left_semi"))))
        records = records.join(lacking, "file", "left_anti").unionByName(again)
        owned = owned.join(lacking, "file", "left_anti").unionByName(settle(more))
    whole = records.filter("n_record <= n_fragment").select(*columns).union(joined(owned))
    revisit = F.col("record_type") == "revisit"
    intact = (F.col("n_told") == F.col("n_found")) & (F.col("payload_digest") == F.col("found_digest"))
    return whole.select(
        "key",
        "url",
        "record_type",
        F.col("n_told").alias("payload_bytes"),
        "payload_digest",
        "refers_to",
        F.when(revisit, F.lit(True)).otherwise(F.coalesce(intact, F.lit(False))).alias("intact"),
    )


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives under the shared one."""
    return f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"


ORACLE = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), h AS (
    SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS x FROM p
), d AS (
    SELECT page_id, payload_bytes, x, translate(concat({groups}), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
    FROM h
), k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to, true AS intact
FROM k
""".replace("{groups}", ", ".join(f"to_base(CAST('0x' || substr(x, {5 * k + 1}, 5) AS BIGINT), 32, 4)" for k in range(8)))
