"""Line dedup by distinct-site spread: lines that many sites carry are boilerplate and go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, numbered, salts_for, settle

#: HyperLogLog sketches have 2**LOG_K registers; their relative error is near 1.04 / sqrt(2**LOG_K), or 1.6 %.
LOG_K = 12
#: A line is known by 128 bits of hash, so that among 10**12 lines no two unlike ones are taken for each other.
HASH = ["h", "g"]


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit(5), line).alias("g"))


def _spread(lines: DataFrame, min_sites: int, slack: float) -> DataFrame:
    """(h, g, n_sites, n_rows) of the lines (site, h, g) with at least min_sites distinct sites, settled; n_rows is how often a line stands anywhere."""
    sketch = lines.groupBy(*HASH).agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sketch"), F.count("*").alias("n_rows"))
    estimated = settle(sketch.select(*HASH, F.hll_sketch_estimate("sketch").alias("n_sites"), "n_rows").filter(F.col("n_sites") >= min_sites * (1 - slack)))
    sure = estimated.filter(F.col("n_sites") > min_sites * (1 + slack))
    near = estimated.filter(F.col("n_sites") <= min_sites * (1 + slack)).select(*HASH, "n_rows")
    # Each line's sites are distinct before they are counted, so a line on every page is no hot key; near the threshold a line has few sites.
    pairs = join_hot(lines, near, HASH, salts=hottest(near)).distinct()
    exact = pairs.groupBy(*HASH, "n_rows").agg(F.count("*").alias("n_sites")).filter(F.col("n_sites") >= min_sites)
    return settle(sure.unionByName(exact))


def hottest(lines: DataFrame) -> int:
    """Over how many tasks the rows of one of the lines (n_rows) are dealt."""
    return salts_for(lines.agg(F.max("n_rows")).first()[0] or 0)


def line_spread(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = 10, slack: float = 0.1) -> DataFrame:
    """(h, g, n_sites, n_rows) of the lines that at least min_sites distinct sites carry; h and g are a line's hashes (see _hash).

    A sketch of sites for each line's hash is built map-side and merged by the aggregation. Lines whose estimate is within
    `slack` (over six standard errors) of min_sites get an exact distinct count; for the others n_sites is the estimate."""
    lines = docs.select(F.col(site).alias("site"), F.explode(F.split(F.col(text), "\n")).alias("line"))
    lines = lines.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]") & F.col("site").isNotNull())
    return _spread(lines.select("site", _hash(F.col("line")).alias("x")).select("site", "x.*"), min_sites, slack)


def copied_texts(docs: DataFrame, text: str, site: str, min_sites: int, slack: float) -> DataFrame:
    """(h, g) of whole texts of several lines that at least min_sites distinct sites carry, found as lines are."""
    whole = docs.filter(F.col(site).isNotNull() & F.contains(F.col(text), F.lit("\n")))
    return _spread(whole.select(F.col(site).alias("site"), _hash(F.col(text)).alias("x")).select("site", "x.*"), min_sites, slack)


def drop_spread_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 10, slack: float = 0.1, keep_copies: bool = True
) -> DataFrame:
    """docs with boilerplate lines cut from the text, plus removed_lines (long).

    Boilerplate is a line that at least min_sites distinct sites carry: it goes wherever it stands, whatever else a text holds. With keep_copies a
    text of several lines that as many sites carry as a whole keeps its lines: it is a copied document, left to document dedup, whose every line would go.

    Lines are compared as they are; lines without a word are never boilerplate. Null texts stay null with nothing removed, rows
    with a null site count for no site but are cleaned, rows of equal text are cleaned alike, other columns
    pass through (a column named removed_lines is replaced), an empty table gives an empty result."""
    docs, name = numbered(docs.drop("removed_lines"))
    text, own_key = name[text], name[key]
    print_of = _hash(F.col(text))
    boilerplate = line_spread(docs, text, name[site], min_sites, slack)
    cleaned = docs
    if keep_copies:
        copies = copied_texts(docs, text, name[site], min_sites, slack)
        marked = docs.withColumns({"h": F.xxhash64(text), "g": F.xxhash64(F.lit(5), F.col(text))})
        cleaned = join_hot(marked, copies.select(*HASH, F.lit(True).alias("copied")), HASH, "left", salts=hottest(copies), by=own_key).filter("copied IS NULL").select(*docs.columns)
    own = cleaned.select(F.col(own_key).alias("key"), print_of.alias("p"), F.explode(F.array_distinct(F.transform(F.split(F.col(text), "\n"), _hash))).alias("x")).select("key", "p", "x.*")
    # The same lines of the same text under the same key are one row, however often the document repeats.
    hits = join_hot(own, boilerplate.select(*HASH), HASH, salts=hottest(boilerplate), by="p")
    found = hits.groupBy("key", "p").agg(F.collect_set(F.struct(*HASH)).alias("drop"))
    joined = docs.join(found, docs[own_key].eqNullSafe(F.col("key")) & (print_of == F.col("p")), "left")

    lines = F.split(F.col(text), "\n")
    rest = F.filter(lines, lambda x: ~F.array_contains("drop", _hash(x)))
    some = F.col("drop").isNotNull()
    cut = joined.withColumn("rest", F.when(some, rest))
    cut = cut.withColumn("removed_lines", F.when(some, F.size(lines) - F.size("rest")).otherwise(0).cast("long"))
    cut = cut.withColumn(text, F.when(some, F.array_join("rest", "\n")).otherwise(F.col(text)))
    return cut.select(*[F.col(c).alias(old) for old, c in name.items()], "removed_lines")


ORACLE = r"""
WITH lines AS (
    SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL
), spread AS (
    SELECT line FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT source) >= 10
), copied AS (
    SELECT text FROM documents WHERE contains(text, chr(10)) GROUP BY text HAVING count(DISTINCT source) >= 10
), counted AS (
    SELECT doc_id, count(s.line) AS cut, coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE s.line IS NULL), '') AS rest
    FROM lines l LEFT JOIN spread s ON l.line = s.line WHERE text NOT IN (SELECT text FROM copied) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN c.cut > 0 THEN c.rest ELSE d.text END AS text, CAST(coalesce(c.cut, 0) AS BIGINT) AS removed_lines
FROM documents d LEFT JOIN counted c ON d.doc_id = c.doc_id
"""
