"""Records out of JSON, HTML and caption text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import col


def html_title(html: Column | str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def html_links(html: Column | str) -> Column:
    """The distinct targets of the page's anchors, in order."""
    return F.array_distinct(F.regexp_extract_all(col(html), F.lit('(?i)<a [^>]*href="([^"]*)"'), F.lit(1)))


def html_meta(html: Column | str) -> Column:
    """Language, character set and the number of script blocks."""
    return F.struct(
        F.nullif(F.regexp_extract(col(html), r'(?i)<html[^>]*\slang="([^"]*)"', 1), F.lit("")).alias("lang"),
        F.nullif(F.regexp_extract(col(html), r'(?i)<meta[^>]*charset="?([^">]*)', 1), F.lit("")).alias("charset"),
        F.size(F.regexp_extract_all(col(html), F.lit(r"(?i)<script\b"), F.lit(0))).alias("n_scripts"),
    )


def first_int(x: Column | str) -> Column:
    return F.regexp_extract(F.replace(col(x), F.lit(","), F.lit("")), "([0-9]+)", 1).try_cast("long")


def first_float(x: Column | str) -> Column:
    return F.regexp_extract(F.replace(col(x), F.lit(","), F.lit("")), r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def by_preference(options: Column, field: str, names: list[str]) -> Column:
    """The first of the named options that an array of structs holds, or null."""

    def named(name: str) -> Column:
        return F.get(F.filter(options, lambda o: o[field] == name), F.lit(0))

    return F.coalesce(*map(named, names))


def caption_lines(x: Column | str) -> Column:
    """Caption text without tags, sounds in brackets, cue numbers and times; a line that extends the last kept one
    replaces it, one that ends it is dropped. The comparison is with the last kept line, so this is a fold."""
    plain = F.regexp_replace(F.regexp_replace(col(x), r"<[^>]+>", ""), r"(?i)\[[a-z ]+\]", "")
    lines = F.transform(F.split(plain, "\n"), lambda s: F.trim(s))
    lines = F.filter(lines, lambda s: (s != "") & ~s.rlike("^[0-9]+$") & ~s.contains("-->"))

    def keep(kept: Column, line: Column) -> Column:
        last = F.element_at(kept, -1)
        some = F.size(kept) > 0
        return (
            F.when(some & line.startswith(last), F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(line)))
            .when(some & last.endswith(line), kept)
            .otherwise(F.concat(kept, F.array(line)))
        )

    return F.aggregate(lines, F.array().cast("array<string>"), keep)
