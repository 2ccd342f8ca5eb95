"""Scalars for records from outside: lenient parsing, canonical prints, labels, costs, display forms, redaction."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import col

# Words that make a key a secret's name, what a secret's name may hold, and what stands in place of the secret.
SECRET_MARKERS = ("_key", "_token", "_password", "_secret", "authorization", "cookie")
SECRET_WORDS = "key token password passwd secret authorization auth cookie apikey".split()
REDACTED = "***"


def lenient_long(x: Column | str) -> Column:
    """A whole number, or null for anything else."""
    return F.trim(col(x).cast("string")).try_cast("long")


def lenient_timestamp(x: Column | str) -> Column:
    """An ISO 8601 time, or null."""
    return F.try_to_timestamp(F.nullif(F.trim(col(x)), F.lit("")))


def lenient_date(x: Column | str) -> Column:
    """A date; the empty string is none, and neither is what cannot be read."""
    return F.nullif(F.trim(col(x)), F.lit("")).try_cast("date")


def canonical(x: Column | str) -> Column:
    """A value with its kind, so that no two unlike values read alike: null, text with its length, 1 and 1.0 as one number."""
    x = col(x)
    kind, said = F.typeof(x), x.cast("string")
    number = said.try_cast("double")
    whole = (number == F.floor(number)) & (F.abs(number) < 9e15)
    binary = F.when(whole, number.try_cast("long").cast("string")).otherwise(said)
    decimal = F.when(said.contains("."), F.regexp_replace(said, r"\.?0+$", "")).otherwise(said)
    text = F.concat(F.lit("s"), F.length(said).cast("string"), F.lit(":"), said)
    return (
        F.when(x.isNull(), "z")
        .when(kind.isin("double", "float"), F.concat(F.lit("n"), binary))
        .when(kind.startswith("decimal"), F.concat(F.lit("n"), decimal))
        .when(kind.isin("tinyint", "smallint", "int", "bigint"), F.concat(F.lit("n"), said))
        .when(kind == "boolean", F.concat(F.lit("b"), said))
        .otherwise(text)
    )


def fingerprint(fields: Mapping[str, Column | str]) -> Column:
    """sha256 over the fields in the order of their names; see canonical for what counts as equal."""
    pairs = [F.concat(F.lit(f"{name}="), canonical(fields[name])) for name in sorted(fields)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")), 256)


def recipe(*parts: Column | str) -> Column:
    """sha256 of the parts joined by |; a part that is null makes the recipe null rather than drop out."""
    said = [col(p).cast("string") for p in parts]
    joined = said[0]
    for p in said[1:]:
        joined = F.concat(joined, F.lit("|"), p)
    return F.sha2(joined, 256)


def known_label(x: Column | str, labels: Sequence[str], other: str = "other") -> Column:
    """One of the labels, or `other`."""
    return F.when(F.lower(F.trim(col(x))).isin(*labels), F.lower(F.trim(col(x)))).otherwise(other)


def known_keys(x: Column | str, labels: Sequence[str]) -> Column:
    """A map without the keys that are no label."""
    return F.map_filter(col(x), lambda k, _: k.isin(*labels))


def labelled(x: Column | str, wording: Mapping[str, str]) -> Column:
    """The wording of a label, or the label as it came."""
    table = F.create_map(*[F.lit(v) for pair in wording.items() for v in pair])
    return F.coalesce(table[col(x)], col(x))


def cost(model: Column | str, tokens_in: Column | str, tokens_out: Column | str, prices: Mapping[str, tuple[float, float]]) -> Column:
    """Dollars of a call at prices per million tokens in and out; a model without a price costs 0."""
    out = F.lit(0.0)
    for name, (a, b) in prices.items():
        out = F.when(col(model) == name, (col(tokens_in) * a + col(tokens_out) * b) / 1e6).otherwise(out)
    return out


def backoff_ceiling(attempt: Column | str, base: float, most: float) -> Column:
    """The longest wait before a retry: doubling from base, at most `most` seconds (jitter takes a part of it)."""
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), F.greatest(F.lit(0), col(attempt) - 1)))


def trim_to_sentence(x: Column | str, budget: int) -> Column:
    """The text up to the last sentence that ends within the budget, if that keeps over half of it; else the text."""
    text = F.trim(col(x))
    window = F.substring(text, 1, budget + 1)
    ends = [F.length(window) - F.locate(mark[::-1], F.reverse(window)) - len(mark) + 2 for mark in (". ", "! ", "? ", ".", "!", "?")]
    found = [F.when(F.contains(window, F.lit(mark)), at).otherwise(0) for mark, at in zip((". ", "! ", "? ", ".", "!", "?"), ends, strict=True)]
    end = F.greatest(*found)  # from 1; 0: none
    cut = F.trim(F.substring(window, F.lit(1), end))
    return F.when((F.length(text) > budget) & (end - 1 > budget // 2), cut).otherwise(text)


def looks_like_subtitles(x: Column | str) -> Column:
    """Whether a body is speech rather than a playlist or a list of addresses (over 30 % of its characters)."""
    urls = F.regexp_extract_all(col(x), F.lit(r"https?://\S+"), F.lit(0))
    weight = F.aggregate(urls, F.lit(0), lambda n, u: n + F.length(u))
    playlist = F.startswith(F.ltrim(col(x)), F.lit("#EXTM3U"))
    return ~playlist & (weight <= 0.3 * F.length(col(x)))


def json3_text(body: Column | str) -> Column:
    """The words of a caption file of events with segments, joined by spaces; blank segments are left out."""
    parsed = F.from_json(col(body), "events array<struct<segs: array<struct<utf8: string>>>>")
    pieces = F.flatten(F.transform(F.coalesce(parsed["events"], F.array()), lambda e: F.coalesce(e["segs"], F.array())))
    return F.array_join(F.filter(F.transform(pieces, lambda s: s["utf8"]), lambda s: F.trim(s) != ""), " ")


def thousands(x: Column | str) -> Column:
    return F.translate(F.coalesce(F.format_number(lenient_long(x), 0), F.lit("0")), ",", " ")


def compact(x: Column | str) -> Column:
    """12345 as 12K, 1500000 as 1.5M."""
    n = lenient_long(x)
    millions = F.regexp_replace(F.format_string("%.1f", n / 1e6), r"\.0$", "")
    return (
        F.when(n.isNull(), "0")
        .when(n >= 1_000_000, F.concat(millions, F.lit("M")))
        .when(n >= 1_000, F.concat(F.bround(n / 1000, 0).cast("long").cast("string"), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def clock(seconds: Column | str) -> Column:
    """4205 as 1:10:05, 65 as 1:05; nothing for none."""
    s = lenient_long(seconds)
    hours, minutes, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    long = F.format_string("%d:%02d:%02d", hours, minutes, rest)
    return F.when(F.coalesce(s, F.lit(0)) == 0, "—").when(hours > 0, long).otherwise(F.format_string("%d:%02d", minutes, rest))


def initials(x: Column | str) -> Column:
    """The first letters of a title's first two words."""
    words = F.filter(F.split(F.regexp_replace(col(x), r"(?U)[^\p{L}\p{N}]", " "), " "), lambda w: w != "")
    found = F.upper(F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 1)), ""))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("?"))


def badge_code(slug: Column | str, name: Column | str, known: Mapping[str, str], length: int = 4) -> Column:
    """A short code: the known one, else the initials of a name of several words, else the name's beginning."""
    table = F.create_map(*[F.lit(v) for pair in known.items() for v in pair]) if known else F.lit(None)
    words = F.filter(F.split(F.replace(col(name), F.lit("|"), F.lit(" ")), r"\s+"), lambda w: w != "")
    letters = F.substring(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""), 1, length)
    made = F.upper(F.when(F.size(words) >= 2, letters).otherwise(F.substring(col(name), 1, length)))
    own = table[col(slug)] if known else F.lit(None).cast("string")
    return F.coalesce(own, F.nullif(made, F.lit("")), F.lit("GEN"))


def secret_key(x: Column) -> Column:
    """Whether a key names a secret: one of its words is a secret's, whatever joins the words, or it holds a marker."""
    named = F.arrays_overlap(F.split(F.lower(x), "[^a-z0-9]+"), F.array(*map(F.lit, SECRET_WORDS)))
    for marker in SECRET_MARKERS:
        named = named | F.lower(x).contains(marker)
    return named


def redact_map(x: Column | str) -> Column:
    """A map of strings with the values of secret keys blotted out."""
    return F.transform_values(col(x), lambda k, v: F.when(secret_key(k), REDACTED).otherwise(v))


@F.pandas_udf(StringType())
def redact_json(x: pd.Series) -> pd.Series:
    """A JSON document with the values of secret keys blotted out down to six levels; what is no JSON stays."""
    words = set(SECRET_WORDS)

    def secret(name: str) -> bool:
        name = name.lower()
        return any(m in name for m in SECRET_MARKERS) or not words.isdisjoint(re.split(r"[^a-z0-9]+", name))

    def walk(value: object, depth: int = 0) -> object:
        if depth > 6:
            return value
        if isinstance(value, dict):
            return {k: REDACTED if secret(k) else walk(v, depth + 1) for k, v in value.items()}
        if isinstance(value, list):
            return [walk(v, depth + 1) for v in value]
        return value

    def one(s: str) -> str:
        try:
            return json.dumps(walk(json.loads(s)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return s

    return x.map(one, na_action="ignore")
