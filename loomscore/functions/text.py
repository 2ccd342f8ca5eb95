"""Text functions as Column expressions; only accent stripping needs Python (a vectorised UDF), for texts with characters that become several."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters and patterns that results depend on.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f​-‏‪-‮⁠-⁤﻿]"
TAG = r"<[^>]{1,200}>"
PROMPT_ARTIFACT = (
    r"(?im)^\s*(?:#{1,6}\s|===+|---+\s*$|\[/?(?:INST|SYS|SYSTEM|USER|ASSISTANT)\]|<\|[^>]{0,32}\|>|```)"
)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(x: Column | str) -> Column:
    """Runs of (Unicode) white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(col(x), r"(?U)\s+", " "))


def clean_body(x: Column | str) -> Column:
    """Line ends unified, control characters and tags blanked, blank lines limited to one, empty: null."""
    y = F.regexp_replace(col(x), "\r\n?", "\n")
    y = F.regexp_replace(F.regexp_replace(y, CONTROL, ""), TAG, " ")
    y = F.regexp_replace(F.regexp_replace(y, "[ \t]+(?=\n|$)", ""), "\n{3,}", "\n\n")
    return F.nullif(F.regexp_replace(y, r"(?U)^\s+|\s+$", ""), F.lit(""))


def for_prompt(x: Column | str, most: int) -> Column:
    """Structure marks blanked, white space collapsed, cut at a word's end with an ellipsis."""
    y = collapse(F.regexp_replace(F.regexp_replace(F.regexp_replace(col(x), CONTROL, " "), PROMPT_ARTIFACT, " "), TAG, " "))
    head = F.substring(y, 1, most)
    words = F.regexp_replace(head, r" [^ ]*$", "")
    return F.when(F.length(y) > most, F.concat(words, F.lit("…"))).otherwise(y)


@F.pandas_udf(StringType())
def _strip_accents(x: pd.Series) -> pd.Series:
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return x.map(plain, na_action="ignore")


@cache
def _stripped() -> tuple[str, str, str]:
    """The characters that become one other, followed by those that go; what the former become; a pattern for those that become several."""
    one, gone, several = {}, [], []
    hangul = range(0xAC00, 0xD7A4)  # whose decompositions follow from their numbers and are not listed
    chars = [c for k, c in enumerate(map(chr, range(sys.maxunicode + 1))) if k >= 0x80 and (k in hangul or unicodedata.combining(c) or unicodedata.decomposition(c))]
    for c, to in zip(chars, _strip_accents.func(pd.Series(chars)), strict=True):
        if len(to) == 1 and to != c:
            one[c] = to
        elif not to:
            gone.append(c)
        elif len(to) > 1:
            several.append(ord(c))
    ends = [k for k, after in zip(several, [*several[1:], 0], strict=True) if after != k + 1]
    starts = [k for k, before in zip(several, [0, *several[:-1]], strict=True) if before != k - 1]
    pattern = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True))
    return "".join([*one, *gone]), "".join(one.values()), f"(?=[^\\x00-\\x7f])[{pattern}]"


def strip_accents(x: Column | str) -> Column:
    """Compatibility decomposition without combining marks, which is one of each character by itself. Spark has no built-in for it: characters that become
    one or none are translated, and only texts with one that becomes several go to Python."""
    y, (source, to, pattern) = col(x), _stripped()
    other = y.rlike("[^\\x00-\\x7f]")
    several = other & y.rlike(pattern)
    return F.when(~other, y).when(several, _strip_accents(F.when(several, y))).otherwise(F.translate(y, source, to))


def normalize_title(x: Column | str) -> Column:
    """Search key: lower case, no accents, no punctuation, single spaces; apostrophes join."""
    y = F.lower(strip_accents(col(x)))
    y = F.replace(F.translate(y, "'’", ""), F.lit("&"), F.lit(" and "))
    return collapse(F.regexp_replace(y, r"(?U)[^\w\s]", " "))


def _hyphened(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug(x: Column | str) -> Column:
    return _hyphened(F.translate(F.lower(strip_accents(col(x))), "'’", ""))


#: Parts the names of a list that stand in one text. In a name it is a sign like others.
PART = "\x1f"


def in_one(names: Column | str) -> Column:
    """A list of names as one text, for slugs. Null names are as empty ones."""
    return F.array_join(F.transform(col(names), lambda n: F.translate(F.coalesce(n, F.lit("")), PART, " ")), PART)


def slugs(x: Column | str) -> Column:
    """The slugs of the names that stand in one text (see in_one; of no names: one empty slug). Accents are stripped from all at once, as Spark
    lets no Python work on a list's elements."""
    return F.transform(F.split(F.translate(F.lower(strip_accents(col(x))), "'’", ""), PART), _hyphened)


def body_hash(x: Column | str) -> Column:
    return F.sha2(F.lower(collapse(x)), 256)


def words(x: Column | str) -> Column:
    """The distinct space-separated words of a normalised text."""
    return F.array_distinct(F.filter(F.split(col(x), " "), lambda w: w != ""))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct elements; 0.0 if either is empty or null."""
    both = F.size(F.array_intersect(a, b))
    some = F.size(F.array_union(a, b))
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(b) > 0), both / some), F.lit(0.0))


def coverage(needle: Column, hay: Column) -> Column:
    """The share of needle's elements that hay holds; 0.0 without any."""
    return F.coalesce(F.when(F.size(needle) > 0, F.size(F.array_intersect(needle, hay)) / F.size(needle)), F.lit(0.0))


def trigrams(x: Column | str) -> Column:
    """Distinct trigrams of each lower-cased alphanumeric word with two blanks before and one after."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    padded = F.transform(parts, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def polarity(tokens: Column, positive: Sequence[str], negative: Sequence[str], negators: Sequence[str]) -> Column:
    """Positive less negative words; a negator turns the next such word within three tokens round."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("reach"))
    listed = lambda w, names: w.isin(list(names))

    def step(state: Column, w: Column) -> Column:
        value = F.when(listed(w, positive), 1).when(listed(w, negative), -1).otherwise(0)
        turned = F.when(state["reach"] > 0, -value).otherwise(value)
        reach = F.when(listed(w, negators), 3).when(value != 0, 0).otherwise(F.greatest(state["reach"] - 1, F.lit(0)))
        return F.struct((state["sum"] + turned).alias("sum"), reach.cast("int").alias("reach"))

    return F.aggregate(tokens, start, step, lambda s: s["sum"])


def listed_word(names: Sequence[str]) -> str:
    """A pattern for whole words of a text whose words are parted by single spaces."""
    return "(?<![^ ])(?:" + "|".join(r"\Q" + w.replace(r"\E", "") + r"\E" for w in names) + ")(?![^ ])"


def word_signs(plain: Column, positive: Sequence[str], negative: Sequence[str], negators: Sequence[str]) -> Column:
    """A text whose words are parted by single spaces with a sign for each word's kind in its place. No word may be of two kinds."""
    signs = F.translate(plain, "\x01\x02\x03", "\ufffd\ufffd\ufffd")
    for names, sign in ((positive, "\x01"), (negative, "\x02"), (negators, "\x03")):
        if names:
            signs = F.regexp_replace(signs, listed_word(names), sign)
    return F.replace(F.regexp_replace(signs, "[^ \x01-\x03]+", "."), F.lit(" "), F.lit(""))


def sign_polarity(signs: Column) -> Column:
    """polarity of a text by its word_signs, which are read four times.

    A word is turned if a negator stands one to three words before it with no other sentiment word between."""
    count = lambda pattern: F.regexp_count(signs, F.lit(pattern))
    turned = lambda sign: count("\x03\\.{0,2}" + sign)
    return count("\x01") - count("\x02") - 2 * turned("\x01") + 2 * turned("\x02")


def iso_seconds(x: Column | str) -> Column:
    """PT1H24M9S and the like in seconds; null for what is not a duration."""
    part = lambda unit: F.coalesce(F.regexp_extract(col(x), f"([0-9]+){unit}", 1).try_cast("long"), F.lit(0))
    right = col(x).rlike(r"^P([0-9]+D)?T([0-9]+H)?([0-9]+M)?([0-9]+S)?$")
    return F.when(right, part("D") * 86400 + part("H") * 3600 + part("M") * 60 + part("S"))
