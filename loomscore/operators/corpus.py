"""Text corpora: filtering, stratified sampling, ordered snapshots and their hashes."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..settings import DEFAULT, Settings

# The lexicon that decides polarity and topic.
POSITIVE = (
    "masterpiece amazing excellent outstanding brilliant superb fantastic wonderful incredible perfect flawless gorgeous "
    "beautiful addictive polished refined satisfying rewarding immersive captivating recommend recommended love loved enjoy "
    "enjoyed enjoyable best greatest stunning phenomenal solid great good fun"
).split()
NEGATIVE = (
    "terrible awful horrible garbage trash broken unplayable buggy crash crashes crashing unfinished disappointing "
    "disappointment boring tedious repetitive grindy shallow frustrating unfair clunky janky ugly bland lifeless soulless "
    "refund avoid waste worst hate hated mediocre lazy scam greedy predatory microtransactions paywall"
).split()
NEGATORS = ("not", "no", "never", "hardly", "barely", "isn't", "wasn't", "don't")
OFF_TOPIC = (
    "politics political boycott ukraine russia russian israel palestine woke agenda dei propaganda censorship lawsuit ceo "
    "layoffs union strike"
).split()


def reject_reasons(
    rows: DataFrame,
    group: str,
    position: str,
    body: str,
    score: str,
    positive: Sequence[str] = POSITIVE,
    negative: Sequence[str] = NEGATIVE,
    negators: Sequence[str] = NEGATORS,
    off_topic: Sequence[str] = OFF_TOPIC,
    settings: Settings = DEFAULT,
) -> DataFrame:
    """rows with reason: too_short, duplicate, off_topic, score_text_mismatch, or null for what is kept.

    A body is a duplicate only of an earlier kept one. Body, topic and polarity agree within a fingerprint, so
    the first acceptable row of each fingerprint is the kept one: a minimum over those that share it, rather than a loop. Each text is read
    once. Short bodies take no part and are dealt by their position, so empty ones, however many, meet nowhere."""
    # Inlined: else every condition below would read the text anew, for each of its parts.
    once = lambda frame, *values: frame.select("*", F.inline(F.array(F.struct(*values))))
    plain = F.lower(text.collapse(F.coalesce(F.col(body), F.lit(""))))
    n_words = F.length("_plain") - F.length(F.replace(F.col("_plain"), F.lit(" "), F.lit(""))) + 1
    off = F.regexp_count(F.col("_plain"), F.lit(text.listed_word(off_topic))) / n_words if off_topic else F.lit(0.0)
    if set(positive) & set(negative) or (set(positive) | set(negative)) & set(negators):
        said, side = F.split("_plain", " "), text.polarity(F.col("_said"), positive, negative, negators)
    else:
        said, side = text.word_signs(F.col("_plain"), positive, negative, negators), text.sign_polarity(F.col("_said"))
    short = F.length("_plain") < settings.corpus_min_chars
    met = F.when(short, F.concat(F.lit("short "), F.col(position).cast("string"))).otherwise(F.sha2("_plain", 256))
    told = once(once(rows, plain.alias("_plain")), short.alias("_short"), met.alias("_fp"), (~short & (off >= settings.off_topic_ratio)).alias("_off"), F.when(~short, said).alias("_said"))
    told = once(told.drop("_plain"), side.alias("_side")).drop("_said")
    wrong = ((F.col(score) >= 70) & (F.col("_side") <= -3)) | ((F.col(score) <= 35) & (F.col("_side") >= 3))
    told = told.withColumn("_wrong", F.coalesce(wrong, F.lit(False)))
    fine = F.when(~(F.col("_short") | F.col("_off") | F.col("_wrong")), F.col(position))
    told = told.withColumn("_first", F.min(fine).over(Window.partitionBy(group, "_fp")))
    reason = F.when(F.col("_short"), "too_short").when(F.col("_first") < F.col(position), "duplicate").when(F.col("_off"), "off_topic").when(F.col("_wrong"), "score_text_mismatch")
    return told.withColumn("reason", reason).drop("_short", "_fp", "_off", "_side", "_wrong", "_first")


def stratum(score: Column, new: Column) -> Column:
    bucket = F.when(score.isNull(), "unscored").when(score >= 70, "positive").when(score >= 50, "neutral").otherwise("negative")
    return F.concat_ws("/", bucket, F.when(new, "new").otherwise("old"))


def with_strata(rows: DataFrame, group: str, score: str, date: str) -> DataFrame:
    """rows with stratum (score bucket and era) and recency (place between the group's oldest and newest date). Null groups are a group like any other."""
    span = rows.groupBy(F.col(group).alias("_group")).agg(F.min(date).alias("_old"), F.max(date).alias("_new"))
    joined = rows.join(span, rows[group].eqNullSafe(span["_group"])).drop("_group")
    days = F.datediff("_new", "_old")
    middle = F.expr("date_add(_old, cast(floor(datediff(_new, _old) / 2) AS int))")
    recency = F.coalesce(F.try_divide(F.datediff(F.col(date), F.col("_old")), days), F.lit(0.0))
    new = F.coalesce(F.col(date) >= middle, F.lit(False))
    return joined.withColumns({"stratum": stratum(F.col(score), new), "recency": recency}).drop("_old", "_new")


def quotas(sizes: Sequence[int], target: int, share: float) -> list[int]:
    """How many rows each stratum gives, in the order of sizes; at most `target` in all.

    Each gets its rounded part, at least a floor, at most all it has. Then, largest first, one row at a time
    is taken back or added until the sum fits; when all lie at the floor, later strata lose first."""
    if sum(sizes) <= target:
        return list(sizes)
    if target <= 0:
        return [0] * len(sizes)
    floor = max(1, round(target * share / len(sizes)))
    given = [min(n, max(floor, round(target * n / sum(sizes)))) for n in sizes]
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    moved = True
    while sum(given) != target and moved:
        moved = False
        for k in order:
            over = sum(given) - target
            if over > 0 and given[k] > floor:
                given[k] -= 1
            elif over < 0 and given[k] < sizes[k]:
                given[k] += 1
            else:
                continue
            moved = True
    for k in reversed(order):
        given[k] -= min(given[k], max(0, sum(given) - target))
    return given


def strata_quotas(placed: DataFrame, group: str, key: str, target: int | DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(group, stratum, quota) for rows with strata; only stratum sizes (8 rows a group) enter Python. Strata of equal size stand in the order of their least keys.

    target: of every group, or (group, budget) with a group's own; a group without one gives nothing."""
    sizes = placed.groupBy(group, "stratum").agg(F.count("*").alias("n"), F.min(key).alias("first"))
    if isinstance(target, DataFrame):
        own = target.select(F.col(group).alias("_group"), F.col("budget").cast("int").alias("target"))
        sizes = sizes.join(own, sizes[group].eqNullSafe(own["_group"]), "left").drop("_group").fillna({"target": 0})
    else:
        sizes = sizes.withColumn("target", F.lit(target))

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("first")
        frame["quota"] = quotas(frame["n"].astype(int).tolist(), int(frame["target"].iloc[0]), settings.stratum_share)
        return frame[[group, "stratum", "quota"]]

    kind = placed.schema[group].dataType.simpleString()
    return sizes.groupBy(group).applyInPandas(deal, f"{group} {kind}, stratum string, quota long")


def stratified_sample(rows: DataFrame, group: str, key: str, body: str, score: str, date: str, target: int | DataFrame, settings: Settings = DEFAULT, most: int | None = None) -> DataFrame:
    """At most `target` rows of each group (or its own budget, see strata_quotas) with every stratum represented.

    Ranks are cut to the target, or to `most`, the largest budget, where the rows lie (a top-k), so a large group is not sorted as a whole."""
    placed = with_strata(rows, group, score, date)
    dealt = strata_quotas(placed, group, key, target, settings)
    extreme = F.coalesce(F.abs(F.col(score) - 50) / 50.0, F.lit(0.0))
    weight = 0.45 * F.least(F.lit(1.0), F.length(body) / 900.0) + 0.30 * F.col("recency") + 0.15 * extreme + 0.05
    order = Window.partitionBy(group, "stratum").orderBy(F.desc(F.round(weight, 9)), key)
    ranked = placed.withColumn("_k", F.row_number().over(order))
    limit = most if isinstance(target, DataFrame) else target
    top = ranked if limit is None else ranked.filter(F.col("_k") <= limit)
    dealt = dealt.select(F.col(group).alias("_group"), F.col("stratum").alias("_stratum"), "quota")
    same = top[group].eqNullSafe(dealt["_group"]) & (top["stratum"] == dealt["_stratum"])
    return top.join(dealt, same).filter("_k <= quota").drop("_k", "quota", "_group", "_stratum")


def snapshot(rows: DataFrame, group: str, key: str, date: str, prefix: str = "C") -> DataFrame:
    """rows in corpus order (dated first, by date and key) with position from 0 and reference C00, C01, ...

    Rows are numbered within a date; what stands before a date comes from the counts of dates, so a large group is dealt over its dates."""
    days = rows.groupBy(F.col(group).alias("_group"), F.col(date).alias("_date")).agg(F.count("*").alias("_n"))
    past = Window.partitionBy("_group").orderBy(F.col("_date").isNull(), "_date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_before", F.coalesce(F.sum("_n").over(past), F.lit(0))).drop("_n")
    within = Window.partitionBy(group, date).orderBy(key)
    placed = rows.withColumn("_k", F.row_number().over(within))
    same = placed[group].eqNullSafe(days["_group"]) & placed[date].eqNullSafe(days["_date"])
    placed = placed.join(days, same).withColumn("position", (F.col("_before") + F.col("_k") - 1).cast("int")).drop("_group", "_date", "_before", "_k")
    return placed.withColumn("ref", F.format_string(f"{prefix}%02d", "position"))


def content_hash(snapshots: DataFrame, group: str, key: str, score: str, date: str, body: str, version: str = "v1") -> DataFrame:
    """One hash for each group of a snapshot (bounded by its sampling target), over its members in order."""
    points = F.coalesce(F.col(score).cast("double").cast("string"), F.lit("None"))
    day = F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit(""))
    item = F.concat_ws(":", F.col(key).cast("string"), points, day, F.substring(F.sha2(F.coalesce(F.col(body), F.lit("")), 256), 1, 16))
    listed = snapshots.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("position", item.alias("item")))).alias("x"))
    joined = F.array_join(F.transform("x", lambda s: s["item"]), "|")
    return listed.select(group, F.sha2(F.concat(F.lit(f"{version}|"), joined), 256).alias("content_hash"))


def shared_vocabulary(rows: DataFrame, group: str, words: str, least: int, top: int = 6) -> DataFrame:
    """(group, word, n): the words that most rows of a group hold, at least `least` of them; ties go to the lesser word."""
    counted = rows.select(group, F.explode(F.array_distinct(words)).alias("word")).groupBy(group, "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), "word")
    return counted.filter(F.col("n") >= least).withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= top).drop("_k")
