"""Snapshots of reviews, and versions of what is made of them: reuse, overlap, decisions to make anew, versioned saves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULT, Settings
from . import corpus
from .merge import insert_ignore


def latest(snapshots: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of each group the snapshot built last; of equal times the larger id. An aggregate, so nothing is sorted."""
    rest = [c for c in snapshots.columns if c not in by]
    last = snapshots.groupBy(*by).agg(F.max(F.struct("built_at", "snapshot_id", F.struct(*rest).alias("row"))).alias("x"))
    return last.select(*by, "x.row.*")


def create_or_return(snapshots: DataFrame, built: DataFrame, by: Sequence[str]) -> DataFrame:
    """built (by..., content_hash, snapshot_id) with snapshot_id of the snapshot that already has this content, and created: whether none had."""
    known = snapshots.groupBy(*by, "content_hash").agg(F.min("snapshot_id").alias("_known"))
    known = known.toDF(*[f"_k{k}" for k in range(len(by))], "_hash", "_known")
    same = built["content_hash"] == known["_hash"]
    for k, c in enumerate(by):
        same = same & built[c].eqNullSafe(known[f"_k{k}"])
    rows = built.join(known, same, "left").drop("_hash", *[f"_k{k}" for k in range(len(by))])
    return rows.withColumn("created", F.col("_known").isNull()).withColumn("snapshot_id", F.coalesce("_known", "snapshot_id")).drop("_known")


def new_members(snapshots: DataFrame, members: DataFrame) -> DataFrame:
    """The members (snapshot_id, review_id, position) of snapshots that were created rather than found."""
    return members.join(snapshots.filter("created").select("snapshot_id"), "snapshot_id", "left_semi")


def build(
    reviews: DataFrame, known: DataFrame, group: str, key: str, body: str, score: str, date: str, tokens: int, cap: int, settings: Settings = DEFAULT, **lexicon: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """From candidate reviews to snapshots: (headers, members).

    Reviews that are short, repeated, off topic or at odds with their score go. Of each group as many stay as fit into so many tokens (review_budget),
    every stratum among them; in corpus order they are the snapshot, whose content hash decides whether it is one of `known` (group, content_hash,
    snapshot_id). headers: group, content_hash, n_members, snapshot_id, created; members, of created snapshots only: group, snapshot_id, key, position,
    ref. A new snapshot's id comes from its group and content, so building it again gives the same one. Null groups are a group; a group without a
    review that stays has no snapshot."""
    kept = corpus.reject_reasons(reviews, group, key, body, score, settings=settings, **lexicon).filter("reason IS NULL").drop("reason")
    budgets = review_budget(kept, group, body, tokens, cap, settings)
    sample = corpus.stratified_sample(kept, group, key, body, score, date, budgets, settings, most=cap)
    placed = corpus.snapshot(sample, group, key, date)
    hashes = corpus.content_hash(placed, group, key, score, date, body)
    sizes = placed.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("n_members"))
    headers = hashes.join(sizes, hashes[group].eqNullSafe(sizes["_group"])).drop("_group")
    print_ = F.sha2(F.concat_ws("|", F.coalesce(F.col(group).cast("string"), F.lit("")), "content_hash"), 256)
    headers = headers.withColumn("snapshot_id", F.conv(F.substring(print_, 1, 15), 16, 10).cast("long"))
    found = create_or_return(known, headers, [group])
    named = found.select(F.col(group).alias("_group"), "snapshot_id", "created")
    members = placed.select(group, key, "position", "ref").join(named, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    return found, new_members(found, members).select(group, "snapshot_id", key, "position", "ref")


def member_refs(members: DataFrame) -> DataFrame:
    """(snapshot_id, refs): the references of a snapshot's members in their order."""
    listed = F.array_sort(F.collect_list(F.struct("position", "ref")))
    return members.groupBy("snapshot_id").agg(F.transform(listed, lambda x: x["ref"]).alias("refs"))


def overlap(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b of snapshot ids) with shared: how many reviews both hold. Joined on the review, so it grows with the overlap."""
    left = members.select(F.col("snapshot_id").alias("a"), "review_id").distinct()
    right = members.select(F.col("snapshot_id").alias("b"), "review_id").distinct()
    both = pairs.select("a", "b").distinct().join(left, "a").join(right, ["b", "review_id"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    return pairs.join(both, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0).cast("long")))


def review_budget(reviews: DataFrame, group: str, text: str, tokens: int, cap: int, settings: Settings = DEFAULT) -> DataFrame:
    """(group, budget): how many reviews fit into so many tokens (3.5 characters each, of which three quarters are for reviews), at most cap.

    A review counts with its length up to corpus_max_chars and 60 characters around it."""
    length = F.least(F.length(F.coalesce(text, F.lit(""))), F.lit(settings.corpus_max_chars))
    mean = reviews.groupBy(group).agg(F.avg(length).alias("mean"))
    return mean.select(group, F.least(F.lit(cap), F.floor(tokens * 3.5 * 0.75 / (F.col("mean") + 60))).cast("int").alias("budget"))


def corpus_text(members: DataFrame, group: str) -> DataFrame:
    """(group, corpus): a line for each member (position, ref, score, text), in order."""
    said = F.concat(F.lit("["), "ref", F.lit("] "), F.coalesce(F.concat(F.lit("("), F.col("score").cast("string"), F.lit(") ")), F.lit("")), F.coalesce("text", F.lit("")))
    listed = members.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("position", said.alias("line")))).alias("x"))
    return listed.select(group, F.array_join(F.transform("x", lambda p: p["line"]), "\n").alias("corpus"))


def decide(rows: DataFrame, now: str, settings: Settings = DEFAULT) -> DataFrame:
    """rows with generate (boolean) and reason: the first rule that applies.

    rows: n_reviews, threshold, same_input (whether this very input was used before), status (of the current summary; null: there is
    none), same_recipe, overlap (with the current summary's snapshot), score_then, score_now, generated_at. A score that is not known never counts
    as moved."""
    fresh = F.greatest(F.lit(0), F.col("n_reviews") - F.coalesce("overlap", F.lit(0)))
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("generated_at").cast("timestamp"))) / 8.64e10
    reason = (
        F.when(F.col("n_reviews") < F.col("threshold"), "below_threshold")
        .when(F.col("same_input"), "identical_input")
        .when(F.col("status").isNull(), "first")
        .when(F.col("status").isin("failed", "rejected"), "retry_after_failure")
        .when(~F.col("same_recipe"), "recipe_changed")
        .when(fresh >= settings.new_reviews, "new_reviews")
        .when((F.col("n_reviews") > 0) & (fresh >= settings.new_ratio * F.col("n_reviews")), "new_ratio")
        .when(F.abs(F.col("score_now") - F.col("score_then")) >= settings.score_move, "score_moved")
        .when((age > settings.summary_days) & (fresh > 0), "staleness")
        .otherwise("not_enough_change")
    )
    rows = rows.withColumn("reason", reason)
    return rows.withColumn("generate", ~F.col("reason").isin("below_threshold", "identical_input", "not_enough_change"))


def save_versions(history: DataFrame, made: DataFrame, by: Sequence[str]) -> DataFrame:
    """history and what was made, with version and is_current.

    A version is one more than the group's largest ever. Only a fresh row demotes the current one and becomes it; what failed is kept beside
    it. made: by..., fingerprint, status; a fingerprint that a group already has is not saved again, one given twice is saved once. Rows of one
    group are numbered by fingerprint."""
    made = insert_ignore(history, made.dropDuplicates([*by, "fingerprint"]), [*by, "fingerprint"])
    top = history.groupBy(*by).agg(F.max("version").alias("_top"))
    order = Window.partitionBy(*by).orderBy("fingerprint")
    fresh = F.col("status") == "fresh"
    rows = made.join(top, list(by), "left").withColumn("version", (F.coalesce("_top", F.lit(0)) + F.row_number().over(order)).cast("long")).drop("_top")
    last = rows.filter(fresh).groupBy(*by).agg(F.max("version").alias("_current"))
    old = history.join(last, list(by), "left").withColumn("is_current", F.col("is_current") & F.col("_current").isNull()).drop("_current")
    new = rows.join(last, list(by), "left").withColumn("is_current", F.coalesce(F.col("version") == F.col("_current"), F.lit(False))).drop("_current")
    return old.unionByName(new.select(old.columns))


def unused(snapshots: DataFrame, *users: DataFrame) -> DataFrame:
    """Snapshots that none of the tables (with snapshot_id) refers to; null references refer to nothing."""
    for u in users:
        snapshots = snapshots.join(u.select("snapshot_id"), "snapshot_id", "left_anti")
    return snapshots


def gap_gate(rows: DataFrame, known: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """rows with verdict: why the gap between critics and players is not explained, or `explained`.

    rows: gap_id, critic, player (out of 100, null: not valid), n_critic, n_player (reviews), explanation, refs (array); known: gap_id, ref."""
    cited = rows.select("gap_id", F.explode(F.array_distinct("refs")).alias("ref")).join(known.select("gap_id", "ref").distinct(), ["gap_id", "ref"], "left_semi")
    counted = cited.groupBy("gap_id").agg(F.count("*").alias("_n"))
    gap = F.abs(F.col("critic") - F.col("player"))
    few = (F.col("n_critic") < settings.critic_threshold) | (F.col("n_player") < settings.player_threshold)
    empty = F.trim(F.coalesce("explanation", F.lit(""))) == ""
    verdict = (
        F.when(gap.isNull(), "no_valid_scores")
        .when(gap < settings.gap_points, "small_gap")
        .when(few, "few_reviews")
        .when(empty | (F.coalesce("_n", F.lit(0)) < settings.claim_support), "unsupported")
        .otherwise("explained")
    )
    return rows.join(counted, "gap_id", "left").withColumn("verdict", verdict).drop("_n")


def exclusive(rows: DataFrame, chosen: DataFrame, group: str, key: str, flag: str) -> DataFrame:
    """rows with the flag set on the chosen (group, key) alone, in the groups where one was chosen; other groups keep theirs."""
    picked = chosen.select(group, F.col(key).alias("_chosen"))
    rows = rows.join(picked, group, "left")
    return rows.withColumn(flag, F.when(F.col("_chosen").isNull(), F.col(flag)).otherwise(F.col(key) == F.col("_chosen"))).drop("_chosen")


def first_usable(attempts: DataFrame, group: str, least: int) -> DataFrame:
    """(group, text, source, attempts): the first attempt whose text has at least `least` characters, and all attempts as structs.

    attempts: seq, source, text. A shorter text is a failure, not a result; without any the text is null."""
    usable = F.length(F.trim(F.coalesce("text", F.lit("")))) >= least
    state = F.when(F.col("text").isNull(), "unavailable").when(usable, "ok").otherwise("too_short")
    tried = F.array_sort(F.collect_list(F.struct("seq", "source", state.alias("state"))))
    found = F.min(F.when(usable, F.struct("seq", "source", "text")))
    rows = attempts.groupBy(group).agg(found.alias("x"), tried.alias("attempts"))
    return rows.select(group, "x.text", "x.source", "attempts")


def video_chain(items: DataFrame) -> DataFrame:
    """items with stage: where the chain from search to summary stands. Each step waits for the one before.

    items: interest (reason against a search, or null), video_id, transcript (text or null), least_chars, summary_status."""
    stage = (
        F.when(F.col("interest").isNotNull(), F.concat(F.lit("skipped_"), "interest"))
        .when(F.col("video_id").isNull(), "discover")
        .when(F.col("transcript").isNull(), "transcript")
        .when(F.length("transcript") < F.col("least_chars"), "transcript_too_short")
        .when(F.col("summary_status").isNull(), "summarise")
        .when(F.col("summary_status") == "fresh", "done")
        .otherwise("retry_summary")
    )
    return items.withColumn("stage", stage)


def skip_records(known: DataFrame, skipped: DataFrame, by: Sequence[str], reason: str = "reason") -> DataFrame:
    """The skips to write down: one a group, never for a group that has a record of any kind already."""
    first = skipped.groupBy(*by).agg(F.min(reason).alias(reason))
    return insert_ignore(known, first, by).withColumns({"status": F.lit("skipped"), "is_current": F.lit(False)})


def claim_outcomes(claims: DataFrame, summaries: DataFrame, since: str) -> DataFrame:
    """(validation, n) over the claims of summaries made since a time."""
    recent = summaries.filter(F.col("generated_at") >= F.lit(since).cast("timestamp")).select("summary_id")
    return claims.join(recent, "summary_id", "left_semi").groupBy("validation").agg(F.count("*").alias("n"))


def score_move(now: Column, then: Column) -> Column:
    """How far a score has moved; null where either is missing."""
    return F.abs(now - then)


def save_once(known: DataFrame, made: DataFrame, by: Sequence[str]) -> DataFrame:
    """What is stored after saving `made`: a key that is known keeps its row as it is, another gets the new one; created tells which."""
    asked = made.select(*by).distinct()
    old = known.join(asked, list(by), "left_semi").withColumn("created", F.lit(False))
    new = insert_ignore(known, made.dropDuplicates(list(by)), by).withColumn("created", F.lit(True))
    return old.unionByName(new.select(old.columns))
