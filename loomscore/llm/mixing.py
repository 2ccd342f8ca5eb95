"""Mixing sources to target weights: budgets flow down a tree of domains, languages and sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, numbered, salts_for, settle


def word_count(text: str) -> Column:
    """Words of a text (runs without ASCII white space); null: 0."""
    blank = F.translate(F.col(text), "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(blank, " "), "")).cast("long"), F.lit(0).cast("long"))


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """The budget of each node from its parent's (column up), by weight w, with no node above its capacity cap.

    Siblings are taken by capacity for each unit of weight; as long as a node can't use its proportional part of what is
    left it is full, and what it leaves falls to its later siblings. All in exact integers; fractions of a token are cut."""
    group = Window.partitionBy(*parent)
    order = group.orderBy(F.col("cap") / F.col("w"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    nodes = nodes.withColumns(
        {
            "_cap": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "_w": F.coalesce(F.sum("w").over(before), F.lit(0)),
            "_all": F.sum("w").over(group),
        }
    )
    nodes = nodes.withColumn("_fits", wide("cap") * (wide("_all") - wide("_w")) <= (wide("up") - wide("_cap")) * wide("w"))
    nodes = nodes.withColumn("_full", F.min("_fits").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    nodes = nodes.withColumns(
        {
            "_fc": F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(group), F.lit(0)),
            "_fw": F.coalesce(F.sum(F.when(F.col("_full"), F.col("w"))).over(group), F.lit(0)),
        }
    )
    part = F.expr("((cast(up AS decimal(19,0)) - _fc) * cast(w AS decimal(19,0))) div (_all - _fw)")
    return nodes.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(part)).drop("_cap", "_w", "_all", "_fits", "_full", "_fc", "_fw")


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Sequence[dict[str, int]], default: int, percent: int, max_epochs: int
) -> DataFrame:
    """leaves (levels, supply) with budget: `percent` of the whole supply, spread over the tree.

    Weights are propagated from the root: each level is shared among siblings by weight, up to what their leaves can give
    in max_epochs epochs. So a shortage goes to siblings first, and to the parent's siblings only when all of those are full."""
    tree = leaves.withColumn("cap", F.col("supply") * max_epochs)
    for k, level in enumerate(levels):
        weight = F.lit(default)
        for name, w in weights[k].items():
            weight = F.when(F.col(level) == name, F.lit(w)).otherwise(weight)
        tree = tree.withColumn(f"_w{k}", weight.cast("long"))
    for k in range(len(levels)):
        tree = tree.filter(F.col(f"_w{k}") > 0)  # a weight of 0 takes nothing
    supply = leaves.agg(F.sum("supply")).first()[0] or 0
    room = tree.agg(F.sum("cap")).first()[0] or 0
    up = None
    for k, level in enumerate(levels):
        own = list(levels[: k + 1])
        nodes = tree.groupBy(*own).agg(F.sum("cap").alias("cap"), F.max(f"_w{k}").alias("w"))
        if up is None:
            nodes = nodes.withColumn("up", F.lit(min(supply * percent // 100, room)).cast("long"))
        else:
            nodes = nodes.join(up.withColumnRenamed("budget", "up"), own[:-1])
        up = _share(nodes, own[:-1], level).select(*own, "budget")
    return up


def mix_sources(
    docs: DataFrame,
    levels: Sequence[str],
    weights: Sequence[dict[str, int]],
    key: str = "doc_id",
    text: str = "text",
    percent: int = 80,
    max_epochs: int = 2,
    default: int = 1,
    seed: int = 7,
    run_keys: int = 100_000,
) -> DataFrame:
    """docs once for each epoch that selects them, with n_tokens (long: words) and epoch (int, from 0) appended.

    The leaf of a document is its value of each level (null counts as the empty string). A leaf with budget b and
    supply s a epoch gives every document b div s times; of one more epoch it gives the prefix, in the order of
    md5(seed-epoch-key), whose tokens fit into the rest. A prefix of an order ends at one value of it, so documents need no sorting: sums
    over runs of equal leading md5 digits tell in which run a leaf's prefix ends, sums over the values of that run alone tell where, and
    that end goes to the documents with the leaf's budget. Digits are as many as leave about run_keys of the largest leaf's keys to a run (three at least). Only keys and counts are shuffled, added up before the shuffle, so
    neither a leaf with a third of all rows nor as many rows of one key meet in one task.

    Null and empty texts have 0 tokens and go with their place in the order; repeated rows are separate rows at the same place
    of the order; columns named n_tokens or epoch are replaced; an empty table gives an empty result."""
    docs, name = numbered(docs.drop("n_tokens", "epoch"))
    names = [f"_level{k}" for k in range(len(levels))]
    rows = docs.withColumns({n: F.coalesce(F.col(name[c]).cast("string"), F.lit("")) for n, c in zip(names, levels, strict=True)})
    rows = rows.withColumn("n_tokens", word_count(name[text]))
    slim = rows.groupBy(*names, F.coalesce(F.col(name[key]).cast("string"), F.lit("")).alias("_key")).agg(F.sum("n_tokens").alias("n_tokens"))
    slim = settle(slim)
    counted = settle(slim.groupBy(*names).agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("n_keys")))
    largest = counted.agg(F.max("n_keys")).first()[0] or 0
    digits, salts = 3, salts_for(largest)
    while largest > run_keys * 16**digits:
        digits += 1
    leaves = counted.drop("n_keys")
    budgets = leaf_budgets(leaves, names, weights, default, percent, max_epochs)
    plan = leaves.join(budgets, names, "left").withColumn("budget", F.coalesce("budget", F.lit(0).cast("long")))
    plan = plan.withColumn("_whole", F.expr("if(supply > 0, budget div supply, 0)"))
    plan = settle(plan.withColumn("_rest", F.col("budget") - F.col("_whole") * F.col("supply")).select(*names, "_whole", "_rest"))

    def order(of: str) -> Column:
        return F.md5(F.concat_ws("-", F.lit(seed).cast("string"), F.col("_whole").cast("string"), F.coalesce(F.col(of).cast("string"), F.lit(""))))

    ordered = join_hot(slim, plan.filter("_rest > 0"), names, salts=salts, by="_key").withColumn("_order", order("_key"))
    ordered = ordered.withColumn("_run", F.substring("_order", 1, digits))
    past = Window.partitionBy(*names).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = ordered.groupBy(*names, "_run").agg(F.sum("n_tokens").alias("_sum"), F.first("_rest").alias("_rest"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(past), F.lit(0)))
    last = settle(sums.filter("_before <= _rest AND _before + _sum > _rest").select(*names, "_run", "_before"))
    upto = Window.partitionBy(*names).orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = join_hot(ordered, last, [*names, "_run"], salts=salts_for(largest >> 4 * digits), by="_key").groupBy(*names, "_run", "_before", "_rest", "_order").agg(F.sum("n_tokens").alias("_sum"))
    inside = inside.withColumn("_end", F.col("_before") + F.sum("_sum").over(upto)).filter("_end <= _rest")
    # Before the first value of the run comes the run's own name, after all of them whatever is past the digits.
    ends = last.join(inside.groupBy(*names).agg(F.max("_order").alias("_end")), names, "left").select(*names, F.coalesce("_end", "_run").alias("_end"))
    plan = settle(plan.join(ends, names, "left").withColumn("_end", F.when(F.col("_rest") > 0, F.coalesce("_end", F.lit("g")))))
    placed = join_hot(rows, plan, names, salts=salts, by=name[key])
    copies = F.col("_whole") + F.when(order(name[key]) <= F.col("_end"), 1).otherwise(0)
    chosen = placed.withColumn("_copies", copies.cast("int")).filter("_copies > 0")
    return chosen.withColumn("epoch", F.explode(F.expr("sequence(0, _copies - 1)"))).select(
        *[F.col(c).alias(old) for old, c in name.items()], "n_tokens", "epoch"
    )


def oracle(weights: Sequence[dict[str, int]], percent: int = 80, max_epochs: int = 2, default: int = 1, seed: int = 7) -> str:
    """The same mixture of documents by domain, lang and source as SQL."""
    names = ["domain", "lang", "source"]

    def weight(k: int) -> str:
        return f"CASE coalesce({names[k]}, '') " + " ".join(f"WHEN '{n}' THEN {w}" for n, w in weights[k].items()) + f" ELSE {default} END"

    def level(k: int) -> str:
        own, parent = ", ".join(names[: k + 1]), ", ".join(names[:k])
        group = f"PARTITION BY {parent}" if k else ""
        past = f"OVER ({group} ORDER BY CAST(cap AS DOUBLE) / w, {names[k]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        upto = f"OVER ({group} ORDER BY CAST(cap AS DOUBLE) / w, {names[k]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        up = f"JOIN b{k - 1} USING ({parent})" if k else "CROSS JOIN wanted"
        return f"""
n{k} AS (SELECT {own}, sum(cap) AS cap, max(w{k}) AS w FROM tree GROUP BY {own}),
p{k} AS (SELECT n{k}.*, budget AS up FROM n{k} {up}),
f{k} AS (SELECT *, cap * (sum(w) OVER ({group}) - coalesce(sum(w) {past}, 0)) <= (up - coalesce(sum(cap) {past}, 0)) * w AS fits FROM p{k}),
g{k} AS (SELECT *, bool_and(fits) {upto} AS filled FROM f{k}),
b{k} AS (SELECT {own}, CASE WHEN filled THEN cap ELSE
    (up - coalesce(sum(cap) FILTER (WHERE filled) OVER ({group}), 0)) * w // (sum(w) OVER ({group}) - coalesce(sum(w) FILTER (WHERE filled) OVER ({group}), 0)) END AS budget FROM g{k}),"""

    return rf"""
WITH d AS (
    SELECT doc_id, lang, source, CAST(coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS BIGINT), 0) % 4 AS VARCHAR) AS domain,
           coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS n FROM documents
), leaf AS (
    SELECT domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, sum(n)::HUGEINT AS supply FROM d GROUP BY ALL
), tree AS (SELECT *, supply * {max_epochs} AS cap, {weight(0)} AS w0, {weight(1)} AS w1, {weight(2)} AS w2 FROM leaf),
wanted AS (SELECT least((SELECT sum(supply) FROM leaf) * {percent} // 100, (SELECT sum(cap) FROM tree)) AS budget),
{level(0)}{level(1)}{level(2)}
plan AS (SELECT domain, lang, source, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS whole, budget, supply FROM leaf JOIN b2 USING (domain, lang, source)),
ordered AS (
    SELECT d.doc_id, d.domain, d.lang, d.source, d.n, whole, budget - whole * supply AS rest,
           sum(d.n) OVER (PARTITION BY d.domain, p.lang, p.source ORDER BY md5(concat_ws('-', '{seed}', CAST(whole AS BIGINT)::VARCHAR, d.doc_id::VARCHAR))) AS upto
    FROM d JOIN plan p ON d.domain = p.domain AND coalesce(d.lang, '') = p.lang AND coalesce(d.source, '') = p.source
)
SELECT doc_id, domain, lang, source, CAST(n AS BIGINT) AS n_tokens,
       CAST(unnest(range(CAST(whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT))) AS INTEGER) AS epoch
FROM ordered
"""
