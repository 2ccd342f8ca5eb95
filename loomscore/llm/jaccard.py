"""N-gram Jaccard join by a token-group matrix: exact components of documents whose shingle sets are alike.

1. Every text becomes its set of 5-word shingles (64-bit hashes). Equal sets are one node, so copies, however many, count once. A set is known by
   128 bits, two sums over it; the first is the node's name, and the few nodes that share theirs with another get a new one.
2. A count-min row of fixed width over all shingles of all texts orders shingles from rare to frequent. Any
   order gives the same links; this one keeps passages that many texts share out of the prefixes.
3. Prefix filters. Two sets with enough overlap share k shingles among their first n - ceil(t n) + k each, here with k a tenth of the
   smaller set: only shingles in two such prefixes matter from here on, and only nodes with enough of those. And they share
   one among the first n - ceil(t n) + 1 of the larger and the first n - ceil(2 t n / (1 + t)) + 1 of the smaller.
4. Groups: a shingle's leader is the most central node that holds it (whose shingles most nodes hold), each node is compared
   with the leader of most of its shingles, and components of those links, cut into runs of bounded size, are the groups.
5. The token-group matrix has the unions of each group's prefix shingles and of its whole sets. A query meets the groups of other
   components that hold, in a set no larger than its own, one of its first shingles with enough shingles from there on to reach
   the overlap; the group's prefixes must hold k of the query's, and its union `percent` of the query's set. Groups that reach these bounds are opened, and their members compared exactly.
   Pairs within a component need no comparison: they are linked already.
6. Components of all links give the answer; texts get it through their node."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, release, settle, sifted
from .wordhash import mix, pieces, shingle_sets

#: Counters of the count-min row are sent in runs of so many.
RUN = 1 << 16


def _signature(s: np.ndarray) -> int:
    """Of a set, whatever the order; as a signed 64-bit number."""
    return int((mix(s) + np.uint64(0x632BE59BD9B4E019)).sum().astype(np.int64))


def _check(s: np.ndarray) -> int:
    """A second signature, which tells sets of one signature apart."""
    return int((mix(s ^ np.uint64(0x9FB21C651E98DF25)) * np.uint64(0xD6E8FEB86659FD93)).sum().astype(np.int64))


class Names:
    """The nodes of sets: their signatures, but for those that another set has too."""

    def __init__(self, clashing: Iterable[tuple[int, int]], sign: Callable[[np.ndarray], int], check: Callable[[np.ndarray], int]):
        self.sign, self.check = sign, check
        self.new = {pair: zlib.crc32(repr(pair).encode()) << 31 ^ k for k, pair in enumerate(sorted(clashing))}
        self.old = {sign for sign, _ in self.new}

    def of(self, s: np.ndarray) -> int:
        sign = self.sign(s)
        return self.new[sign, self.check(s)] if sign in self.old else sign


def _heat(rows: DataFrame, bits: int) -> np.ndarray:
    """How frequent each cell's shingles are: 0, or 1 more for each doubling beyond several times the mean cell. At most 2**bits bytes."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(RUN, np.int64)
        for x in frame["counts"]:
            total += np.frombuffer(zlib.decompress(x), np.int64)
        return pd.DataFrame({"cell": frame["cell"].iloc[:1], "salt": [0], "counts": [zlib.compress(total.tobytes(), 1)]})

    shape = "cell int, salt int, counts binary"
    part = rows.groupBy("cell", "salt").applyInPandas(add, shape).groupBy("cell").applyInPandas(add, shape)
    counts = np.zeros(1 << bits, np.int64)
    for r in part.select("cell", "counts").toLocalIterator():  # 2**bits counters in all
        counts[r.cell * RUN : (r.cell + 1) * RUN] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    base = 4 * counts.mean() + 32
    return np.where(counts < base, 0, 1 + np.log2(np.maximum(counts, 1) / base)).astype(np.uint8)


def jaccard_components(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 80,
    heat_bits: int = 21,
    group_size: int = 32,
    common: float = 0.1,
    text_hash: bool = False,
) -> DataFrame:
    """(key, n_shingles, component_id): component_id is the least key reachable by links, two texts being
    linked when 100 * intersection >= percent * union of their sets of `width`-word shingles (words: runs without ASCII
    white space, A-Z lower-cased; shorter texts are one shingle; texts without words are empty and not linked).

    Null texts count as empty, rows with a null key link like any others but name no component (their component_id is null if no row with a
    key is reachable), repeated rows and ties give repeated equal rows, other
    columns are not read, and an empty table gives an empty result. With text_hash each row also has the xxhash64 of its text,
    which tells rows of one key apart."""
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    spark = docs.sparkSession

    def least(n: int) -> int:
        """The size of the smallest set that can be alike one of n."""
        return -(-percent * n // 100)

    def shared_by(n: int) -> int:
        return max(1, int(common * n))

    # What shared_by says of the smallest set that can be alike a set of n.
    needed = f"greatest(1, floor({common}D * ceil({percent} * n / 100D)))"

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << heat_bits, np.int64)
        least = 0
        for batch, raw in pieces(batches, "text"):
            sizes, signs, checks = [], [], []
            for s in shingle_sets(raw, width):
                sizes.append(len(s))
                signs.append(_signature(s) if len(s) else None)
                checks.append(_check(s) if len(s) else None)
                np.add.at(total, (s >> np.uint64(64 - heat_bits)).astype(np.int64), 1)
            key = batch.column(0)
            prints = batch.column(2)
            least = least or int(prints[0].as_py())
            none = pa.nulls(len(sizes), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [key, pa.array(sizes, pa.int64()), pa.array(signs, pa.int64()), pa.array(checks, pa.int64()), none, none, pa.nulls(len(sizes), pa.binary()), prints],
                names=["key", "n", "node", "check", "cell", "salt", "counts", "text_hash"],
            )
        used = [k for k in range(max(1, len(total) // RUN)) if total[k * RUN : (k + 1) * RUN].any()]
        if used:
            blank = pa.nulls(len(used), pa.int64())
            packed = [zlib.compress(total[k * RUN : (k + 1) * RUN].tobytes(), 1) for k in used]
            yield pa.RecordBatch.from_arrays(
                [blank, blank, blank, blank, pa.array(used, pa.int32()), pa.array([least % 64] * len(used), pa.int32()), pa.array(packed), blank],
                names=["key", "n", "node", "check", "cell", "salt", "counts", "text_hash"],
            )

    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    seen = settle(docs.mapInArrow(read, "key long, n long, node long, check long, cell int, salt int, counts binary, text_hash long"))
    rows = seen.filter("cell IS NULL").select("key", "n", "node", "check", "text_hash")
    heat = spark.sparkContext.broadcast(_heat(seen.filter("cell IS NOT NULL").select("cell", "salt", "counts"), heat_bits))
    one = [F.min(c).alias(c) for c in ("key", "n", "text_hash")]
    nodes = settle(rows.filter("n > 0").groupBy("node").agg(*one, F.min("check").alias("lo"), F.max("check").alias("hi")))
    # Of m sets about m * m / 2 ** 65 pairs share a signature: none of a billion, some dozens of 5 * 10 ** 10.
    clashing = nodes.filter("lo <> hi").select("node")
    pairs_of = [] if clashing.isEmpty() else [(r.node, r.check) for r in rows.join(clashing, "node", "left_semi").select("node", "check").distinct().collect()]
    names = Names(pairs_of, _signature, _check)
    if pairs_of:
        renamed = spark.createDataFrame([(*pair, new) for pair, new in names.new.items()], "node long, check long, new long")
        rows = settle(rows.join(F.broadcast(renamed), ["node", "check"], "left").withColumn("node", F.coalesce("new", "node")).drop("new"))
        nodes = settle(rows.filter("n > 0").groupBy("node").agg(*one))
    rows = rows.drop("check")

    def prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for _, raw in pieces(batches, "text"):
            out = []
            for s in shingle_sets(raw, width):
                if not len(s) or (sign := names.of(s)) in done:
                    continue
                done.add(sign)
                hot = heat.value[(s >> np.uint64(64 - heat_bits)).astype(np.int64)]
                order = s if not hot.any() else s[np.argsort(hot, kind="stable")]
                out.append((sign, len(s), order[: len(s) - least(len(s)) + shared_by(len(s))].view(np.int64)))
            if len(done) > 200_000:  # only saves rows; a node may come twice
                done.clear()
            offsets = np.cumsum([0, *(len(p) for _, _, p in out)]).astype(np.int32)
            flat = np.concatenate([p for _, _, p in out]) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x for x, _, _ in out], pa.int64()),
                    pa.array([n for _, n, _ in out], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                names=["node", "n", "tokens"],
            )

    first = settle(docs.select("text").mapInArrow(prefixes, "node long, n int, tokens array<long>"))
    # Where a pair's first common shingle can stand in the smaller and in the larger of its sets.
    as_smaller = f"pos <= n - ceil({2 * percent} * n / {100 + percent}D)"
    as_larger = f"pos <= n - ceil({percent} * n / 100D)"
    prefix = first.select("node", "n", F.posexplode("tokens").alias("pos", "token"))
    # Rows of a token lie beside each other, so its nodes are seen where they lie and prefixes are shuffled once.
    of_token = Window.partitionBy("token")
    seen_by = prefix.withColumns({"lo": F.min("node").over(of_token), "hi": F.max("node").over(of_token)})
    member = settle(seen_by.filter("lo <> hi").drop("lo", "hi").select("token", "node", "n", "pos").distinct())
    release(first)
    able = settle(member.groupBy("node", "n").count().filter(f"count >= {needed}").select("node"))
    loose, member = member, settle(member.join(able, "node"))
    release(loose)

    # The sets of the nodes that share a prefix token with another.
    wanted = settle(nodes.join(able, "node").select("key", "node", "text_hash"))

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in pieces(batches, "text"):
            out = [s.view(np.int64) for s in shingle_sets(raw, width)]
            offsets = np.cumsum([0, *map(len, out)]).astype(np.int32)
            signs = pa.array([names.of(s.view(np.uint64)) if len(s) else None for s in out], pa.int64())
            flat = pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("node")), signs, pa.ListArray.from_arrays(pa.array(offsets), flat)],
                names=["node", "sign", "tokens"],
            )

    def sets_of(texts: DataFrame) -> DataFrame:
        return texts.mapInArrow(sets, "node long, sign long, tokens array<long>").filter("node = sign").select("node", "tokens")

    owners = wanted.filter("key IS NOT NULL").select("key", "node")
    likely = sifted(docs.select("key", "text"), F.xxhash64("key"), owners, F.xxhash64("key")).filter("_maybe")  # other texts stay where they are
    keyed = likely.join(owners, "key").select("node", "text")
    whole = settle(sets_of(keyed))
    # One row for each node: repeats of a key with its text, and texts without any key, are known from the counts of rows.
    repeated = not rows.filter("key IS NOT NULL AND n > 0").groupBy("key", "node").count().filter("count > 1").isEmpty()
    if repeated or not nodes.filter("key IS NULL").isEmpty():
        nameless = wanted.filter("key IS NULL").select("text_hash", "node")
        unnamed = docs.filter("key IS NULL").join(nameless, "text_hash").select("node", "text")
        several, whole = whole, settle(whole.union(sets_of(unnamed.dropDuplicates(["node"]))).dropDuplicates(["node"]))
        release(several)

    def alike(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those whose sets are alike."""
        both = pairs.join(whole.selectExpr("node AS a", "tokens AS ta"), "a").join(whole.selectExpr("node AS b", "tokens AS tb"), "b")
        sized = both.filter(f"100 * least(size(ta), size(tb)) >= {percent} * greatest(size(ta), size(tb))")
        same = sized.withColumn("same", F.size(F.array_intersect("ta", "tb")).cast("long"))
        return same.filter(f"100 * same >= {percent} * (size(ta) + size(tb) - same)").select("a", "b")

    held = member.groupBy("token").agg(F.floor(F.log2(F.count("*"))).alias("weight"))
    central = settle(member.join(held, "token").groupBy("node").agg(F.sum("weight").alias("weight")))
    leaders = member.join(central, "node").groupBy("token").agg(F.max(F.struct("weight", "node")).alias("top"))
    stars = (
        member.join(leaders.selectExpr("token", "top.node AS leader"), "token")
        .filter("node <> leader")
        .groupBy("node", "leader")
        .count()
        .groupBy("node")
        .agg(F.max(F.struct("count", "leader")).alias("top"))
        .selectExpr("node AS a", "top.leader AS b")
    )
    links = settle(alike(stars))
    linked = connected_components(links)
    release(central)

    # The token-group matrix over what the leaders have left apart.
    sizes = linked.groupBy("component").agg(F.ceil(F.count("*") / group_size).alias("runs"))
    homes = linked.join(sizes, "component").select("node", "component", F.pmod(F.xxhash64("node"), F.col("runs")).alias("run"))
    homes = settle(homes)
    placed = member.select("token", "node", "n", "pos").join(homes, "node", "left")
    placed = settle(placed.selectExpr("token", "node", "n", "pos", "coalesce(component, node) AS component", "coalesce(run, 0) AS run"))
    release(member)
    split = placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max(F.expr(as_smaller)).alias("s"))
    split = split.filter("x <> y AND s").select("token")
    near = settle(placed.filter(as_larger).join(split, "token"))
    matrix = near.filter(as_smaller).groupBy("token", "component", "run").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    # What stands before the first common shingle is not shared, so at most n - pos are; the group's smallest possible
    # partner asks for `asked`.
    asked = f"ceil({percent} * (n + greatest(least, ceil({percent} * n / 100D))) / {100 + percent}D)"
    met = (
        near.selectExpr("token", "node AS query", "n", "pos", "component AS own")
        .join(matrix, "token")
        .filter(f"own <> component AND least <= n AND 100 * most >= {percent} * n AND n - pos >= {asked}")
        .select("query", "n", "component", "run")
        .distinct()
    )
    met = settle(met)
    release(near)
    row = placed.groupBy(F.col("node").alias("query")).agg(F.collect_list("token").alias("own_tokens"))
    column = placed.join(met.select("component", "run").distinct(), ["component", "run"])
    column = column.groupBy("component", "run").agg(F.collect_set("token").alias("group_tokens"))
    counted = met.join(column, ["component", "run"]).join(row, "query")
    opened = settle(counted.filter(f"size(array_intersect(own_tokens, group_tokens)) >= {needed}").select("query", "component", "run"))
    release(placed, met)
    everyone = whole.join(homes, "node", "left").selectExpr("node", "tokens", "coalesce(component, node) AS component", "coalesce(run, 0) AS run")
    groups = opened.select("component", "run").distinct()
    members = settle(everyone.join(groups, ["component", "run"]))
    unions = members.groupBy("component", "run").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens_of_group"))
    bounded = (
        opened.join(unions, ["component", "run"])
        .join(whole.withColumnRenamed("node", "query"), "query")
        .filter(F.expr(f"100 * size(array_intersect(tokens, tokens_of_group)) >= {percent} * size(tokens)"))
        .select("query", "component", "run")
    )
    pairs = bounded.join(members.select("component", "run", "node"), ["component", "run"]).selectExpr("query AS a", "node AS b").distinct()
    late = settle(alike(pairs))
    release(whole, members, opened)
    components = connected_components(links.union(late))

    named = nodes.select("node", "key").join(components, "node", "left").selectExpr("node", "key", "coalesce(component, node) AS component")
    least = named.groupBy("component").agg(F.min("key").alias("component_id"))
    of_node = settle(named.join(least, "component").select("node", "component_id"))
    return rows.join(of_node, "node", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"), *(["text_hash"] if text_hash else [])
    )


#: Every pair of sets that share a shingle, and the closure of their links: for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS tokens FROM w
), n AS (
    SELECT doc_id, len(tokens) AS n, CASE WHEN len(tokens) > 0 THEN sha256(array_to_string(list_sort(tokens), chr(10))) END AS node, tokens FROM s
), node AS (SELECT node, min(doc_id) AS first, any_value(n) AS n, any_value(tokens) AS tokens FROM n WHERE n > 0 GROUP BY node
), t AS (SELECT first, n, unnest(tokens) AS token FROM node
), link AS (
    SELECT a.first AS a, b.first AS b FROM t a JOIN t b ON a.token = b.token AND a.first <> b.first GROUP BY a.first, b.first HAVING 100 * count(*) >= 80 * (max(a.n) + max(b.n) - count(*))
), reach AS (SELECT first AS a, first AS b FROM node UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(component_id, n.doc_id) AS component_id FROM n LEFT JOIN node ON n.node = node.node LEFT JOIN least ON a = node.first
"""
