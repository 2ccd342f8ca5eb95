"""Grouping of spelling variants: words at edit distance one, by active nodes that go down a partitioned vocabulary trie.

Two words at distance one share either the first or the last half of the shorter one. So each word is put under its first half and under its last
half, for each of the two lengths (its own and one less) that the shorter word of a pair may have. The words of such a bucket differ only in the rest, the
window, and the windows of a bucket are a trie below the shared part. A bucket of too many characters is halved again, until its words agree in
all but one or two characters; there the alphabet bounds it.

A task walks the tries of its buckets level by level. The active nodes of a node are those within distance one: itself; nodes of its own level that
differ in one character; nodes one level deeper with one more. Each level's come from the level above, by joining the children of two active
nodes on their character, and from siblings and children, where the one edit is spent. Where both nodes end a word, the pair is near."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of, crc_sql, join_hot, settle

LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A bucket's most characters, and how many a task walks at once.
CELLS = 1 << 20


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 7, times: int = 2, every: int = 31) -> DataFrame:
    """(word, n): the runs of letters, lower-cased from A to Z, of at least so many code points that come so many times.

    Of one in `every` runs (by the crc32 of key and run) one code point is deleted first. A null key counts as an empty one, a null text has no
    runs. Counts are combined before they are shuffled, so a frequent word is a row for each task."""
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all(text, F.lit(f"({LETTERS}{{{least},}})"))).alias("run"))
    runs = runs.select("key", F.translate("run", UPPER, LOWER).alias("run")).withColumn("h", crc_of(F.col("key"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= times)


def buckets(words: DataFrame, cells: int = CELLS) -> DataFrame:
    """(bucket, window, front, bar, own, word, n): the words (word, n) under all their buckets, none of which has more than so many characters in
    its windows unless they are of one or two characters.

    `front` is the length of what stands before the window; a pair that shares `bar` characters or more at its start is found in another bucket; `own` marks words
    of the bucket's lesser length."""
    size = F.length("word")
    lesser = F.explode(F.array(size, size - 1))
    spread = words.withColumn("lesser", lesser).withColumns({"front": F.lit(0), "back": F.lit(0), "bar": F.lit(1 << 30)})

    def halved(rows: DataFrame) -> DataFrame:
        left = F.col("lesser") - F.col("front") - F.col("back")
        half = F.ceil(left / 2).cast("int")
        first = F.struct((F.col("front") + half).alias("front"), F.col("back").alias("back"), F.col("bar").alias("bar"))
        last = F.struct(F.col("front").alias("front"), (F.col("back") + left - half).alias("back"), F.least(F.col("bar"), F.col("front") + half).alias("bar"))
        halves = rows.withColumn("half", F.explode(F.array(first, last)))
        return named(halves.select("word", "n", "lesser", "half.*"))

    def named(rows: DataFrame) -> DataFrame:
        """The bucket's name starts with its lesser length, so that buckets of like lengths stand together where rows are sorted by it."""
        rest = F.length("word") - F.col("back")
        start, end = F.col("word").substr(F.lit(1), F.col("front")), F.col("word").substr(rest + 1, F.col("back"))
        name = F.concat_ws("|", F.lpad(F.col("lesser").cast("string"), 9, "0"), F.col("front").cast("string"), F.col("back").cast("string"), start, end)
        return rows.withColumns({"bucket": name, "window": F.col("word").substr(F.col("front") + 1, rest - F.col("front"))})

    found, rows = None, halved(spread)
    while True:
        left = F.col("lesser") - F.col("front") - F.col("back")
        counts = rows.groupBy(F.xxhash64("bucket").alias("_bucket")).agg(F.sum(F.length("window") + 1).alias("cells"), F.max(left).alias("left"))
        hot = settle(counts.filter((F.col("cells") > cells) & (F.col("left") > 1)).select("_bucket", F.lit(True).alias("hot")))
        n_hot = hot.count()
        if not n_hot:
            return _shape(rows if found is None else found.union(rows))
        keyed = rows.withColumn("_bucket", F.xxhash64("bucket"))
        # Their number is that of all characters over `cells`; it is looked at before they are sent to every task.
        marked = settle(keyed.join(F.broadcast(hot), "_bucket", "left") if n_hot <= 100_000 else join_hot(keyed, hot, ["_bucket"], "left"))
        cold = marked.filter("hot IS NULL").select(*rows.columns)
        found = cold if found is None else found.union(cold)
        rows = halved(marked.filter("hot").select("word", "n", "lesser", "front", "back", "bar"))


def _shape(rows: DataFrame) -> DataFrame:
    return rows.select("bucket", "window", "front", "bar", (F.length("word") == F.col("lesser")).alias("own"), "word", "n")


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def near_pairs(bucket: np.ndarray, chars: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (i, j) of one bucket whose windows are at distance one: chars holds each row's code points, then zeros; rows are sorted by
    bucket and window and distinct."""
    n, width = chars.shape
    if not width:  # no two rows of a bucket are alike
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = chars[1:] == chars[:-1]
    common = np.full(n, -1)
    common[1:] = np.where(bucket[1:] == bucket[:-1], np.where(same.all(axis=1), width, same.argmin(axis=1)), -1)
    # Nodes of a level: the first row of each, the parent, the character, and the row that ends there (or -1).
    row_node = np.cumsum(common < 0) - 1
    start = np.flatnonzero(common < 0)
    end_row = np.where(size[start] == 0, start, -1)
    alike = np.zeros((2, 0), np.int64)  # active: both of this level
    longer = np.zeros((2, 0), np.int64)  # active: the first of the level above, the second of this one
    above_begin, above_char = np.zeros(1, np.int64), np.zeros(0, np.int64)
    out = []
    for k in range(1, width + 1):
        has = size >= k
        first = np.flatnonzero(has & (common < k))
        if not len(first):
            break
        parent, char = row_node[first], chars[first, k - 1].astype(np.int64)
        name = (parent << 21) + char  # ascending, as rows are sorted
        begin = np.searchsorted(parent, np.arange(len(start) + 1))
        ends = np.where(size[first] == k, first, -1)

        def children(pairs: np.ndarray, own_begin: np.ndarray, own_char: np.ndarray, other_name: np.ndarray) -> np.ndarray:
            """The children of both nodes of each pair that have one character."""
            counts = own_begin[pairs[0] + 1] - own_begin[pairs[0]]
            child = np.repeat(own_begin[pairs[0]], counts) + _ranges(counts)
            wanted = (np.repeat(pairs[1], counts) << 21) + own_char[child]
            at = np.searchsorted(other_name, wanted)
            hit = at < len(other_name)
            hit[hit] = other_name[at[hit]] == wanted[hit]
            return np.stack([child[hit], at[hit]])

        # The first node of `longer` is in the level above its second; so are its children.
        below = children(longer, above_begin, above_char, name)
        below = below[:, parent[below[1]] != below[0]]  # such a pair comes from its own parent
        longer = np.concatenate([below, np.stack([parent, np.arange(len(first))])], axis=1)
        grown = children(alike, begin, char, name)
        counts = begin[parent + 1] - np.arange(len(first)) - 1  # later siblings
        left = np.repeat(np.arange(len(first)), counts)
        alike = np.concatenate([grown, np.stack([left, left + 1 + _ranges(counts)])], axis=1)
        for pairs, ends_of in ((alike, ends), (longer, end_row)):
            i, j = ends_of[pairs[0]], ends[pairs[1]]
            both = (i >= 0) & (j >= 0)
            out.append(np.stack([i[both], j[both]]))
        above_begin, above_char = begin, char
        node = np.cumsum(has & (common < k)) - 1
        row_node, start, end_row = np.where(has, node, -1), first, ends
    i, j = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return i, j


def code_points(windows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of code points for each string, filled with zeros, and each one's length."""
    size = pc.utf8_length(windows).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.frombuffer("".join(windows.to_pylist()).encode("utf-32-le"), np.uint32)
    chars = np.zeros((len(size), int(size.max(initial=0))), np.uint32)
    chars[np.arange(chars.shape[1]) < size[:, None]] = flat
    return chars, size


def near_words(rows: DataFrame, cells: int = CELLS) -> DataFrame:
    """(word, n_near, best): of each word that has any, its near words' number and the best, as (-n, word)."""

    def walk(batch: pa.Table) -> pa.RecordBatch | None:
        name = pc.dictionary_encode(batch["bucket"].combine_chunks()).indices.to_numpy()
        if np.bincount(name).max(initial=0) < 2:
            return None
        batch = batch.take(pa.array(np.flatnonzero(np.bincount(name)[name] > 1)))
        name = pc.dictionary_encode(batch["bucket"].combine_chunks()).indices.to_numpy()
        chars, size = code_points(batch["window"].combine_chunks())
        own, front, bar = (batch[c].to_numpy() for c in ("own", "front", "bar"))
        i, j = near_pairs(name, chars, size)
        keep = own[i] | own[j]  # two of the greater length meet in another bucket
        i, j = i[keep], j[keep]
        if not len(i):
            return None
        differ = chars[i] != chars[j]
        shared = front[i] + np.where(differ.any(axis=1), differ.argmax(axis=1), chars.shape[1])
        i, j = i[shared < bar[i]], j[shared < bar[i]]
        i, j = np.concatenate([i, j]), np.concatenate([j, i])
        rows = np.unique(i)
        if not len(rows):
            return None
        words = np.array(batch["word"].take(pa.array(rows)).to_pylist(), object)
        rank = np.empty(len(rows), np.int64)
        rank[np.argsort(words, kind="stable")] = np.arange(len(rows))
        x, y = np.searchsorted(rows, i), np.searchsorted(rows, j)
        n = batch["n"].to_numpy()[rows]
        order = np.lexsort((rank[y], -n[y], x))
        first = order[np.flatnonzero(np.diff(x[order], prepend=-1))]
        best = pa.StructArray.from_arrays([pa.array(-n[y[first]]), pa.array(words[y[first]], pa.string())], names=["minus_n", "word"])
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(np.bincount(x)), best], names=["word", "n_near", "best"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows and held.num_rows * (pc.max(pc.utf8_length(held["window"])).as_py() + 1) >= cells:
                last = pc.equal(held["bucket"], held["bucket"][-1])  # its bucket may go on
                at = held.num_rows - pc.sum(last).as_py()
                if at and (found := walk(held.slice(0, at))) is not None:
                    yield found
                held = held.slice(at)
        if held is not None and held.num_rows and (found := walk(held)) is not None:
            yield found

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "window")
    found = dealt.mapInArrow(run, "word string, n_near long, best struct<minus_n: long, word: string>")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def group_spellings(words: DataFrame, ratio: int = 10, cells: int = CELLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n) of distinct words.

    Two words are near if one inserted, deleted or replaced code point makes them equal. A word's form is the near word with the largest n
    (the least in code-point order of equal ones) if that n is at least `ratio` times the word's; root is where its forms lead. n grows
    tenfold at each step, so there are few. Words of one code point or less, and null ones, are near nothing; an empty vocabulary gives an empty result;
    extra columns are not read. Each word goes to four tasks, whatever its neighbours; no pair leaves the task that finds it."""
    words = settle(words.select("word", F.col("n").cast("long").alias("n")))
    near = near_words(buckets(words.filter(F.length("word") > 1), cells))
    form_n = -F.col("best.minus_n")
    is_form = form_n >= ratio * F.col("n")
    linked = settle(
        words.join(near, "word", "left").select(
            "word", F.when(is_form, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, form_n).alias("form_n")
        )
    )
    up = linked.filter("form IS NOT NULL").select("word", F.col("form").alias("up"))
    while True:
        ahead = up.select(F.col("word").alias("up"), F.col("up").alias("top"))
        jumped = settle(up.join(ahead, "up", "left").select("word", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
        if jumped.filter("moved").isEmpty():
            break
        up = jumped.drop("moved")
    root = up.select("word", F.col("up").alias("root"))
    return linked.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: Near words by what is left when one code point is taken out of them.
ORACLE = f"""
WITH RECURSIVE raw AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{{7,}}')), '{UPPER}', '{LOWER}') AS run FROM documents
), runs AS (SELECT doc, run, count(*) AS n FROM raw GROUP BY ALL
), hashed AS (SELECT run, n, {crc_sql("doc || ':' || run")} AS h FROM runs
), damaged AS (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed
), words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), places AS (SELECT word, n, unnest(range(length(word))) AS place FROM words
), less AS (SELECT word, n, place, left(word, place) || substr(word, place + 2) AS rest FROM places
), near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.place = b.place AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (SELECT word, count(*) AS n_near, min((-other_n, other)) AS top FROM near GROUP BY word
), linked AS (
    SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top[1] >= 10 * n THEN top[2] END AS form, CASE WHEN -top[1] >= 10 * n THEN -top[1] END AS form_n
    FROM words LEFT JOIN best ON words.word = best.word
), up AS (SELECT word, form AS root FROM linked WHERE form IS NOT NULL UNION SELECT up.word, linked.form FROM up JOIN linked ON up.root = linked.word WHERE linked.form IS NOT NULL
), roots AS (SELECT up.word, arg_max(root, words.n) AS root FROM up JOIN words ON up.root = words.word GROUP BY up.word)
SELECT linked.word, form, coalesce(root, linked.word) AS root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM linked LEFT JOIN roots ON linked.word = roots.word
"""
