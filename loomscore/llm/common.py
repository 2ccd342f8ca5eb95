"""Shared helpers of the training-data operators: table access, settled tables, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere in this subpackage (the ASCII white space).
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and Spark runs in this one process
    (tests), a folder made here; on a cluster there must be one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Held while a table is settled: the shuffle files that made it go when it is written, not when its plan is collected as garbage, and Python tasks get
#: their rows in batches of 8 MB, of which each holds several copies.
HELD = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def settle(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors.

    The shuffles that made it are deleted at once, as nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in HELD}
    for k, v in HELD.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark's paths lead."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def release(*frames: DataFrame) -> None:
    """Delete the folders of settled frames that nothing reads any more: only after all that was made of them is settled itself."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, folder)


def salts_for(rows: int, per_task: int = 1_000_000) -> int:
    """Over how many tasks a join deals one key's rows, if the hottest key has so many."""
    return max(16, -(-rows // per_task))


#: Rows that a join may send to every task, whatever Spark makes of their size.
SENT_ROWS = 100_000


def join_hot(
    many: DataFrame, few: DataFrame, on: list[str], how: str = "inner", salts: int = 16, by: str | None = None, hot: DataFrame | None = None, few_rows: int = 0
) -> DataFrame:
    """many join few, whose keys are distinct in few while one may hold a third of the rows of many: rows of a key are dealt over
    `salts` tasks by the hash of `by` (or of all columns), and few goes to each of them, so few should be the far smaller side.

    hot: the only keys that are dealt, some thousands at most; then few may have as many rows as there are keys, and they are not sent to every
    task. few_rows: how many few has. Spark's estimate of few's size leaves the salts out, so it would send far more than it is set to."""
    salt, last, large, own = F.pmod(F.xxhash64(*([by] if by else many.columns)), F.lit(salts)), F.lit(salts - 1), few_rows * salts > SENT_ROWS, ["_salt"]
    if hot is not None:
        marked = F.broadcast(hot.select(*on, F.lit(True).alias("_hot")))
        many, few, large, own = many.join(marked, on, "left"), few.join(marked, on, "left"), True, ["_salt", "_hot"]
        salt, last = (F.when(F.col("_hot"), x).otherwise(0) for x in (salt, last))
    salted = many.withColumn("_salt", salt.cast("int"))
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop(*own[1:])
    return salted.join(spread.hint("merge") if large else spread, [*on, "_salt"], how).drop(*own)


#: A sieve's bits, and those of one of its rows: as many as bitmap_construct_agg gives.
SIEVE, SIEVE_ROW = 1 << 24, 1 << 15


def sifted(many: DataFrame, own: Column, few: DataFrame, theirs: Column) -> DataFrame:
    """many with `_maybe`: where it is false, the hash `own` is none of the hashes `theirs` of few.

    The sieve is a bitmap of fixed width (2 MB) that goes to every task, so rows that cannot find a partner in few, with whatever
    long text they have, need not be shuffled to be joined with it. Of the others some may find none either: a join decides."""
    bit, row = f"pmod({{}}, {SIEVE})", f"_bit div {SIEVE_ROW}"
    hashes = few.select(theirs.alias("_hash")).select(F.expr(bit.format("_hash")).alias("_bit"))
    sieve = hashes.groupBy(F.expr(row).alias("_row")).agg(F.bitmap_construct_agg(F.expr(f"_bit % {SIEVE_ROW}")).alias("_bits"))
    rows = many.withColumn("_hash", own).withColumn("_bit", F.expr(bit.format("_hash"))).withColumn("_row", F.expr(row))
    octet = F.expr(f"CAST(conv(hex(substring(_bits, CAST(_bit % {SIEVE_ROW} div 8 AS INT) + 1, 1)), 16, 10) AS INT)")
    found = F.getbit(octet, F.expr("CAST(_bit % 8 AS INT)")) == 1
    return rows.join(F.broadcast(sieve), "_row", "left").select(*many.columns, F.coalesce(found, F.lit(False)).alias("_maybe"))


def crc_of(*parts: Column) -> Column:
    """The unsigned crc32 of the parts' UTF-8 text with colons between them."""
    return F.crc32(F.concat_ws(":", *parts).cast("binary"))


def crc_sql(text: str) -> str:
    """The same of one SQL string: byte by byte, bit by bit."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))"
    bits = "list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {bits}), 4294967295)"


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named c0, c1, ..., which clash with no name of an operator, and those names by the old ones."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the undirected edges (a, b): component is the least node reachable.

    Contraction: every node hooks to its least neighbour, pointers jump once, edges are rewritten between
    the survivors, until none is left. Aggregations are combined before the shuffle, so hub nodes are no
    bottleneck, and nothing but a row count reaches the driver."""
    edges = settle(edges.filter("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct())
    labels = edges.selectExpr("explode(array(a, b)) AS node").distinct().selectExpr("node", "node AS component")
    while not edges.isEmpty():
        both = edges.union(edges.selectExpr("b", "a"))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
        hook = settle(hook.select("node", F.least("node", "up").alias("up")))
        jump = settle(
            hook.join(hook.selectExpr("node AS up", "up AS top"), "up", "left").selectExpr("node", "coalesce(top, up) AS up")
        )
        before = edges
        labels = settle(
            labels.join(jump.selectExpr("node AS component", "up"), "component", "left").selectExpr(
                "node", "coalesce(up, component) AS component"
            )
        )
        edges = settle(
            edges.join(jump.selectExpr("node AS a", "up AS ua"), "a")
            .join(jump.selectExpr("node AS b", "up AS ub"), "b")
            .filter("ua <> ub")
            .selectExpr("least(ua, ub) AS a", "greatest(ua, ub) AS b")
            .distinct()
        )
        release(before, hook, jump)
    return labels
