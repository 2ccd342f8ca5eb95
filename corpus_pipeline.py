"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads; all but the last return the columns of
documents (and any others that docs has, whatever their names). The stages call the operators of loomscore.llm with the parameters of their
queries, except that mixing selects a document once at most (one epoch), since the stage before has removed its copies.

Odd rows: a null or empty text has too few words and goes in the first stage; should one come later, it stays as it is, is a copy of nothing,
takes its place in the mixture with no tokens and is packed as its one end token. A null source is no site for line dedup and a
source of its own for mixing, a null lang is a language of its own. Rows without a doc_id pass like others. Rows that repeat a doc_id with one text
become one, unlike texts under one doc_id are documents of their own. Very long texts are read whole. An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscore.llm.common import numbered, release, settle, sifted, table
from loomscore.llm.jaccard import jaccard_components
from loomscore.llm.line_dedup import drop_spread_lines
from loomscore.llm.mixing import mix_sources
from loomscore.llm.packing import pack_documents
from loomscore.llm.queries import LEVELS, WEIGHTS, tokenizer_files, with_domain
from loomscore.llm.repetition import quality_rules


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: those without enough words (so null and empty texts), and repetitive ones. Repeated rows are judged alike."""
    rows, name = numbered(docs)
    return quality_rules(rows, name["text"]).filter("kept").select(*rows.columns).toDF(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; n_chars follows the text. No row goes, not even one whose every line does."""
    rows, name = numbered(docs)
    cleaned = drop_spread_lines(rows, name["doc_id"], name["text"], name["source"])
    length = F.when(F.col("removed_lines") > 0, F.length(name["text"]).cast("long")).otherwise(F.col(name["n_chars"]))
    return cleaned.withColumn(name["n_chars"], length).select(*rows.columns).toDF(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the least doc_id stays; rows that repeat a doc_id and its text stay once.

    A row goes by its doc_id and text, so an unlike text under the doc_id of a near copy stays. A row without a doc_id goes if its component
    holds one with a doc_id; without any such, all rows of the component stay."""
    rows, name = numbered(docs)  # docs may have columns of any name
    key, text = name["doc_id"], name["text"]
    found = settle(jaccard_components(rows, key, text, text_hash=True).withColumnRenamed(key, "doc_id"))
    gone = found.filter("component_id IS NOT NULL AND NOT doc_id <=> component_id")
    later = settle(gone.selectExpr("doc_id AS later_id", "text_hash AS later_hash").distinct())
    repeated = settle(found.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("again")))
    text_hash = F.xxhash64(F.col(text).cast("string"))
    is_later = F.col(key).eqNullSafe(F.col("later_id")) & (text_hash == F.col("later_hash"))
    judged = sifted(rows, F.xxhash64(F.col(key).cast("long"), text_hash), later, F.xxhash64("later_id", "later_hash"))
    kept = judged.filter("_maybe").drop("_maybe").join(later, is_later, "left_anti").union(judged.filter("NOT _maybe").drop("_maybe"))
    if not repeated.isEmpty():
        is_again = F.col(key) == F.col("again")
        once = kept.join(repeated, is_again, "left_semi").dropDuplicates([key, text])
        kept = kept.join(repeated, is_again, "left_anti").union(once)
    return kept.toDF(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """80 % of the tokens, spread over domains, languages and sources by weight; each document once or not at all. Rows of one doc_id share a place."""
    rows, name = numbered(docs)
    levels = ("_domain", *(name[c] for c in LEVELS[1:]))
    mixed = mix_sources(with_domain(rows, "_domain", name["source"]), levels, WEIGHTS, name["doc_id"], name["text"], max_epochs=1)
    return mixed.select(*rows.columns).toDF(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: a row for each piece of each row of docs."""
    rows, name = numbered(docs)
    return pack_documents(rows, *tokenizer_files(), name["doc_id"], name["text"]).withColumnRenamed(name["doc_id"], "doc_id")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: SQL has no suffix array, differencing or tokenizer: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
            if k:
                release(before)  # the stage's own table; all that was made of it is settled
    return docs
