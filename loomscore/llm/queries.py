"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, jaccard, line_dedup, mixing, spelling, warc
from .attention import score_quality
from .common import remove, table
from .licenses import scan_licenses
from .onebit import nearest
from .packing import pack_documents
from .prefix_tokens import prefix_counts
from .repetition import quality_rules
from .sharding import shard_documents

#: Target weights of the mixture: domains, languages, sources (1 where not named).
LEVELS = ("domain", "lang", "source")
WEIGHTS = ({"0": 4, "1": 3, "2": 2, "3": 1}, {"en": 4, "de": 2, "fr": 2, "es": 1}, {"src0": 2})


def with_domain(docs: DataFrame, name: str = "domain", source: str = "source") -> DataFrame:
    """The tables have no domain: it is the source's number modulo 4 (0 where it has none)."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return docs.withColumn(name, (F.coalesce(number.try_cast("long"), F.lit(0)) % 4).cast("string"))


def tokenizer_files() -> tuple[str, str, str]:
    """The tokenizer's file, the same vocabulary as ranks, and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.drop_spread_lines(docs).drop("source")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *counts, "base_failed", "kept", "covered_words", "longest_repeat")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(table(spark, sf_dir, "documents"))
    return mixing.mix_sources(docs, LEVELS, WEIGHTS).select("doc_id", *LEVELS, "n_tokens", "epoch")


def op4_onebit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), *tokenizer_files())


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_folder(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    found = warc.read_archives(spark, path).withColumnRenamed("key", "page_id")
    remove(spark, path)  # the records are settled
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no paths: a document lies in a directory of its source, language and hundred; those that speak of a licence are licence
    files of their source."""
    docs = table(spark, sf_dir, "documents")
    return scan_licenses(docs.withColumn("path", license_path()))


def license_path() -> Column:
    speaks = F.lower("text").contains("licens")
    file = F.concat_ws("/", "source", "lang", F.expr("doc_id div 100"), F.concat(F.col("doc_id"), F.lit(".txt")))
    return F.when(speaks, F.concat_ws("/", "source", F.concat(F.lit("LICENSE."), F.col("doc_id")))).otherwise(file)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(spelling.vocabulary(table(spark, sf_dir, "documents")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(conversations.damage(table(spark, sf_dir, "conversations")))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_counts(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_quality_rules,
        op3_source_mixing,
        op4_onebit_neighbours,
        op5_quality_classifier,
        op6_packing,
        op7_sharding,
        op8_warc,
        op9_ngram_jaccard,
        op10_license_scan,
        op11_spelling_variants,
        op12_conversation_repair,
        op13_token_counts,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op3_source_mixing": mixing.oracle(WEIGHTS),
    "op8_warc": warc.ORACLE,
    "op9_ngram_jaccard": jaccard.ORACLE,
    "op11_spelling_variants": spelling.ORACLE,
    "op12_conversation_repair": conversations.oracle(),
}
