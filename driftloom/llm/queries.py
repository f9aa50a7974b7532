"""The operators' queries over the tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.sources.tables import table

from . import chat, collocations, fingerprints, minhash, mixing, ngram_join, packing, pii, quality, repair, suffix_dedup, token_counts, token_files


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality cascade over all documents."""
    return quality.quality(table(spark, sf_dir, "documents")).drop("text")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 50-byte strings removed from all documents."""
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), digest=True)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents, in the order of virtual finish time of the first copy."""
    planned = mixing.schedule(table(spark, sf_dir, "documents")).withColumn("virtual_finish", F.get("finish", F.lit(0)))
    return planned.orderBy("virtual_finish", "doc_id").select("doc_id", "size", "source_size", "target", "taken")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to files and read back."""
    return token_files.digest(token_files.round_trip(table(spark, sf_dir, "documents")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.digest(pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the first, middle and last third of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.thirds(docs)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds the template's own marks, rendered and read back."""
    said = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digest(chat.parse(chat.render(chat.fold(rows))))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under five-word shingle Jaccard of at least 0.8."""
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged, and the cheapest edits that repair them."""
    whole = table(spark, sf_dir, "conversations")
    damaged = repair.damage(whole)
    return repair.digest(repair.repair(damaged), damaged, whole)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of two to three words in all documents."""
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under three-word shingle Jaccard of at least 0.85, from signatures."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_source_mixing": op3_source_mixing,
        "op4_token_files": op4_token_files,
        "op5_personal_data": op5_personal_data,
        "op6_packing": op6_packing,
        "op7_fingerprints": op7_fingerprints,
        "op8_token_counts": op8_token_counts,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_ngram_jaccard": op10_ngram_jaccard,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_collocations": op12_collocations,
        "op13_minhash": op13_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality.ORACLE,
        "op2_suffix_dedup": suffix_dedup.ORACLE,
        "op3_source_mixing": mixing.ORACLE,
        "op9_chat_formatting": chat.ORACLE,
        "op10_ngram_jaccard": ngram_join.ORACLE,
        "op12_collocations": collocations.ORACLE,
        "op13_minhash": minhash.ORACLE,
    }
