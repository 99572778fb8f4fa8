"""The corpus operators as queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postlake.llm import ctw, embedding_pairs, line_dedup, mixing, secrets, warc
from postlake.llm.common import table
from postlake.llm.decontaminate import contaminated
from postlake.llm.passages import repeated_passages
from postlake.llm.quality import judged
from postlake.llm.simhash_dups import near_duplicates


def op10_simhash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, table(spark, sf_dir, "labels")).where("kept").select("doc_id", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mixed(docs, mixing.target_weights(docs))


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_pairs.linked(table(spark, sf_dir, "embeddings"))


def op2_code_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scored(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_lines(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"), path="source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op6_secrets": op6_secrets,
    "op4_line_dedup": op4_line_dedup,
    "op2_code_length": op2_code_length,
    "op7_embedding_pairs": op7_embedding_pairs,
    "op1_warc_archive": op1_warc_archive,
    "op5_mixing": op5_mixing,
    "op9_repeated_passages": op9_repeated_passages,
    "op8_decontamination": op8_decontamination,
    "op3_quality": op3_quality,
    "op10_simhash_dups": op10_simhash_dups,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_archive": warc.ORACLE,
    "op4_line_dedup": line_dedup.oracle(),
    "op5_mixing": mixing.oracle(),
    "op7_embedding_pairs": embedding_pairs.ORACLE,
}
