"""Registered queries of the corpus operators and, where SQL can say it, their checking statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberscope.llm import chat, decontaminate, dialogues, lines, merkle, mixing, near_documents, packing, pii, secrets, toxicity, vectors, warc
from emberscope.llm.common import table


def op1_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotations(table(spark, sf_dir, "conversations"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dropped_by_document(table(spark, sf_dir, "documents"), lines.SHORT)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks_by_document(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_mixture_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("fp")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, toxicity.grades_of_labels(table(spark, sf_dir, "labels")))
    return toxicity.scored(documents, model, ["doc_id"])


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_by_document(table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_by_document(table(spark, sf_dir, "documents"))


def op9_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents.near_duplicates(table(spark, sf_dir, "documents"))


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(table(spark, sf_dir, "documents"), bodies=False).drop("ids")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proven_documents(table(spark, sf_dir, "documents"))


def op13_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues.repaired(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_perspectives, op2_line_dedup, op3_embedding_dedup, op4_benchmark_leaks, op5_mixture_rates, op6_toxicity,
        op7_secret_ledger, op8_personal_data, op9_near_documents, op10_warc_index, op11_packing, op12_merkle_manifest,
        op13_dialogue_repair,
    )
}

ORACLE: dict[str, str] = {"op1_perspectives": chat.ORACLE, "op12_merkle_manifest": merkle.ORACLE}
