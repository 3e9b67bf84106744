"""Registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casetrail.llm import codes, fingerprints, mixing, near, packing, pages, pii, preference, prefixes, quality, secrets, spans, substrings, training_order
from casetrail.llm.common import read, scratch_path


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return spans.digest(secrets.find_secrets(docs, secrets.train(docs)), secrets.KINDS)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read(spark, sf_dir, "pages")
    return pages.extract(raw, pages.train(raw))


def op3_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read(spark, sf_dir, "documents"))


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "training-order")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return training_order.write_training_order(read(spark, sf_dir, "documents"), folder)[1]


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(read(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(read(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return spans.digest(pii.find_personal(docs, pii.train(docs)), pii.KINDS)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op10_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(read(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(read(spark, sf_dir, "conversations"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_main_text, op3_repeated_substrings, op4_training_order, op5_best_fit_packing, op6_near_duplicates, op7_personal_data, op8_source_mix, op9_quality_rules, op10_weighted_fingerprints, op11_vector_codes, op12_prefix_trie, op13_quality_classifier)
}
SQL: dict[str, str] = {"op8_source_mix": mixing.ORACLE, "op11_vector_codes": codes.ORACLE, "op12_prefix_trie": prefixes.ORACLE}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
