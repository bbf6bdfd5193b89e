"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import (chosen_path, doubling, importance, language_id, line_crf, line_runs, mixing, packing, periodic_runs,
                        rules, secrets, toxicity, winnowing)
from larder.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


@query("op10_source_mixing", mixing.ORACLE_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_secret_scans")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(table(spark, sf_dir, "documents"))


@query("op4_line_runs", line_runs.ORACLE_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_winnowing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op1_line_crf")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def token_ranks() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_config_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), token_ranks())


@query("op3_chosen_path", chosen_path.ORACLE_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_level_doubling", doubling.ORACLE_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubling.substring_dedup(table(spark, sf_dir, "documents"))


@query("op13_periodic_runs", periodic_runs.ORACLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.summary(periodic_runs.periodic_runs(periodic_runs.planted(table(spark, sf_dir, "documents"))))


@query("op12_importance_resampling", importance.ORACLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


@query("op11_language_id")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))
