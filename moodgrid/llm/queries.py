"""One query per operator, each over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir
from . import oracles
from .decontaminate import find_leaks
from .filteraudit import filter_audit
from .jaccard import jaccard_components
from .langmix import language_report
from .licenses import license_report
from .lm import lm_report
from .packing import pack
from .pii import HOLDER, replace_personal_data
from .quality import quality_report
from .registry import ORACLES, QUERIES, register, table
from .runs import run_report
from .secrets import secret_report
from .toxicity import toxicity_report
from .warc import derive, responses


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder of this run inside the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("op1_ppm_scores")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_report(table(spark, sf_dir, "documents"))


@register("op2_quality_rules", oracles.QUALITY)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


@register("op3_toxic_spans")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op4_surrogates")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replace_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", f"{HOLDER}.n_entities", f"{HOLDER}.entities")


@register("op5_simhash_leaks")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op6_length_buckets")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@register("op7_secret_ledger", oracles.SECRETS)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"), run_folder(spark, "ledger"))


@register("op8_jaccard_components")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


@register("op9_warc_derivatives")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages")))


@register("op10_language_mixture")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


@register("op11_filter_audit", oracles.AUDIT)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op12_license_places", oracles.LICENSES)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


@register("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(table(spark, sf_dir, "documents"))


def catalog() -> tuple[dict, dict]:
    """Copies of the queries and of their SQL, by name."""
    return dict(QUERIES), dict(ORACLES)
