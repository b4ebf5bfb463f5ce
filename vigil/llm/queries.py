"""Registered queries of the operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (decontaminate, fill_middle, html_text, ngram_jaccard, oracles, packing, pii, pu_quality, quality_rules, secrets, spelling_variants, substring_dedup,
               training_order, url_reputation)
from .common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.result(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.train(docs, read_table(spark, sf_dir, "labels")))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.result(read_table(spark, sf_dir, "documents"))


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(read_table(spark, sf_dir, "documents"))


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


@query
def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.result(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.result(read_table(spark, sf_dir, "documents"))


@query
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.groups(read_table(spark, sf_dir, "documents"))


@query
def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.result(read_table(spark, sf_dir, "documents"))


@query
def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.result(read_table(spark, sf_dir, "documents"))


@query
def op12_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.result(read_table(spark, sf_dir, "documents"))


ORACLE["op1_decontamination"] = oracles.DECONTAMINATION
ORACLE["op4_substring_dedup"] = oracles.SUBSTRING_DEDUP
ORACLE["op6_ngram_jaccard"] = oracles.NGRAM_JACCARD
ORACLE["op11_fill_middle"] = fill_middle.ORACLE
ORACLE["op12_url_reputation"] = url_reputation.ORACLE
ORACLE["op13_spelling_variants"] = spelling_variants.ORACLE
