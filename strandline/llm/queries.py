"""The registered queries of this sub-package, one for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import htmltext, language, mixing, packing, pii, quality, rules, simhash, urlrules, winnowing
from strandline.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_edited(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlrules.judge(pages, urlrules.page_labels(pages, table(spark, sf_dir, "labels")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_html": op2_html,
    "op3_winnowing": op3_winnowing,
    "op4_mixing": op4_mixing,
    "op5_rules": op5_rules,
    "op6_urls": op6_urls,
    "op7_packing": op7_packing,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_language": op10_language,
}

#: DuckDB SQL by query; an operator that SQL cannot express has none and is tested against brute force.
ORACLES: dict[str, str] = {}
