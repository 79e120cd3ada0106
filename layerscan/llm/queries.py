"""Registered queries of this subpackage and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from layerscan.llm import (
    anchors, benchmarks, divergence, language, minhash, pages, partenum, pieces, quality, resampling, suffixes, urls, wordpiece,
)


def _table(name: str, work: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: work(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.quality_report,
    "op2_sentencepiece": _table("documents", pieces.piece_report),
    "op3_url_filters": _table("pages", urls.judge_urls),
    "op4_html_extraction": _table("pages", pages.page_report),
    "op5_token_counts": _table("documents", wordpiece.count_report),
    "op6_substring_dedup": _table("documents", anchors.dedup_report),
    "op7_suffix_dedup": _table("documents", suffixes.suffix_report),
    "op8_decontamination": benchmarks.leak_report,
    "op9_language_id": _table("documents", language.language_report),
    "op10_minhash_near_dedup": _table("documents", minhash.near_report),
    "op11_jaccard_join": _table("documents", partenum.join_report),
    "op12_divergence": _table("documents", divergence.divergence_report),
    "op13_resampling": resampling.resample_report,
}

ORACLE: dict[str, str] = {
    "op3_url_filters": urls.ORACLE,
    "op12_divergence": divergence.ORACLE,
    "op13_resampling": resampling.ORACLE,
}
