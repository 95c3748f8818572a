"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrill.llm import crf, decontam, html, licenses, mixing, neardup, quality_rules, revisits, tokens, urls
from evidrill.llm.common import read, scratch_path, text_batches

TOKENIZER = "piece_bpe_32k.model"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).drop("copy")


def op2_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("spans", "text_key")


def op4_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    pages = read(spark, sf_dir, "pages")
    return urls.filter_urls(pages, urls.page_edges(pages)).select("page_id", "host", "path", "rule", "verdict")


def op5_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    text_batches(spark)
    # a cache of its own, empty at first: the query stands for a first run
    return tokens.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), scratch_path(spark, "token-cache"))


def op6_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return html.extract_text(read(spark, sf_dir, "pages"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op9_classify_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return crf.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_resolve_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve_revisits(revisits.records_of_pages(read(spark, sf_dir, "pages")))
    get = lambda name: F.element_at("headers", F.lit(name))
    return found.withColumn("headers", F.concat_ws("|", get("date"), get("content-length"), get("etag")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mix_sources, op2_scan_licenses, op3_decontaminate, op4_filter_urls, op5_count_tokens, op6_extract_text, op7_near_duplicates, op8_quality_rules, op9_classify_quality, op10_resolve_revisits)
}

#: DuckDB SQL for the queries whose method SQL can express; tests/llm holds the others against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": decontam.SCAN_SQL.format(docs="documents"),
    "op4_filter_urls": urls.SQL,
    "op7_near_duplicates": neardup.SQL,
    "op10_resolve_revisits": revisits.QUERY_SQL,
}
