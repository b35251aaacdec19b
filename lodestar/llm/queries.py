"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import vectors

    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    return lm.score(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.read(warc.write(_table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.classes(_table(spark, sf_dir, "documents"), k=4, num=85)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_scan

    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urls

    pages = _table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.mine(pages, _table(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict")


def op10_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import binfmt

    return binfmt.read_ids(binfmt.write_ids(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_embedding_near_duplicates, op3_benchmark_decontamination, op4_quality_classifier, op5_lm_scoring, op6_warc, op7_ngram_jaccard_join, op8_secret_scans, op9_url_filters, op10_token_id_files)
}
ORACLE_SQL: dict[str, str] = {}
