"""The subpackage's queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, licenses, mixing, ngram_join, pieces, quality, secrets, toxicity, url_filter, warc
from .common import table


def _over(query, *names: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(spark, *(table(spark, sf_dir, n) for n in names))

    return run


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_secret_scan": _over(secrets.query, "documents"),
    "op2_quality_rules": _over(quality.query, "documents"),
    "op3_toxicity": _over(toxicity.query, "documents", "labels"),
    "op4_nearest_neighbours": _over(ann.query, "embeddings"),
    "op5_warc": _over(warc.query, "pages"),
    "op6_url_filter": _over(url_filter.query, "pages"),
    "op7_mixing": _over(mixing.query, "documents"),
    "op8_license_scan": _over(licenses.query, "documents"),
    "op9_ngram_join": _over(ngram_join.query, "documents"),
    "op10_sentencepiece": _over(pieces.query, "documents"),
    "pipeline": _pipeline,
}
SQL = {"op1_secret_scan": secrets.SQL, "op5_warc": warc.SQL, "op6_url_filter": url_filter.SQL}
