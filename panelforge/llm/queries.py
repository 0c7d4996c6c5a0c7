"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe_columns, licenses, media, packing, quality, repeats, simhash, token_counts, url_filter
from .common import table

#: Places of the public vocabularies; another folder is another parameter.
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_columns.round_trip(table(spark, sf_dir, "documents"), MULTI_RANKS)


def op3_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), simhash.Plan())
    return found.select("doc_id", F.lower(F.hex("print")).alias("fingerprint"), "component_id")


def op5_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), BYTE_JSON)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_fm_index_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(table(spark, sf_dir, "documents"))


def op10_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.temporal_filter(url_filter.sample_captures(pages), url_filter.sample_entries(pages))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_media_ogg, op2_byte_bpe, op3_rp_forest, op4_simhash_anchors, op5_prefix_token_counts, op6_best_fit_packing, op7_license_scan, op8_quality_nbsvm, op9_fm_index_repeats, op10_temporal_url_filter)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op10_temporal_url_filter": url_filter.ORACLE_SQL}
