"""A corpus pipeline: quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written as
Parquet and read again as the next one's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import common, packing, quality, queries, repeats, simhash

#: Words of a passage that is cut out where a smaller document has it, too.
PASSAGE = 50


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with all columns.

    Null texts count as empty, very long ones whole; of equal texts all stay or all go; an empty table stays empty.
    """
    return quality.keep_good(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near duplicates: five words a shingle, a similarity of 0.8 or more.

    Null, empty and blank texts are one group. Rows without id stay; rows that repeat an id stay or go together. An empty table stays empty.
    """
    return simhash.drop_near_duplicates(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of PASSAGE words or more that a smaller document has.

    Null texts stay null and empty ones empty, with their number of characters; a row without id is larger than all others. An empty
    table stays empty.
    """
    return repeats.drop_repeats(docs, PASSAGE).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences.

    Null and empty texts are one piece of one token; very long ones are cut; repeated rows are packed each; an empty table gives no rows.
    """
    return packing.best_fit(docs, queries.BYTE_JSON)


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("packing", pack)]

#: No stage can be written in SQL: a fitted model, fingerprints, an index and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what passes between them is written to the shared checkpoint folder.

    A stage's table goes as soon as the next one's is whole; the last is read by what is returned, and stays.
    """
    common.prepare(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            common.remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
