"""Edge cases that every operator on texts gives a defined result for."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelforge.llm import bpe_columns, licenses, media, packing, quality, queries, repeats, simhash, token_counts

LONG = "Lorem ipsum dolor " * 20_000 + "x" * 100_000
ROWS = [(5, "one two three four"), (1, None), (2, ""), (3, " \t\n"), (4, "one two three four"), (6, LONG), (6, LONG), (None, "without an id"), (7, "Ünïcödé 漢字 😀\0 it's"), (8, LONG + " end")]
#: Names that the operators use themselves.
CLASHES = ["print", "rep", "anchor", "ids", "target", "chunk", "blob", "score", "rank", "length", "bucket", "n", "y", "features", "node", "component"]

OPERATORS = {
    "media": media.media_columns,
    "bpe": lambda d: bpe_columns.round_trip(d, queries.MULTI_RANKS),
    "bpe_ids": lambda d: bpe_columns.encode_column(d, queries.MULTI_RANKS),
    "simhash": simhash.near_duplicates,
    "near": lambda d: simhash.near_duplicates(d, simhash.near_plan()),
    "counts": lambda d: token_counts.token_counts(d, queries.PIECE_MODEL),
    "prefixes": lambda d: token_counts.store_prefixes(d, queries.PIECE_MODEL),
    "repeats": repeats.repeat_digests,
    "kept": repeats.remove_repeats,
}


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHES)))


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row(spark, docs, name):
    got = OPERATORS[name](docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in ROWS)
    by_id = {}
    for r in got:
        values = tuple(v for k, v in r.asDict().items() if k not in ("doc_id", "component_id"))
        assert by_id.setdefault(r["doc_id"], values) == values  # repeated rows alike
    if name not in ("repeats", "kept"):
        assert by_id[1] == by_id[2] and by_id[4] == by_id[5]
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_packing(spark, docs):
    got = packing.best_fit(docs, queries.BYTE_JSON).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in ROWS}
    assert [r["length"] for r in got if r["doc_id"] == 2] == [1]
    assert packing.best_fit(docs.limit(0), queries.BYTE_JSON).count() == 0


def test_licenses(spark, docs):
    assert licenses.scan(docs).count() == 0 and licenses.scan(docs.limit(0)).count() == 0


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (99, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert quality.score(docs, model).count() == len(ROWS)
    empty = quality.fit(docs.limit(0), labels.limit(0))
    assert quality.score(docs.limit(0), empty).count() == 0
    assert {r["score"] for r in quality.score(docs, empty).collect()} == {0.5}


def test_stages_keep_columns_and_rows_without_id(spark, docs):
    kept = simhash.drop_near_duplicates(docs, simhash.near_plan())
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert None in ids and 5 not in ids and 4 in ids and ids.count(6) == 2 and 8 not in ids
    cut = repeats.drop_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(ROWS)
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[1] is None and texts[3] == " \t\n" and texts[6] == LONG and texts[7] == ROWS[8][1] and len(texts[8]) < 200
    good = quality.keep_good(docs, quality.Model(*(__import__("numpy").zeros(quality.FEATURES),) * 2, 0.0, 0.0, 5.0))
    assert good.columns == docs.columns and good.count() == len(ROWS)
