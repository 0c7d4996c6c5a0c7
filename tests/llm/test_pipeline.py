"""The pipeline end to end on a small corpus with planted cases."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline as cp
from panelforge.llm import queries

DATA = Path("/root/testdata/sf0.001")


def planted(tmp_path):
    import pandas as pd

    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(["ba", "ke", "lo", "mi", "ru", "sta"], int(rng.integers(2, 5))))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, labels = [], []
    passage = prose(60)
    for k in range(200):
        text = prose(int(rng.integers(40, 200)))
        good = k % 5 != 0
        if not good:
            text = " ".join(w + "***" for w in text.split())
        rows.append([k, text])
        labels.append((k, int(good), 0))
    rows[1][1] += "\n" + passage
    rows[2][1] = prose(30) + "\n" + passage + "\n" + prose(30)
    rows.append([300, rows[3][1]])
    rows.append([301, rows[4][1] + " extra"])
    docs = pd.DataFrame(rows, columns=["doc_id", "text"]).assign(lang="en", source="s", n_chars=[len(t) for _, t in rows])
    docs.to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).to_parquet(tmp_path / "labels.parquet")
    return docs, passage


def test_stages(spark, tmp_path):
    docs, passage = planted(tmp_path)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = now.columns, {}
    for name, stage in cp.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = now.toPandas()
    assert all(list(kept[n].columns) == columns for n in ("quality", "near_dedup", "passage_dedup"))
    assert set(kept["quality"]["doc_id"]) == {k for k in docs["doc_id"] if k >= 300 or k % 5}
    assert set(kept["near_dedup"]["doc_id"]) == set(kept["quality"]["doc_id"]) - {300, 301}
    before, after = (kept[n].set_index("doc_id")["text"] for n in ("near_dedup", "passage_dedup"))
    assert passage in after[1] and passage not in after[2] and after[2].count("\n") == 1
    assert all(before[k] == after[k] for k in before.index if k != 2)
    assert (kept["passage_dedup"]["n_chars"] == kept["passage_dedup"]["text"].str.len()).all()
    assert set(kept["packing"]["doc_id"]) == set(after.index)


def test_run_equals_its_stages(spark, tmp_path):
    planted(tmp_path)
    got = cp.run(spark, str(tmp_path))
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES:
        now = stage(spark, now, str(tmp_path))
    strip = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert strip(got) == strip(now)


def test_nulls_repeats_and_empty_tables(spark, tmp_path):
    planted(tmp_path)
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    odd = spark.createDataFrame([(400, None), (401, ""), (402, " "), (None, "no id " * 30), (3, "again " * 5), (403, "lone")], "doc_id long, text string")
    more = odd.selectExpr("doc_id", "text", "cast(null as string) as lang", "'s' as source", "cast(length(text) as bigint) as n_chars")
    for n, rows in (("odd", docs.unionByName(more)), ("empty", docs.limit(0))):
        rows.write.parquet(f"{tmp_path}/{n}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{n}/labels.parquet")
    assert cp.run(spark, f"{tmp_path}/empty").count() == 0
    now = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for name, stage in cp.STAGES[1:]:
        stage(spark, now, f"{tmp_path}/odd").write.parquet(f"{tmp_path}/odd/{name}")
        now = spark.read.parquet(f"{tmp_path}/odd/{name}")
        if name == "near_dedup":  # null, empty and blank texts are one group
            ids = {r["doc_id"] for r in now.collect()}
            assert 400 in ids and not {401, 402} & ids and {None, 3, 403} <= ids
    assert {400, 403, None} <= {r["doc_id"] for r in now.collect()}


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
def test_sql_of_the_url_filter(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    df = queries.queries()["op10_temporal_url_filter"](spark, str(DATA))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()['op10_temporal_url_filter']}) AS q").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
