"""License scans, the URL filter, the quality classifier."""

from __future__ import annotations

import datetime as dt
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import licenses, quality, url_filter


DATA = Path("/root/testdata/sf0.01")


def slow_matches(text: str, name: str):
    """Best common subsequences of a template with any stretch of a text's words, without a band."""
    words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text.encode())]
    want = [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", licenses.TEMPLATES[name].encode())]
    best = (0, 0, 0)
    for a in range(len(words)):
        row = [0] * (len(want) + 1)
        for b in range(a, min(len(words), a + len(want) + 4)):
            fresh = [0]
            for j, w in enumerate(want):
                fresh.append(max(row[j + 1], fresh[j], row[j] + (words[b][2] == w)))
            row = fresh
            if row[-1] > best[0] or (row[-1] == best[0] and words[b][1] - words[a][0] < best[2] - best[1]):
                best = (row[-1], words[a][0], words[b][1])
    return best, len(want)


CASES = [
    ("Some text.\nReleased under the MIT License.\nMore.", "MIT"),
    ("é Licensed   under CC BY-NC 4.0. end", "CC-BY-NC-4.0"),
    ("x This work is licensed under the new GNU General Public License, version 3. y", "GPL-3.0"),
    ("All rights reserved", "all-rights-reserved"),
    (licenses.TEMPLATES["MIT-grant"].replace("publish, ", "").replace("merge", "combine").upper(), "MIT-grant"),
    ("z " * 50 + licenses.TEMPLATES["Apache-2.0-header"].replace("specific language", "language"), "Apache-2.0-header"),
]


@pytest.mark.parametrize(("text", "name"), CASES)
def test_matches_against_whole_alignment(spark, text, name):
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).where(F.col("license") == name).collect()
    (matched, first, last), size = slow_matches(text, name)
    assert [(r["matched_words"], r["template_words"], r["first_byte"], r["last_byte"]) for r in got] == [(matched, size, first, last)]
    assert got[0]["coverage"] == matched / size >= 0.8


@pytest.mark.parametrize("more", [6, 10, 20, 60])
def test_words_put_into_a_notice(spark, more):
    words = licenses.TEMPLATES["MIT-grant"].split()
    extra = [f"e{k}" for k in range(more)]
    text = " ".join(["x"] * 30 + words[:40] + extra + words[40:] + ["y"] * 30)
    shorter = " ".join(words[:40] + words[46:])
    got = licenses.scan(spark.createDataFrame([(1, text), (2, shorter)], "doc_id long, text string")).where("license = 'MIT-grant'").orderBy("doc_id").collect()
    n = len(re.findall(r"[0-9A-Za-z]+", licenses.TEMPLATES["MIT-grant"]))
    assert got[0]["matched_words"] == n == got[0]["template_words"] and text[got[0]["first_byte"] :].startswith("Permission") and text[: got[0]["last_byte"]].endswith("Software")
    assert n - 14 <= got[1]["matched_words"] < n


def test_rivals_and_versions(spark):
    t = licenses.TEMPLATES
    texts = ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the Apache License, Version 1.0.", t["GPL-2.0-header"], t["LGPL-2.1-header"], t["AGPL-3.0-header"], t["ISC"], t["BSD-3-Clause"], t["CC-BY-SA-4.0"]]
    got: dict[int, set] = {}
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert got == {0: {"GPL-2.0"}, 2: {"GPL-2.0-header"}, 3: {"LGPL-2.1-header"}, 4: {"AGPL-3.0-header"}, 5: {"ISC"}, 6: {"BSD-3-Clause", "BSD-2-Clause-conditions"}, 7: {"CC-BY-SA-4.0"}}


def test_each_template_is_found_whole(spark):
    rows = list(enumerate(licenses.TEMPLATES.values()))
    got = {(r["doc_id"], r["license"]): r["coverage"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(rows) >= 25 and all(got[k, name] == 1 for k, name in enumerate(licenses.TEMPLATES))


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
def test_notices_of_the_documents_are_all_found(spark):
    """Wherever all words of a template stand in a row, a match covers them: recall against a search of every place."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got: dict[tuple, list] = {}
    for r in licenses.scan(docs).collect():
        got.setdefault((r["doc_id"], r["license"]), []).append((r["first_byte"], r["last_byte"]))
    plain = {name: re.compile(rb"(?<![0-9A-Za-z\x80-\xff])" + rb"[^0-9A-Za-z\x80-\xff]+".join(map(re.escape, re.findall(rb"[0-9A-Za-z\x80-\xff]+", t.encode()))) + rb"(?![0-9A-Za-z\x80-\xff])", re.IGNORECASE) for name, t in licenses.TEMPLATES.items()}
    planted = [(r["doc_id"], name, m.span()) for r in docs.collect() for name, p in plain.items() for m in p.finditer((r["text"] or "").encode())]
    assert len(planted) > 5 and all(span in got.get((d, name), []) for d, name, span in planted)


def test_no_false_match_and_two_matches(spark):
    rows = [(1, "released by the license of MIT"), (2, "Released under the MIT License. " * 2), (3, "rights all reserved"), (2, "Released under the MIT License. " * 2)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["license"], r["first_byte"]) for r in got) == [(2, "MIT", 0), (2, "MIT", 0), (2, "MIT", 32), (2, "MIT", 32)]


def test_notices_in_a_row_are_all_found(spark):
    text = "All rights reserved. " * 5 + "Licensed under CC BY-NC 4.0. " * 3
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sorted(r["first_byte"] for r in got if r["license"] == "all-rights-reserved") == [21 * k for k in range(5)]
    assert sum(r["license"] == "CC-BY-NC-4.0" for r in got) == 3


def test_winnowing_keeps_one_of_each_window():
    h = np.random.default_rng(0).integers(0, 1 << 63, 200, dtype=np.uint64)
    kept = set(licenses.winnow(h, 4).tolist())
    assert all(kept & set(range(k, k + 4)) for k in range(197)) and len(kept) < 120


def slow_filter(url, day, entries):
    if not url or day is None:
        return None, None, "none"
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", url.strip())
    host = re.sub(r"\.$", "", re.sub(r":[0-9]*$", "", re.sub(r"^.*@", "", re.sub(r"[/?#].*$", "", rest).lower())))
    path = re.sub(r"^[^/]*", "", re.sub(r"[?#].*$", "", rest)) or "/"
    if not host:
        return None, None, "none"
    labels, steps = host.split("."), path.split("/")
    keys = {".".join(labels[k:]) for k in range(max(1, len(labels) - 1))} | {host + "/".join(steps[:k]) + "/" for k in range(1, len(steps))} | {host + path}
    best = None
    for p in keys:
        past = [(d, url_filter.ACTIONS.index(a)) for q, d, a in entries if q == p and d <= day]
        if past and max(past)[1] > 0:
            best = max(best or (0, "", None, 0), (len(p), p, *max(past)))
    return (best[1], best[2], url_filter.ACTIONS[best[3]]) if best else (None, None, "none")


def test_filter_against_every_entry(spark):
    rng = np.random.default_rng(1)
    start = dt.date(2024, 1, 1)
    patterns = ["example.com", "a.example.com", "a.example.com/x/", "a.example.com/x/y.html", "b.org", "b.org/", "com"]
    entries = [(str(rng.choice(patterns)), start + dt.timedelta(int(rng.integers(200))), str(rng.choice(url_filter.ACTIONS))) for _ in range(60)]
    entries += entries[:3]
    urls = ["http://a.example.com/x/y.html?q=1", "https://u:p@A.Example.com:8080/x/", "a.example.com", "http://www.b.org/#z", "b.org/x/y/z", "//odd", "", None, "http://localhost/", "http://example.com./"]
    captures = [(k, urls[int(rng.integers(len(urls)))], start + dt.timedelta(int(rng.integers(220)))) for k in range(200)]
    captures += [captures[0], (900, urls[0], None)]
    e = spark.createDataFrame([*entries, (None, start, "block"), ("b.org", None, "block"), ("b.org", start, "huh")], "pattern string, listed_on date, action string")
    c = spark.createDataFrame([(*r, 1, 2) for r in captures], "page_id long, url string, fetched_on date, pattern int, month int")
    got = sorted(((r["page_id"], str(r["fetched_on"]), r["pattern"], r["listed_on"], r["action"], r["blocked"]) for r in url_filter.temporal_filter(c, e).collect()), key=str)
    want = sorted(((i, str(d), *(x := slow_filter(u, d, entries)), x[2] == "block") for i, u, d in captures), key=str)
    assert got == want and any(r[5] for r in want)
    assert url_filter.temporal_filter(c, e.limit(0)).where("action <> 'none'").count() == 0
    assert url_filter.temporal_filter(c, e.limit(0)).count() == len(captures)
    assert url_filter.temporal_filter(c.limit(0), e).count() == 0


def test_filter_keeps_the_case_of_paths(spark):
    day = dt.date(2024, 1, 1)
    listed = ["A.Example.com/Docs/Page.HTML", "B.org/Docs/", "C.ORG", "d.org/docs/"]
    urls = ["http://a.example.COM/Docs/Page.HTML", "b.org/Docs/x", "c.org/X", "d.org/Docs/x"]
    e = spark.createDataFrame([(p, day, "block") for p in listed], "pattern string, listed_on date, action string")
    c = spark.createDataFrame([(k, u, day) for k, u in enumerate(urls)], "page_id long, url string, fetched_on date")
    got = {r["page_id"]: r["pattern"] for r in url_filter.temporal_filter(c, e).collect()}
    assert got == {0: "a.example.com/Docs/Page.HTML", 1: "b.org/Docs/", 2: "c.org", 3: None}


def test_filter_takes_very_long_urls_and_one_host(spark):
    """100 KB of folders, of one segment, of labels; and all captures of one host in one month."""
    day = dt.date(2024, 1, 3)
    deep, wide, labels = "a.org" + "/ab" * 34_000, "a.org/" + "x" * 100_000, "c" + ".c" * 50_000 + ".net"
    listed = [("a.org/ab/ab/", "allow"), ("c.net", "block"), (deep[:3005] + "/", "block"), (wide, "block")]
    e = spark.createDataFrame([(p, day, a) for p, a in listed], "pattern string, listed_on date, action string")
    rows = [(0, deep, day), (1, wide, day), (2, labels, day), (3, "a.org/ab/", day)] + [(k, f"http://a.org/ab/ab/{k}", day + dt.timedelta(k % 20)) for k in range(10, 3000)]
    c = spark.createDataFrame(rows, "page_id long, url string, fetched_on date")
    got = {r["page_id"]: r["pattern"] for r in url_filter.temporal_filter(c, e).collect()}
    assert len(got) == len(rows) and (got[0], got[1], got[2], got[3]) == (deep[:3005] + "/", wide, "c.net", None)
    assert all(got[k] == "a.org/ab/ab/" for k in range(10, 3000))


def test_filter_runs_no_python(spark):
    e = spark.createDataFrame([("b.org", dt.date(2024, 1, 1), "block")], "pattern string, listed_on date, action string")
    c = spark.createDataFrame([(1, "b.org", dt.date(2024, 1, 1))], "page_id long, url string, fetched_on date")
    plan = url_filter.temporal_filter(c, e)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def training(spark, n=400):
    rng = np.random.default_rng(3)
    plain = [f"{a}{b}" for a in ("re", "un", "mo", "ta", "li") for b in ("low", "ver", "ning", "ster", "ble")]
    rows, labels = [], []
    for k in range(n):
        words = rng.choice(plain, int(rng.integers(20, 120))).tolist()
        bad = k % 4 == 0
        if bad:
            words = [w + "###" for w in words] if k % 8 else [w.upper() + "!!" for w in words[:10]] * 5
        rows.append((k, " ".join(words)))
        labels.append((k, int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = training(spark)
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert len(held) > 50 and np.mean(held) > 0.97


def test_held_out_labels_are_not_seen(spark):
    docs, labels, _ = training(spark, 120)
    flipped = labels.withColumn("quality", F.when(quality.fold() == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert (a.weights == b.weights).all() and (a.a, a.b) == (b.a, b.b)


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 3))
    y = np.where(x @ [1.0, -2.0, 0.5] + 0.3 * rng.standard_normal(60) > 0, 1.0, -1.0)
    rows, values = [np.arange(3)] * 60, list(x)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()

    w, b = quality.descend(rows, values, y, np.ones(60), 3, 500, 1)
    best = loss(w, b)
    for _ in range(300):
        assert best <= loss(w + 0.05 * rng.standard_normal(3), b + 0.05 * rng.standard_normal()) + 1e-3
