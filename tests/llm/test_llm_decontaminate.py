"""Benchmark decontamination against a brute-force scan."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tagtrack.llm import decontaminate as D

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, width=10):
    grams = {}
    for item, text in items:
        w = words(text)
        for s in range(max(len(w) - width + 1, 1) if w else 0):
            grams.setdefault(tuple(w[s : s + width]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for s in range(len(w) - n + 1):
                if (g := tuple(w[s : s + n])) in grams:
                    hit |= set(range(s, s + n))
                    found |= {i for i in grams[g] if i is not None}
        out.append((doc, len(w), len(hit), sorted(map(str, found)), bool(hit)))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in df.collect()), key=repr)


TEN = "one two three four five six seven eight nine ten"
DOCS = [
    (1, f"Start. {TEN.upper()}, eleven twelve end"),
    (2, "one two three four five six seven eight nine"),
    (3, None),
    (4, ""),
    (5, "..."),
    (6, "ÉCOLE one-word-item and É"),
    (7, "école"),
    (None, TEN),
    (9, TEN + " " + TEN),
    (9, TEN + " " + TEN),
    (10, "K two"),
    (11, "alpha beta"),
]
ITEMS = [(100, TEN + " eleven"), (3, "alpha, BETA"), (20, "É"), (20, "É"), (5, None), (6, ""), (7, "!!"), (None, "two three four")]


@pytest.mark.parametrize("limit,hashes", [(20_000, 1), (1, 1000), (1, 1)])
def test_edges(spark, limit, hashes):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in DOCS], "doc_id long, text string, hits int, key string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(D.contamination(docs, items, max_ngrams=limit, max_hashes=hashes)) == brute(DOCS, ITEMS)


def test_lookup_by_hash_shuffles_no_windows(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = D.contamination(docs, items, max_ngrams=10)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi, (hash" in plan and "rightHint=(strategy=broadcast)" in plan


@pytest.mark.parametrize("limit", [20_000, 10])
def test_given_tables(spark, limit):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = rows(D.contamination(docs, items, max_ngrams=limit))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == want and any(r[-1] for r in got)


@pytest.mark.parametrize("limit", [20_000, 10])
def test_documents_removed(spark, limit):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = D.decontaminated(docs, items, max_ngrams=limit)
    bad = {r.doc_id for r in D.contamination(docs, items).where("contaminated").collect()}
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - bad


def test_spans_removed(spark):
    docs = spark.createDataFrame([(1, f"Keep this. {TEN.title()}! And this."), (2, "Clean É text."), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, TEN)], "item_id long, text string")
    got = {r.doc_id: r.text for r in D.decontaminated(docs, items, mode="spans").collect()}
    assert got == {1: "Keep this! And this.", 2: "Clean É text.", 3: None} or got[1] == "Keep this And this."


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, TEN)], "doc_id long, text string")
    assert D.contamination(docs, items).count() == 0
    assert rows(D.contamination(some, items)) == [(1, 10, 0, [], False)]
    assert D.decontaminated(some, items).count() == 1


def test_long_text(spark):
    text = "filler word " * 100_000 + TEN
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("text", F.col("text"))
    got = D.contamination(docs, spark.createDataFrame([(1, TEN)], "item_id long, text string")).first()
    assert (got.n_words, got.n_hit) == (200_010, 10)


def test_query_digest(spark):
    from tagtrack.llm.queries import QUERIES

    rows_ = QUERIES["op9_decontaminate"](spark, SF).collect()
    assert all(len(r.items_sha256) == 64 for r in rows_)
    assert {r.items_sha256 for r in rows_ if not r.contaminated} == {hashlib.sha256(b"").hexdigest()}


@pytest.mark.parametrize("mode", ["documents", "spans"])
def test_same_result_at_any_benchmark_size(spark, mode):
    more = [(None, "clean without an id"), (9, "clean under a repeated id"), (12, f"Keep. {TEN.title()}! And É.")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in DOCS + more], "doc_id long, text string, hits int, key string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    small, large = (D.decontaminated(docs, items, mode=mode, max_ngrams=n) for n in (20_000, 1))
    assert large.columns == small.columns == docs.columns
    assert sorted(map(tuple, large.collect()), key=repr) == sorted(map(tuple, small.collect()), key=repr)
    assert {"clean without an id", "clean under a repeated id"} <= {r.text for r in large.collect()}
