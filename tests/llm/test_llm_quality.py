"""Quality classifier: models by brute force, held-out accuracy, exact cuts, defined results."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagtrack.llm import arrays as A
from tagtrack.llm import quality as Q

SF = "/root/testdata/sf0.01"
TEXTS = ["Hello, World!! hello", "", "a a a b", "ÉTÉ été x_1 -- ok\tok\n", "one", "  ", "!!", "x" * 3_000_000 + " y"]


def brute_tokens(text):
    low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[0-9a-z_\u0080-\U0010FFFF]+|[^0-9a-z_\u0080-\U0010FFFF\x09-\x0D ]+", low)


def test_tokens_are_hashed_alike_exactly_if_equal():
    seen: dict[int, str] = {}
    hashes: dict[str, int] = {}
    row = 0
    for first, data, starts in A.chunks(pa.array(TEXTS)):
        h, bounds = A.token_hashes(data, starts, A.MARKED)
        for i in range(len(starts) - 1):
            tokens = brute_tokens(TEXTS[first + i])
            mine = h[bounds[i] : bounds[i + 1]].tolist()
            assert len(mine) == len(tokens)
            for t, x in zip(tokens, mine):
                assert seen.setdefault(x, t) == t and hashes.setdefault(t, x) == x
            row += 1
    assert row == len(TEXTS)


def test_model_counts(spark):
    texts = ["good words here", "good words there", "bad!! bad!! bad!!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sample = spark.createDataFrame([(0, True, False), (1, True, False), (2, False, False)], "doc_id long, good boolean, held boolean")
    model = Q.fit(docs, sample)

    def grams(text):
        (_, data, starts), = A.chunks(pa.array([text]))
        return Counter(Q._buckets(data, starts)[0].tolist())

    raw = sum((grams(t) for t in texts), Counter())
    target = sum((grams(t) for t in texts[:2]), Counter())
    s = Q.SMOOTHING
    for b in raw:
        p = (target[b] + s) / (sum(target.values()) + s * Q.BUCKETS)
        q = (raw[b] + s) / (sum(raw.values()) + s * Q.BUCKETS)
        assert model.log_ratio[b] == pytest.approx(math.log(p / q))
    total = sum(model.log_ratio[b] * n for b, n in grams(texts[0]).items())
    assert model.weights(pa.array(texts[:1]))[1][0].as_py() == pytest.approx(total / (sum(grams(texts[0]).values()) + Q.SHRINK))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0)
    rows, _, _ = Q.resampled(docs, known)
    fresh = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).join(rows, "doc_id").collect()
    good = [r.kept for r in fresh if r.quality == 1]
    bad = [r.kept for r in fresh if r.quality == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.1


def test_filter_keeps_the_resampled(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows, _, _ = Q.resampled(docs, labels)
    out = Q.filtered(docs, labels)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in rows.where("kept").collect())


@pytest.mark.parametrize("values,k", [([1.0, 2.0, 3.0, 3.0, 5.0], 2), ([0.0] * 50, 7), ([float(i % 17) + 1e-9 * i for i in range(999)], 500), ([1e-300, 1.0], 1)])
@pytest.mark.parametrize("few", [10_000, 3])
def test_kth_largest(spark, values, k, few):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert Q.kth_largest(df, "x", k, few) == sorted(values, reverse=True)[k - 1]
    assert Q.kth_largest(df, "x", len(values), few) == -math.inf
    assert Q.kth_largest(df, "x", 0, few) == math.inf


def test_gumbel_top_k_follows_the_weights(spark):
    rows = spark.range(40_000).select("id", F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.0).alias("w"))
    rows = rows.withColumn("key", F.col("w") + Q.gumbel("id")).cache()
    at = Q.kth_largest(rows, "key", 1000)
    top = rows.where(F.col("key") >= F.lit(at)).groupBy("w").count().collect()
    share = {r.w: r["count"] for r in top}
    assert share[1.0] + share[0.0] == 1000
    assert share[1.0] / share[0.0] == pytest.approx(math.e, rel=0.2)
    assert rows.agg(F.avg(F.col("key") - F.col("w"))).first()[0] == pytest.approx(np.euler_gamma, abs=0.03)


def test_defined_results(spark):
    docs = [(1, None, "a", 0), (1, None, "a", 0), (2, "", None, 1), (3, " ", "b", None), (None, "words", "c", 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, _text string, c0 int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows, _, _ = Q.resampled(df, none)
    assert [(r.log_weight, r.kept) for r in rows.collect()] == [(0.0, True)] * 5
    out = Q.filtered(df, none)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(docs, key=repr)
    some = spark.createDataFrame([(1, 1, None), (2, 0, 1), (2, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.good for r in Q.labelled(some).collect()} == {1: True, 2: False}
    assert Q.resampled(df.limit(0), some)[0].count() == 0


def test_drawn_follows_the_whole_ratio_of_the_models(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows, model, _ = Q.resampled(docs, labels)
    known = Q.labelled(labels).collect()
    share = sum(r.good for r in known) / len(known)
    got = Q.drawn(rows, labels).collect()
    assert sum(r.drawn for r in got) == round(len(got) * share)
    assert min(r.draw_key for r in got if r.drawn) > max(r.draw_key for r in got if not r.drawn)
    texts = {r.doc_id: r.text for r in docs.limit(40).collect()}
    for r in got:
        if r.doc_id in texts:
            (_, data, starts), = A.chunks(pa.array([texts[r.doc_id]]))
            assert r.log_ratio == pytest.approx(model.log_ratio[Q._buckets(data, starts)[0]].sum(), abs=1e-6)
    noise = [r.draw_key - r.log_ratio for r in got]
    assert np.mean(noise) == pytest.approx(np.euler_gamma, abs=0.15) and np.std(noise) == pytest.approx(math.pi / 6**0.5, abs=0.15)
    few = Q.drawn(rows, labels, k=7).where("drawn").count()
    assert few == 7 and Q.drawn(rows, labels, k=0).where("drawn").count() == 0
    none = labels.limit(0)
    assert Q.drawn(Q.resampled(docs.limit(20), none)[0], none).where("drawn").count() == 20


def test_noise_decides_among_like_ratios(spark):
    """Rows with ratios 1 and e are drawn in that proportion; equal keys at the cut together."""
    rows = spark.range(20_000).select("id", (F.col("id") % 2).cast("double").alias("log_ratio"))
    rows = rows.withColumn("draw_key", F.col("log_ratio") + Q.gumbel("id")).cache()
    top = {r.log_ratio: r["count"] for r in Q.drawn(rows, None, k=600).where("drawn").groupBy("log_ratio").count().collect()}
    assert top[1.0] + top[0.0] == 600 and top[1.0] / top[0.0] == pytest.approx(math.e, rel=0.25)
    same = spark.range(5).select(F.lit(1.0).alias("draw_key"))
    assert Q.drawn(same, None, k=2).where("drawn").count() == 5
