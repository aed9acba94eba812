"""Quality classifier by importance resampling.

Tokens are words and runs of marks; their unigrams and bigrams are hashed into
``BUCKETS`` buckets (all immediate repeats of a token are one bigram). Two bag-of-n-grams models, one of target texts (labelled good
and not toxic) and one of all raw texts, give every document a log importance
weight: the mean over its n-grams of log p_target - log p_raw (a mean, as a sum lets
long texts fall for a slight imbalance of the labelled sample, such as a language it
has little of; ``SHRINK`` neutral n-grams are added, as few n-grams prove little). Documents are resampled without replacement by Gumbel top-k: the k
largest values of weight plus seeded Gumbel noise times ``NOISE``, the temperature.

k is not a guess: the weight at which labelled documents kept out of the target
model separate best (mean accuracy on good and bad) is the cut, and k is the number
of documents at or above it.

``drawn`` is the plain form of the method, for drawing a corpus of a given size: the weight is the
whole log ratio (the sum over the n-grams), the noise has temperature 1, and k is given, or the share
of good documents among the labelled ones. The k documents so drawn are a sample without
replacement in proportion to the ratio of the two models.

The raw model counts every document. The target model is fitted on a bounded
sample, the ``MAX_LABELLED`` labelled rows with the smallest seeded hash; that table
alone is broadcast. Models are arrays of BUCKETS numbers.

Defined results: NULL, empty and tokenless texts weigh 0; without target
labels all weights are 0, and without labels of both classes to calibrate on
every document is kept; equal keys at the cut are all kept; repeated labels of a
document count once, and a label that says bad outweighs one that says good.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtrack.llm import arrays as A
from tagtrack.llm.common import free_name, saved

BUCKETS, SMOOTHING, MAX_LABELLED, HELD_OUT, BINS = 8192, 1.0, 40_000, 4, 4096
NOISE, SEED, SHRINK = 0.005, 41, 32
#: the bigram of a token that repeats the one before it, whatever the token
REPEAT = np.uint64(0x5EED)


@dataclass
class QualityModel:
    log_ratio: np.ndarray

    def weights(self, texts: pa.Array) -> list[pa.Array]:
        """Numbers of tokens and log weights of a batch of texts."""
        tokens, weights = [], []
        for _, data, starts in A.chunks(texts):
            grams, owner, bounds = _buckets(data, starts)
            n = len(starts) - 1
            total = np.bincount(owner, self.log_ratio[grams], n)
            weights.append(total / (np.bincount(owner, minlength=n) + SHRINK))
            tokens.append(np.diff(bounds))
        if not tokens:
            return [pa.array([], pa.int64()), pa.array([], pa.float64())]
        return [pa.array(np.concatenate(tokens).astype(np.int64)), pa.array(np.concatenate(weights))]


def _buckets(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every unigram and bigram, and the bounds of each text's tokens."""
    h, bounds = A.token_hashes(data, starts, A.MARKED)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(bounds))
    pairs = A.mix(h[:-1] * A.RADIX + h[1:]) if len(h) else h
    pairs[h[:-1] == h[1:]] = REPEAT
    same = owner[:-1] == owner[1:] if len(h) else owner.astype(bool)
    grams = np.concatenate([h, pairs[same]]) % np.uint64(BUCKETS)
    return grams.astype(np.int64), np.concatenate([owner, owner[:-1][same] if len(h) else owner]), bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task one row for each bucket it saw: n-grams of all texts and of target texts."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        chosen = np.array(batch.column(1).to_pylist(), bool)
        for row, data, starts in A.chunks(batch.column(0)):
            grams, owner, _ = _buckets(data, starts)
            raw += np.bincount(grams, minlength=BUCKETS)
            target += np.bincount(grams[chosen[row + owner]], minlength=BUCKETS)
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], ["bucket", "raw", "target"])


def labelled(labels: DataFrame, seed: int = SEED, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, good, held: a bounded sample of labelled documents; ``held`` ones calibrate, the others fit."""
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    rows = rows.where("quality = 0 OR toxic = 0").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(limit)
    held = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(HELD_OUT)) == 0
    return rows.select("doc_id", (F.col("quality") == 1).alias("good"), held.alias("held"))


def fit(docs: DataFrame, sample: DataFrame) -> QualityModel:
    """Log ratios of the target and the raw model, from all documents."""
    target = sample.where("good AND NOT held").select(F.col("doc_id").alias("_id"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(target), rows["doc_id"] == target["_id"], "left")
    rows = rows.select("text", F.col("_id").isNotNull().alias("target"))
    counts = A.mapped(rows, _count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in counts.collect():
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return QualityModel(np.zeros(BUCKETS))
    p, q = (target + SMOOTHING) / (target + SMOOTHING).sum(), (raw + SMOOTHING) / (raw + SMOOTHING).sum()
    return QualityModel(np.log(p / q))


def scored(docs: DataFrame, model: QualityModel, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_tokens and log_weight."""
    return A.with_columns(docs, "text", model.weights, "n_tokens bigint, log_weight double", keep_text)


def gumbel(*columns: str | Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise, the same for the same row."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 2), *columns), 11) + 0.5) / float(1 << 53)
    return -F.ln(-F.ln(u))


def best_cut(scores: DataFrame) -> float:
    """The weight with the best mean accuracy on (good, log_weight) rows, between the classes; -inf without both."""
    low, high, good, n = scores.agg(
        F.min("log_weight"), F.max("log_weight"), F.sum(F.col("good").cast("long")), F.count(F.lit(1))
    ).first()
    if not n or good in (0, n):
        return -math.inf
    bad = n - good
    width = max(high - low, 1e-9) / BINS
    number = F.least(F.floor((F.col("log_weight") - low) / width), F.lit(BINS - 1)).alias("b")
    bins = sorted(
        scores.groupBy(number).agg(F.sum(F.col("good").cast("long")), F.sum((~F.col("good")).cast("long"))).collect()
    )
    below_good, below_bad, best, cuts = 0, 0, -1.0, [low]
    for b, g, x in bins:
        now = (good - below_good) / good + below_bad / bad
        if now > best + 1e-12:
            best, cuts = now, [low + b * width]
        elif now > best - 1e-12:
            cuts.append(low + b * width)
        below_good, below_bad = below_good + g, below_bad + x
    return cuts[0]


def kth_largest(values: DataFrame, column: str, k: int, few: int = 10_000) -> float:
    """The k-th largest value (from 1) by counts per bin, finer and finer; the driver sees bins and ``few`` values."""
    x = F.col(column)
    low, high, n = values.agg(F.min(x), F.max(x), F.count(x)).first()
    if not n or k >= n:
        return -math.inf
    if k <= 0:
        return math.inf
    above = 0  # values over the present range
    while True:
        width = (high - low) / BINS
        part = values.where((x >= low) & (x <= high))
        if n <= few or width <= abs(high) * 1e-15:
            rows = part.select(x).orderBy(x.desc()).limit(k - above).collect() if n <= few else [(low,)]
            return rows[-1][0]
        number = F.least(F.floor((x - low) / width), F.lit(BINS - 1)).alias("b")
        for b, c in sorted(part.groupBy(number).count().collect(), reverse=True):
            if above + c >= k:
                break
            above += c
        bound = part.where(number == b).agg(F.min(x), F.max(x), F.count(x)).first()
        if bound[2] == n:
            return bound[0] if bound[0] == bound[1] else kth_largest(part, column, k - above, n)
        low, high, n = bound


def resampled(docs: DataFrame, labels: DataFrame, noise: float = NOISE, seed: int = SEED) -> tuple[DataFrame, QualityModel, float]:
    """A row per document: doc_id, n_tokens, log_weight, key, log_ratio, draw_key, kept; with the model and the key's cut."""
    sample = labelled(labels, seed)
    model = fit(docs, sample)
    rows = scored(docs.select("doc_id", "text", gumbel("doc_id", "text", seed=seed).alias("draw")), model, False)
    draw = F.col("draw")
    grams = F.greatest(2 * F.col("n_tokens") - 1, F.lit(0)) + SHRINK
    rows = rows.withColumn("key", F.col("log_weight") + F.lit(noise) * draw).withColumn("log_ratio", F.col("log_weight") * grams)
    rows = saved(rows.withColumn("draw_key", F.col("log_ratio") + draw).drop("draw"), "quality")
    held = rows.join(F.broadcast(sample.where("held").drop("held")), "doc_id").select("good", "log_weight")
    cut = best_cut(held)
    k = rows.where(F.col("log_weight") >= F.lit(cut)).count()
    at = kth_largest(rows, "key", k)
    return rows.withColumn("kept", F.col("key") >= F.lit(at)), model, at


def drawn(rows: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of ``resampled`` with ``drawn``: among the ``k`` with the largest log ratio plus Gumbel noise.

    Without ``k`` the share of good documents among the labelled ones is drawn; without labels every row is. Equal keys
    at the cut are all drawn; k of no rows or less draws none.
    """
    if k is None:
        good, n = labelled(labels, seed).agg(F.sum(F.col("good").cast("long")), F.count(F.lit(1))).first()
        k = round(rows.count() * (good / n if n else 1.0))
    return rows.withColumn("drawn", F.col("draw_key") >= F.lit(kth_largest(rows, "draw_key", k)))


def filtered(docs: DataFrame, labels: DataFrame, noise: float = NOISE, seed: int = SEED) -> DataFrame:
    """The resampled documents with all their columns; texts are scored again rather than shuffled."""
    _, model, at = resampled(docs, labels, noise, seed)
    noisy = free_name(docs, "_noise")
    rows = docs.withColumn(noisy, F.lit(noise) * gumbel("doc_id", "text", seed=seed))
    rows = scored(rows, model).where(F.col("log_weight") + F.col(noisy) >= F.lit(at))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
