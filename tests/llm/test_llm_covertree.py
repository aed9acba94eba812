"""Hard negatives against brute force over all rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagtrack.llm import covertree as C

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=10):
    use = [(i, [math.floor(256 * x) for x in np.float32(v).astype(float)], (la + 1) % 10 if i % 7 == 0 else la)
           for i, v, la in rows
           if i is not None and la is not None and v is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, v, la) in enumerate(use):
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, lb) for n, (j, w, lb) in enumerate(use) if n != k and len(w) == len(v))
        for ps, j, lb in [s for s in scored if s[2] == la][:positives]:
            fits = [s for s in scored if s[2] != la and -30 * ps <= -100 * s[0] <= -90 * ps][:negatives]
            out += [(i, j, r + 1, n, -ps, -ns) for r, (ns, n, _) in enumerate(fits)]
    return sorted(out)


def got(df):
    i = F.col("vec_id")
    label = F.when(i % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    x = F.transform("embedding", lambda x: C.steps(x))
    rows = C.mined(df, "vec_id", label, x, i % 100 == 0).collect()
    names = "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    return sorted(tuple(r[n] for n in names) for r in rows)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("vec_id < 1200")
    want = brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    assert len(want) > 300 and got(df) == want


@pytest.mark.parametrize("small", [False, True])
def test_copies_and_norms(spark, monkeypatch, small):
    """Groups of copies of several labels, rows of many lengths, ties; also with several strips and groups of queries."""
    if small:
        for name, value in (("TREE", 64), ("GROUP", 2), ("OPEN", 4), ("LEAF", 3)):
            monkeypatch.setattr(C, name, value)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 16)) * rng.uniform(0.1, 3, size=(500, 1))
    x[50:250] = x[0] + rng.normal(size=(200, 16)) * 0.05
    x[250:300] = x[100]
    x[300] = 0
    rows = [(int(i) * 4, [float(a) for a in v], int(rng.integers(0, 3))) for i, v in zip(rng.permutation(500), x)]
    want = brute(rows)
    assert len(want) > 300 and got(spark.createDataFrame(rows, SCHEMA)) == want


def test_tree_covers_and_bounds():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 5))
    x[:150] = x[0] + rng.normal(size=(150, 5)) * 0.01
    y, m = C.lifted(x)
    assert np.allclose(np.linalg.norm(y, axis=1), 1)
    order, split = C.planted(y)
    assert sorted(order.tolist()) == list(range(400)) and split[0] == 0
    t = pd.DataFrame({"id": order, "label": 0, "r": order, "x": list(x[order]), "split": split})
    forest = C.Forest.of([t])
    for level in range(len(C.SCALES)):  # within the scale of the centre, centres of one parent further apart
        starts = np.flatnonzero(split <= level + 1)
        for a, b in zip(starts, np.append(starts[1:], 400)):
            if a + 1 < b and split[a + 1 : b].min() <= len(C.SCALES):
                assert np.arccos(np.clip(y[order[a:b]] @ y[order[a]], -1, 1)).max() <= C.SCALES[level] + 1e-7
    q = rng.normal(size=5)
    scores = forest.x @ q
    m = np.linalg.norm(x, axis=1).max() * np.linalg.norm(q)
    for a, b, r in zip(forest.start, forest.end, forest.radius):
        phi = math.acos(np.clip(forest.lifted[a, :-1] @ q / np.linalg.norm(q), -1, 1))
        assert scores[a:b].max() <= m * (math.cos(max(phi - r, 0)) + C.SLACK)
        assert scores[a:b].min() >= m * (math.cos(min(phi + r, math.pi)) - C.SLACK)


def test_descent_skips_what_is_outside_the_window():
    """A tight group above the window is not opened."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:1000] = x[0] + rng.normal(size=(1000, 16)) * 0.005
    order, split = C.planted(C.lifted(x)[0])
    forest = C.Forest.of([pd.DataFrame({"id": order, "label": 0, "r": order, "x": list(x[order]), "split": split})])
    asked = []

    class Seen(np.ndarray):
        def __getitem__(self, at):
            asked.append(np.size(at))
            return np.asarray(super().__getitem__(at))

    forest.x = forest.x.view(Seen)
    (scores, ids), = forest.best(x[0], 1, -1, False, np.array([0.0]), np.array([0.9]), 10)
    s = x @ x[0]
    want = sorted((-v, i) for i, v in enumerate(s.tolist()) if v <= 0.9)[:10]
    assert ids.tolist() == [i for _, i in want] and np.allclose(scores, [-v for v, _ in want])
    assert sum(asked) < 600


NAN, INF = float("nan"), float("inf")


def test_defined_results(spark):
    edges = [(0, None, 1), (100, [1.0, 2.0], None), (200, [NAN, 1.0], 1), (300, [INF, 1.0], 1), (400, [1.0, None], 1), (500, [], 1),
             (None, [1.0, 1.0], 1), (600, [1.0, 1.0], 1), (600, [1.0, 1.0], 1), (5, [1.0, 0.5], 2), (6, [0.5, 0.5], 2), (7, [-1.0, 0.0], 1),
             (700, [1.0], 1), (8, [1.0], 2), (9, [2.0], 1), (10, [1.0, 1.0], 2), (11, [0.0, 0.0], 1), (12, [0.0, 0.0], 2)]
    df = spark.createDataFrame([(*e, "z", 1) for e in edges], SCHEMA + ", x string, r int")
    want = brute(edges)
    assert want and got(df) == want
    assert got(df.limit(0)) == [] and got(df.where("vec_id = 600").limit(1)) == []
