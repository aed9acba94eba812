"""Near-duplicates among embeddings against brute force over all pairs."""

import math

import numpy as np
import pytest

from tagtrack.llm import capfilters as C

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, cosine=0.9):
    """(id, links, component, kept) per row; ids may repeat or be None."""
    fine = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    links = [[] for _ in rows]
    by_size = {}
    for k, (_, v) in enumerate(rows):
        if fine[k]:
            by_size.setdefault(len(v), []).append(k)
    for ks in by_size.values():
        x = np.array([rows[k][1] for k in ks], np.float32).astype(float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in zip(*np.nonzero(x @ x.T >= cosine)):
            if i != j:
                links[ks[i]].append(ks[j])
    label = list(range(len(rows)))
    for k in range(len(rows)):
        if label[k] == k:
            todo = [k]
            while todo:
                for o in links[todo.pop()]:
                    if label[o] == o and o != k:
                        label[o] = k
                        todo.append(o)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(label[k], []).append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        low = min((x for x in least[label[k]] if x is not None), default=None)
        out.append((i, len(links[k]), low, i == low))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def at_cosine(rng, x, cosine):
    z = rng.normal(size=x.shape)
    z -= (z @ x) * x / (x @ x)
    return cosine * x / np.linalg.norm(x) + math.sqrt(1 - cosine * cosine) * z / np.linalg.norm(z)


def table(seed, singles, families, d=64):
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=d) for _ in range(singles)]
    for members, low, high in families:
        base = rng.normal(size=d)
        out += [at_cosine(rng, base, rng.uniform(low, high)) for _ in range(members)]
    return [(int(i), [float(x) for x in np.float32(v)]) for i, v in enumerate(rng.permutation(np.array(out)))]


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert got(C.grouped(df)) == brute([(r.vec_id, r.embedding) for r in df.collect()])


@pytest.mark.parametrize("families", [[(300, 0.995, 0.999)], [(200, 0.96, 0.999), (150, 0.9, 0.99)], [(120, 0.93, 0.97)] * 3])
def test_families(spark, families):
    rows = table(2, 400, families)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert got(C.grouped(df)) == want and sum(r[1] for r in want) > 500


def test_blocks_count_like_whole_groups(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 40)
    monkeypatch.setattr(C, "CROWD", 8)
    rows = table(3, 200, [(150, 0.94, 0.99), (100, 0.955, 0.965)])
    assert got(C.grouped(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_crowded_filters_without_balls(spark, monkeypatch):
    """Filters that hold many vectors no pivot gathers are compared in blocks."""
    monkeypatch.setattr(C, "_balls", lambda posts, classes, cosine: None)
    monkeypatch.setattr(C, "CROWD", 8)
    monkeypatch.setattr(C, "BLOCK", 16)
    rows = table(4, 200, [(60, 0.94, 0.99)])
    assert got(C.grouped(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("n", [3_000, 10_000_000])  # two blocks, three blocks
def test_recall_at_the_threshold(n):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 64))
    y = np.array([at_cosine(rng, v, 0.9) for v in x])
    code = C.code_for(n, 64, 0.9)
    shared = np.zeros(len(x), int)
    lists = 0
    for (k, a, f), (_, b, g) in zip(C.decoded(C.unit_rows(x), code), C.decoded(C.unit_rows(y), code)):
        both = set(zip(a.tolist(), f.tolist())) & set(zip(b.tolist(), g.tolist()))
        lists += len(a)
        for r, _ in both:
            shared[r] += 1
    assert (shared == 0).mean() <= 0.002
    assert shared.mean() > 0.7 * C.SHARED[code.m]
    assert 0.7 < lists / len(x) / (C.cap(code.alpha, 64) * code.codes * code.words**code.m) < 1.4


def test_list_decoding_finds_all_directions():
    code = C.Code(10, 3, 6, 2, 0.4)
    x = C.unit_rows(np.random.default_rng(1).normal(size=(50, 10)))
    for k, rows, at in C.decoded(x, code):
        turn, words = code.book(k)
        want = set()
        for i in range(6):
            for j in range(6):
                for h in range(6):
                    f = turn @ np.concatenate([words[0][:, i], words[1][:, j], words[2][:, h]]) / math.sqrt(3)
                    want |= {(r, (i * 6 + j) * 6 + h) for r in np.flatnonzero(x @ f >= 0.4)}
        assert set(zip(rows.tolist(), at.tolist())) == want


NAN, INF = float("nan"), float("inf")
EDGES = [
    (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [NAN, 1.0]), (6, [INF, 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]),
    (9, [2.0, 0.0]), (None, [1.0, 0.1]), (None, [-1.0, 0.0]), (10, [-0.0, 1.0]), (11, [0.0, 1.0]), (12, [1.0]), (13, [-3.0]), (14, [2.0]),
    (15, [1e30, 1e30, 0.0]), (16, [1e-30, 1e-30, 0.0]), (17, [1.0, 0.0, 0.0]), (None, None),
]


def test_defined_results(spark):
    rows = [(i, v, "z", 1) for i, v in EDGES]
    df = spark.createDataFrame(rows, SCHEMA + ", v string, c int")
    assert got(C.grouped(df)) == brute(EDGES)
    assert C.grouped(df.limit(0)).count() == 0
