"""Alignment of two tokenizers against a plain sweep over the tokens."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tagtrack.llm import align as A

LONG = "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"


def spans(ids, tokens):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(tokens[i]), i))
        at += len(tokens[i])
    return out


def brute(rows):
    a_side, b_side = (A.side(f"{A.FOLDER}/{f}") for f in (A.FIRST, A.SECOND))
    found = []
    for i, text in rows:
        a, b = (spans(s.encode([" " + (text or "")])[0], s.tokens) for s in (a_side, b_side))
        joined = [b"".join(s.tokens[x[2]] for x in t) for s, t in ((a_side, a), (b_side, b))]
        if not text or joined != [(" " + text).encode()] * 2:
            found.append((i, None))
            continue
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, at = [], [0, 0]
        for high in cuts:
            sides = []
            for k, t in enumerate((a, b)):
                begin = at[k]
                while at[k] < len(t) and t[at[k]][1] <= high:
                    at[k] += 1
                sides.append(",".join(str(x) for *_, x in t[begin : at[k]]))
            groups.append("|".join(sides))
        pairs, first = [], 0
        for s, e, x in a:
            while b[first][1] <= s:
                first += 1
            k = first
            while k < len(b) and b[k][0] < e:
                pairs.append((x, b[k][2]))
                k += 1
        found.append((i, (len(a), len(b), groups, pairs)))
    count = Counter(p for _, f in found if f for p in set(f[3]))
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, pairs = f
            best = sum(count[p] == top[p[0]] for p in pairs)
            sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
            out.append((i, n_a, n_b, len(groups), len(pairs), best, sum(count[p] for p in pairs), sha))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, *(r[c] for c in LONG)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("head", [1 << 20, 200, 0])
def test_given_table(spark, monkeypatch, head):
    """The same whether pairs are broadcast, some of them, or none."""
    monkeypatch.setattr(A, "HEAD", head)
    monkeypatch.setattr(A, "HELD", 5000)
    monkeypatch.setattr(A, "BATCH_BYTES", 50_000)
    monkeypatch.setattr(A, "KNOWN", 3000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[1] > 0 for r in want) > 150 and got(A.aligned(docs, "doc_id", "text")) == want


TEXTS = [
    None, "", " ", "a", "  two  spaces ", "<|endoftext|> and </s> <unk> [INST]", "naïve café 日本語 😀🇩🇪 é", "tabs\tand\nlines\r\n\n\n",
    "under▁score ▁", "zero\u0000byte", "﻿bom   nbsp 　", "ﬁ ligature Ⅷ ½", "1234567890 0x1F", "x" * 5000, "\U0010ffff‍", "Hello", "Hello",
    "a \n b\n \nc\t d  e \u00a0 f\u2003 g \x1c h \x85 i", "end ", "end  ", "  ", " \n", "\n ", "a\u2581 b", "don't we'll  I'm  x's", "\u180e a \u180e",
]


def test_defined_results(spark):
    rows = [(i if i != 3 else None, t, "z", 1) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pairs string, d int")
    want = brute([(i, t) for i, t, *_ in rows])
    assert got(A.aligned(df, "doc_id", "text")) == want
    zeros = {r[0] for r in want if r[1] == 0}
    assert {0, 1, 8, 23} <= zeros and not {4, 5, 6} & zeros
    assert A.aligned(df.limit(0), "doc_id", "text").count() == 0


def test_groups_on_request(spark):
    df = spark.createDataFrame([(1, "Hello wonderful world")], "doc_id long, text string")
    r = A.aligned(df, "doc_id", "text", keep_groups=True).first()
    assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 and r.groups.count(";") == r.n_groups - 1


def test_long_text(spark):
    words = " ".join(f"w{i * 7919 % 10007}" for i in range(60_000))
    df = spark.createDataFrame([(1, words), (2, "w1 w2")], "doc_id long, text string")
    assert got(A.aligned(df, "doc_id", "text")) == brute([(1, words), (2, "w1 w2")])


def test_pointer_jumping_labels_components():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        ends_a, ends_b = (np.append(np.sort(rng.choice(n, int(rng.integers(0, n)), False))[1:], n) for _ in range(2))
        ends_a, ends_b = (e[e > 0] for e in (ends_a, ends_b))
        a, b = A.labels(ends_a, ends_b)
        cuts = np.intersect1d(ends_a, ends_b)
        want_a, want_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        for i in range(len(a)):
            for j in range(len(b)):
                assert (a[i] == b[j]) == (want_a[i] == want_b[j])
