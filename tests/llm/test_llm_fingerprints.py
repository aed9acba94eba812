"""Fingerprints: anchors against a brute-force choice, following rows, likeness."""

import hashlib

from pyspark.sql import functions as F

from tagtrack.llm import fingerprints as P
from tagtrack.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_places(h):
    w = P.K - P.S + 1
    return [i for i in range(len(h) - w + 1) if min(h[i], h[i + w - 1]) == min(h[i : i + w])]


def test_anchors_are_closed_syncmers(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", P.pieces(P.tokens(F.col("text"))).alias("h"))
    for r in P.with_anchors(docs, "text", "a").where(F.size(P.tokens(F.col("text"))) >= P.K).collect():
        assert [x.pos for x in r.a] == brute_places(r.h)
        assert r.a  # every run of w + 1 runs has one


def test_anchors_do_not_depend_on_surroundings(spark):
    passage = " ".join(f"word{i * i % 37}x{i}" for i in range(60))
    docs = spark.createDataFrame([(1, passage), (2, f"other start here {passage} and an end")], "doc_id long, text string")
    a, b = (r.a for r in P.with_anchors(docs, "text", "a").orderBy("doc_id").collect())
    inside = [(x.pos + 3, x.hash) for x in a]
    assert set(inside) <= {(x.pos, x.hash) for x in b}
    both = spark.createDataFrame([(a, b)], "a array<struct<pos:int,hash:long>>, b array<struct<pos:int,hash:long>>")
    pairs = both.select(P.matched(F.col("a"), F.col("b")).alias("m")).first().m
    assert [(x.a, x.b) for x in pairs] == [(x.pos, x.pos + 3) for x in a]


def test_defined_results(spark):
    texts = ["", None, " \n ", "one", "one two three", "x" * 500, "x" * 500, "one two three"]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id int, text string, _tokens int, _pieces int")
    got = {r.doc_id: list(r.fp) for r in P.with_fingerprint(docs, "text", "fp").collect()}
    assert got[0] == got[1] == []
    assert len(got[2]) == len(got[3]) == len(got[4]) == 1
    assert got[5] == got[6] != [] and got[4] == got[7]
    assert P.with_fingerprint(docs.limit(0), "text", "fp").count() == 0


def test_likeness(spark):
    big = list(range(0, 1000, 5))[: P.SIZE]
    cases = [([1, 2, 3], [2, 3, 4], 0.5), ([], [], 1.0), ([], [1], 0.0), ([5], [5], 1.0), (big, big, 1.0), (big, [x + 1 for x in big], 0.0)]
    rows = spark.createDataFrame(cases, "a array<long>, b array<long>, want double")
    for r in rows.withColumn("got", P.likeness(F.col("a"), F.col("b"))).collect():
        assert r.got == r.want


def brute_next(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    return sorted(((a[0], a[1], b[1]) for a, b in zip(order, order[1:] + order[:1])), key=repr)


def test_following_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK_ROWS", 3)
    monkeypatch.setattr(P, "FAN", 4)
    many = [(i * 7 % 101 - 20, f"t{i}") for i in range(101)]
    tied = [(5, "b"), (5, "a"), (5, None), (None, "z"), (None, None), (9, "n"), (-3, "m"), (5, "b")]
    for rows in (many, tied, [(1, "only")], [(None, "x"), (None, "y")], [(4, "s")] * 3, []):
        df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, _chunk int, _lent int")
        out = P.with_next(df, "text", "after")
        assert out.columns == ["doc_id", "text", "_chunk", "_lent", "after"]
        assert sorted(((r.doc_id, r.text, r.after) for r in out.collect()), key=repr) == brute_next(rows)


def test_query(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in QUERIES["op10_fingerprints"](spark, SF).collect()}
    assert len(got) == len(docs)
    by_text = {}
    for d, after in zip(docs, docs[1:] + docs[:1]):
        r, cut = got[d.doc_id], len(d.text) // 3
        edited = d.text[: len(d.text) - cut] + after.text[:cut]
        assert r.n_chars == len(d.text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(d.text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    long = [r for d in docs if len(d.text) > 1500 for r in [got[d.doc_id]]]
    assert sum(r.near_edited > r.near_next for r in long) > 0.9 * len(long)


def test_every_text_but_the_empty_one_has_an_anchor(spark):
    texts = [" ".join(f"t{i}x{n}x{j}" for j in range(n)) for n in (6, 7, 8) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: tuple(r.fp) for r in P.with_fingerprint(docs, "text", "fp").collect()}
    assert all(got.values()) and len(set(got.values())) == len(texts)
    assert all(len(r.a) for r in P.with_anchors(docs, "text", "a").collect())


def test_shifted_text_without_spaces_keeps_its_anchors(spark):
    import random

    rng = random.Random(3)
    text = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(3000))
    docs = spark.createDataFrame([(0, text), (1, "x" + text), (2, text[7:])], "doc_id int, text string")
    joined = docs.select("doc_id", F.array_join(P.tokens(F.col("text")), "").alias("j")).collect()
    assert {r.doc_id: r.j for r in joined} == {0: text, 1: "x" + text, 2: text[7:]}
    fp = {r.doc_id: set(r.fp) for r in P.with_fingerprint(docs, "text", "fp").collect()}
    for i in (1, 2):
        assert len(fp[0] & fp[i]) >= 0.9 * len(fp[0]) > 20


def test_all_anchors_count(spark):
    """Two long texts with a passage of 60 words in common, and two that differ in one place."""
    text = lambda seed, n: [f"w{(i * 7919 + seed) * 104729 % 1000003}" for i in range(n)]
    a, b, passage = text(1, 4000), text(500_000, 4000), text(77, 60)
    c = a[:2000] + text(9, 3) + a[2003:]
    rows = [(" ".join(a[:500] + passage + a[500:]), " ".join(b + passage)), (" ".join(a), " ".join(c))]
    pairs = spark.createDataFrame(rows, "x string, y string")
    pairs = P.with_fingerprint(P.with_fingerprint(pairs, "x", "fx"), "y", "fy")
    one, two = (r.l for r in pairs.withColumn("l", P.likeness(F.col("fx"), F.col("fy"))).collect())
    assert 0 < one < 0.1 and 0.95 < two < 1
    cases = spark.createDataFrame([([5, 5, 7], [5, 7, 7, 9], 2 / 5)], "a array<long>, b array<long>, want double")
    assert all(r.got == r.want for r in cases.withColumn("got", P.likeness(F.col("a"), F.col("b"))).collect())


def test_matched_has_every_occurrence(spark):
    kind = "a array<struct<pos:int,hash:long>>, b array<struct<pos:int,hash:long>>"
    both = spark.createDataFrame([([(0, 5), (3, 6)], [(1, 5), (2, 6), (9, 5)])], kind)
    got = both.select(P.matched(F.col("a"), F.col("b")).alias("m")).first().m
    assert [tuple(x) for x in got] == [(0, 1), (0, 9), (3, 2)]
