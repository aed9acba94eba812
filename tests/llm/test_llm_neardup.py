"""Near-duplicates against brute force over all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tagtrack.llm import neardup as N

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) or frozenset([tuple(w)])


def brute(docs, words):
    """(id, size, component, kept) per row; ids may repeat or be None."""
    sets = [shingles(t, words) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted((i for i in range(len(docs)) if sets[i]), key=lambda i: len(sets[i]))
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            if len(sets[j]) * 80 > len(sets[i]) * 100:
                break
            common = len(sets[i] & sets[j])
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                parent[find(j)] = find(i)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(docs[i][0])
    out = []
    for i, (d, _) in enumerate(docs):
        least = min((x for x in groups[find(i)] if x is not None), default=None) if sets[i] else d
        out.append((d, len(sets[i]), least, d == least))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


@pytest.mark.parametrize("words", [2, 5])
def test_given_table(spark, words):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 600")
    got = rows(N.grouped(docs, words))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], words)
    assert any(not r[3] for r in got)


def edited(rng, base, n):
    out = base[:]
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**9)}"
    return out


def family(seed, members, edits, length=120):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(length)]
    return [" ".join(edited(rng, base, rng.randrange(edits + 1))) for _ in range(members)]


def test_large_family_of_near_copies(spark):
    texts = family(1, 90, 9) + family(2, 40, 14) + family(3, 30, 4, 30)
    docs = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    random.Random(5).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(N.grouped(df, 2)) == brute(docs, 2)


def test_chain_is_one_group(spark):
    rng = random.Random(4)
    text = [f"w{i}" for i in range(80)]
    docs = []
    for i in range(25):
        docs.append((100 - i, " ".join(text)))
        text = edited(rng, text, 3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 2)
    assert rows(N.grouped(df, 2)) == want and len({r[2] for r in want}) < 25


def test_small_sets(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12)))) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(N.grouped(df, 2)) == brute(docs, 2)


EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (5, "one"), (6, "two words"), (7, "TWO  words"), (None, "null id"), (None, "Null id"), (8, "null id"), (None, "alone"), (9, "É x"), (10, "é x"), (11, "other"), (11, "different text")]


def test_defined_results(spark):
    df = spark.createDataFrame([(i, t, "z", 3) for i, t in EDGES], "doc_id long, text string, key string, c long")
    assert rows(N.grouped(df, 2)) == brute(EDGES, 2)
    left = N.deduplicated(df, 2)
    assert left.columns == df.columns
    got = sorted((r.doc_id for r in left.collect()), key=repr)
    assert got == sorted([1, 2, 3, 4, 6, 8, None, 9, 10, 11, 11], key=repr)
    assert N.grouped(df.limit(0), 2).count() == 0 and N.deduplicated(df.limit(0)).count() == 0


def test_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    docs = [(1, long), (2, long + " more"), (3, "w1 w2 w3")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(N.grouped(df, 5)) == brute(docs, 5)


def test_long_lists_are_settled_without_luck(spark, monkeypatch):
    """Links that no centre happens to meet: one pair whose common shingles all stand in long lists."""
    none = lambda posts, percent: posts.select(posts["c"].alias("a"), posts["c"].alias("b")).limit(0)
    monkeypatch.setattr(N, "_centred", none)
    texts = family(7, 60, 12) + family(8, 50, 7)
    docs = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 2)
    assert rows(N.grouped(df, 2)) == want and len({r[2] for r in want}) < len(docs) / 2


def test_a_passage_that_unlike_texts_share_makes_no_pairs(spark):
    """Values that many classes retain stand behind their prefixes."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) + " " + passage for _ in range(150)]
    texts += [t + " more" for t in texts[:20]]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(N.grouped(df, 2)) == brute(docs, 2)
    sets = N.A.with_columns(df, "text", N._full(2), N.FULL)
    sets = sets.select(sets["doc_id"].alias("c"), *N.PARITY, "shingles")
    assert 20 <= N._between(sets.select("c", sets["c"].alias("label")), sets, 80).count() < 60


def test_recall_of_candidates(spark):
    """Of all links between random pairs at the very threshold, candidates keep 99 in 100 at least."""
    rng = random.Random(10)
    docs = []
    for k in range(300):
        base = [f"a{k}.{i}" for i in range(200)]
        other = base[:]
        for at in rng.sample(range(0, 200, 2), 11):
            other[at] = f"b{k}.{at}"
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    want = brute(docs, 2)
    links = sum(not r[3] for r in want)
    got = rows(N.grouped(spark.createDataFrame(docs, "doc_id long, text string"), 2))
    assert links > 200 and sum(not r[3] for r in got) >= 0.99 * links


def test_the_member_of_most_lists_is_their_centre(spark):
    """Every list holds one class and four that other lists do not hold: each pair has the one as an end."""
    posts = [(k, c, 100, -1, -1, -1, -1) for k in range(20) for c in (50, *range(1000 * k, 1000 * k + 4))]
    df = spark.createDataFrame(posts, "key long, c long, n long, b0 long, b1 long, b2 long, b3 long")
    pairs = N._centred(df, 80).collect()
    assert len(pairs) == 80 and all(50 in (r.a, r.b) for r in pairs)


def test_parities_rule_pairs_out_before_their_whole_sets_are_made(spark):
    """Sets whose sketches may be of linked ones, but which differ in more values than those may."""
    rng, docs = random.Random(12), []
    for k in range(40):
        base = [f"a{k}.{i}" for i in range(200)]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(edited(rng, base, 18)))]
    df = spark.createDataFrame(docs, "c long, text string")
    made = N.A.with_columns(df, "text", N._sketches(2), N.SKETCHED)
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(40)], "a long, b long")
    assert not any(not r[3] for r in brute(docs, 2))
    assert N._estimated(pairs, made.withColumns({p: F.lit(0).cast("long") for p in N.PARITY}), 80).count() > 20
    assert N._estimated(pairs, made, 80).count() < 20


def test_texts_meet_by_pair_and_only_sketches_of_pairs_are_dealt_out(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(900)) for _ in range(300)) for _ in range(6)]
    docs = [(k, t) for k, t in enumerate([*base, base[0] + " one more", base[1] + " two", base[2]])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    made = N.A.with_columns(df, "text", N._sketches(2), N.SKETCHED)
    classes = made.where("doc_id < 8").select(F.col("doc_id").alias("c"), F.col("doc_id").alias("rep"), *[c for c in made.columns if c not in ("doc_id", "text")])
    texts = N._texts(classes.select("c"), classes, df, 2)
    assert set(texts.columns) == {"c", "n", *N.PARITY, "text"} and dict(texts.select("c", "text").collect()) == dict(docs[:8])
    pairs = spark.createDataFrame([(0, 6), (1, 7), (3, 4)], "a bigint, b bigint")
    assert sorted(map(tuple, N._alike(pairs, texts, 2, 80).collect())) == [(0, 6), (1, 7)]
    plan = N._estimated(pairs, classes, 80)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
