"""URL filter: rules against brute force, the models against a plain re-computation, held-out accuracy."""

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tagtrack.llm import urls as U
from tagtrack.llm.queries import QUERIES, URL_RULES

SF = "/root/testdata/sf0.01"
RULES = U.parse_rules(URL_RULES)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    "https://www.Example.COM/en/7?x=1", "http://example.com/en/6#a", "http://notexample.com/en/7", "com/en/", "://com/en/x",
    "x://a://b/c", "http://de.example.net/de/81", "http://net/de/8", "https://a.b.org/es/", "https://org/es", None, "",
    "http://host", "http://host?q=/en/", "http://KİM.com/EN/", "http://a\nb.com/en/x\ny", "ftp://u:p@h.com:80/en/1", "x" * 5000,
]


def test_rules(spark):
    rows = spark.createDataFrame([(i, u, "z", 1) for i, u in enumerate(URLS)] * 2, "page_id int, url string, rule string, ruling int")
    got = U.judged(rows, RULES, U.UrlModel()).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path = parts(r.url)
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), r.url


def test_query_follows_rules(spark):
    got = {r.page_id: r for r in QUERIES["op1_urls"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        rule, verdict = rule_of(*parts(p.url))
        assert got[p.page_id].rule == rule
        assert verdict is None or got[p.page_id].verdict == verdict
        assert got[p.page_id].verdict in ("allow", "block")


def symbols(url):
    rest = re.sub(r"[^a-z0-9/.\-]", "_", url.split("://", 1)[-1].lower())
    return rest + "~"


def brute_score(train, url, depth, least):
    counts = defaultdict(Counter)
    for u, ok in train:
        s = symbols(u)
        for i, c in enumerate(s):
            for k in range(min(i, depth) + 1):
                counts[s[i - k : i]][c, ok] += 1
    kept = {c for c, v in counts.items() if sum(v.values()) >= least or not c}

    def p(context, c, ok):
        lower = p(context[1:], c, ok) if context else 1 / len(U.ALPHABET)
        n = sum(v for (_, o), v in counts[context].items() if o == ok)
        kinds = sum(o == ok for (_, o) in counts[context])
        return (counts[context][c, ok] + kinds * lower) / (n + kinds) if n else lower

    out, s = 0.0, symbols(url)
    for i, c in enumerate(s):
        context = next(s[i - k : i] for k in range(min(i, depth), -1, -1) if s[i - k : i] in kept)
        out += math.log(p(context, c, True) / p(context, c, False))
    return out / len(s)


def sites(n, seed):
    rng = random.Random(seed)
    good = ["garden", "library", "museum", "recipes", "science"]
    bad = ["casino", "pills", "win-cash", "xxx-cam", "free-loan"]
    out = []
    for i in range(n):
        ok = rng.random() < 0.6
        out.append((f"https://{rng.choice(good if ok else bad)}{rng.randrange(99)}.net/{rng.choice('abcde')}/{i}", ok))
    return out


def test_model_equals_plain_computation(spark):
    data = sites(300, 1)
    rows = spark.createDataFrame(data, "url string, accepted boolean")
    model = U.fit(rows, depth=3, min_count=40)
    held = {r.url for r in rows.where(F.pmod(F.xxhash64("url"), F.lit(U.FOLDS)) == 0).collect()}
    train = [d for d in data if d[0] not in held]
    tests = [u for u, _ in sites(5, 9)] + ["https://Ünseen.host/?q=1"]
    got = spark.createDataFrame([(u,) for u in tests], "url string").select("url", model.score(F.col("url")).alias("s")).collect()
    for r in got:
        assert abs(r.s - brute_score(train, r.url, 3, 40)) < 1e-4


def test_held_out_accuracy(spark):
    model = U.fit(spark.createDataFrame(sites(800, 2), "url string, accepted boolean"))
    fresh = U.judged(spark.createDataFrame(sites(400, 3), "url string, accepted boolean"), [], model).collect()
    assert sum((r.verdict == "allow") == r.accepted for r in fresh) / len(fresh) > 0.95
    assert len(model.step) <= sum(len(U.ALPHABET) ** k for k in range(U.DEPTH + 1)) * len(U.ALPHABET)


def test_contexts_grow_with_the_corpus(spark):
    kept = [len(U.fit(spark.createDataFrame(sites(n, 4), "url string, accepted boolean")).step) for n in (100, 400, 1600)]
    assert kept[0] < kept[1] < kept[2] and kept[2] > 2 * kept[0]


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "url string, accepted boolean")
    one = spark.createDataFrame([("http://a/b", True), (None, True)], "url string, accepted boolean")
    for rows in (none, one):
        got = U.judged(one.drop("accepted"), [], U.fit(rows)).collect()
        assert [(r.score, r.verdict) for r in got] == [(0.0, "allow")] * 2
    assert U.judged(none, RULES, U.UrlModel()).count() == 0
