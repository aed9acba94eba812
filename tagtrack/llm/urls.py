"""URL filter: host and path rules first, a ratio of two character models for the rest.

Both models (accepted, rejected URLs) are smoothed variable-order Markov models over
one context tree. A context of up to ``depth`` characters is kept where it was seen
at least ``min_count`` times, so the tree grows with the corpus. The alphabet bounds
it: 70,644 contexts of up to three characters, 35 MB of tables. Probabilities are interpolated with
the next shorter context (Witten-Bell). The tree is closed under prefixes and
suffixes, so scoring is one walk through a table of states, a fold over the
characters of the URL.

Training counts cover every labelled URL outside the calibration fifth; the
threshold on the length-normalised log-likelihood difference is the one that
separates the calibration fifth best (mean of both classes' accuracies).

Defined results: a NULL URL or one without ``://`` has empty host and path and fits
no rule; NULL or empty URLs score 0 and are allowed, as nothing speaks against
them; without examples of both classes every score is 0 and all is allowed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtrack.llm.common import UPPER, free_name

#: characters of the models; every other character counts as "_", "~" ends a URL
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789/.-_~"
DEPTH, MIN_COUNT, FOLDS, BIN = 3, 8, 5, 0.02

Rule = tuple[str, str, str]  # (verdict, host, path)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def parse_rules(text: str) -> list[Rule]:
    """"block com/en/, allow example.com/en/7" as (verdict, host, path) triples."""
    rules = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        verdict, where = part.split(" ", 1)
        host, slash, path = where.strip().partition("/")
        rules.append((verdict, host.lower(), slash + path))
    return rules


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits as text, and its verdict; NULL where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def symbols(url: Column) -> Column:
    """A URL after its scheme in the models' alphabet, end mark included."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^(?s:.*?)://", "")
    return F.concat(F.regexp_replace(F.translate(rest, UPPER, UPPER.lower()), r"[^a-z0-9/.\-]", "_"), F.lit("~"))


@dataclass
class UrlModel:
    """Transition tables by state * len(ALPHABET) + symbol, and the calibrated threshold."""

    step: list[int] = field(default_factory=lambda: [0] * len(ALPHABET))
    gain: list[float] = field(default_factory=lambda: [0.0] * len(ALPHABET))
    threshold: float = 0.0
    accuracy: float | None = None

    def score(self, url: Column) -> Column:
        """Mean log-likelihood difference (accepted minus rejected) per symbol."""
        n = len(ALPHABET)
        step = F.split(F.lit(",".join(map(str, self.step))), ",").cast("array<int>")
        gain = F.split(F.lit(",".join(f"{g:.5f}" for g in self.gain)), ",").cast("array<double>")
        codes = "".join(chr(48 + i) for i in range(n))
        chars = F.split(F.translate(symbols(url), ALPHABET, codes), "")

        def walk(acc: Column, x: Column) -> Column:
            at = acc["state"] * n + (F.ascii(x) - 48)
            return F.struct(F.get(step, at).alias("state"), (acc["sum"] + F.get(gain, at)).alias("sum"))

        start = F.struct(F.lit(0).alias("state"), F.lit(0.0).alias("sum"))
        total = F.aggregate(chars, start, walk, lambda acc: acc["sum"])
        blank = F.coalesce(url, F.lit("")) == ""
        return F.when(blank, F.lit(0.0)).otherwise(total / F.size(chars))


def _tables(counts: dict[str, dict[str, tuple[int, int]]]) -> tuple[list[int], list[float]]:
    """Transition tables from context -> symbol -> (accepted, rejected) counts."""
    contexts = sorted(counts, key=lambda c: (len(c), c))
    number = {c: i for i, c in enumerate(contexts)}
    prob: dict[str, dict[str, list[float]]] = {}
    step, gain = [], []
    for c in contexts:
        lower = prob[c[1:]] if c else {s: [1 / len(ALPHABET)] * 2 for s in ALPHABET}
        seen, here = counts[c], {s: [0.0, 0.0] for s in ALPHABET}
        for k in (0, 1):
            total = sum(v[k] for v in seen.values())
            kinds = sum(v[k] > 0 for v in seen.values())
            for s in ALPHABET:
                n = seen.get(s, (0, 0))[k]
                here[s][k] = (n + kinds * lower[s][k]) / (total + kinds) if total else lower[s][k]
        prob[c] = here
        for s in ALPHABET:
            to = c + s
            while to not in number:
                to = to[1:]
            step.append(number[to])
            gain.append(math.log(here[s][0] / here[s][1]))
    return step, gain


def fit(
    labelled: DataFrame, depth: int = DEPTH, min_count: int = MIN_COUNT, folds: int = FOLDS
) -> UrlModel:
    """A model from ``labelled`` (url, accepted boolean); one fold in ``folds`` calibrates the threshold."""
    rows = labelled.where(F.col("url").isNotNull() & F.col("accepted").isNotNull())
    held = F.pmod(F.xxhash64("url"), F.lit(folds)) == 0
    s = rows.where(~held).select(symbols(F.col("url")).alias("s"), F.col("accepted").cast("long").alias("ok"))
    at = s.select("s", "ok", F.explode(F.sequence(F.lit(1), F.char_length("s"))).alias("i"))
    at = at.select("s", "ok", "i", F.explode(F.sequence(F.lit(0), F.least(F.col("i") - 1, F.lit(depth)))).alias("k"))
    grams = at.groupBy(
        F.substring("s", F.col("i") - F.col("k"), F.col("k")).alias("context"), F.substring("s", F.col("i"), F.lit(1)).alias("symbol")
    ).agg(F.sum("ok").alias("yes"), F.sum(1 - F.col("ok")).alias("no"))
    # one list per context: at most one entry per symbol
    per = grams.groupBy("context").agg(
        F.sum(F.col("yes") + F.col("no")).alias("n"), F.collect_list(F.struct("symbol", "yes", "no")).alias("next")
    )
    root = per.where("context = ''").select("n", F.aggregate("next", F.lit(0).cast("long"), lambda a, x: a + x["yes"]).alias("yes")).first()
    if root is None or root.yes in (0, root.n):
        return UrlModel()
    kept = per.where((F.col("n") >= min_count) | (F.col("context") == "")).collect()
    counts = {r.context: {x.symbol: (x.yes, x.no) for x in r.next} for r in kept}
    model = UrlModel(*_tables(counts))
    scored = rows.where(held).select("accepted", F.floor(model.score(F.col("url")) / BIN).alias("bin"))
    bins = scored.groupBy(F.greatest(F.least("bin", F.lit(1000)), F.lit(-1000)).alias("bin")).agg(
        F.sum(F.col("accepted").cast("long")).alias("yes"), F.sum(1 - F.col("accepted").cast("long")).alias("no")
    )
    _calibrate(model, sorted((r.bin, r.yes, r.no) for r in bins.collect()))
    return model


def _calibrate(model: UrlModel, bins: list[tuple[int, int, int]]) -> None:
    """The bin edge with the best mean of both classes' accuracies; the lowest of equals."""
    yes, no = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not yes or not no:
        return
    below_yes = below_no = 0
    best = (0.5, -1000 * BIN)
    for b, y, n in bins:
        now = ((yes - below_yes) / yes + below_no / no) / 2
        if now > best[0]:
            best = (now, b * BIN)
        below_yes, below_no = below_yes + y, below_no + n
    model.accuracy, model.threshold = best


def judged(pages: DataFrame, rules: list[Rule], model: UrlModel) -> DataFrame:
    """``pages`` with host, path, rule, score and verdict (allow or block); such columns are replaced."""
    pages = pages.drop("host", "path", "rule", "score", "verdict")
    ruling = free_name(pages, "ruling")
    rows = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    text, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", text).withColumn(ruling, verdict).withColumn("score", model.score(F.col("url")))
    blank = F.coalesce("url", F.lit("")) == ""
    own = F.when(blank | (F.col("score") >= model.threshold), F.lit("allow")).otherwise(F.lit("block"))
    return rows.withColumn("verdict", F.coalesce(F.col(ruling), own)).drop(ruling)


def labelled_by_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """url, accepted: the URLs that a rule decides."""
    _, verdict = matching_rule(host_of(F.col("url")), path_of(F.col("url")), rules)
    return pages.select("url", (verdict == "allow").alias("accepted")).where(F.col("accepted").isNotNull())
