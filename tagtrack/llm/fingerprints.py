"""Document fingerprints from closed syncmers.

A text is split at white space into tokens; a very long one is cut where a hash of the
four characters round a place says so, so texts without spaces have tokens too, and
the same ones where a passage is shifted. Of every run of K tokens
the S-token pieces inside are hashed; the run is an *anchor* if its smallest piece
stands at an edge. That depends on the run alone, never on its surroundings, so
equal passages have equal anchors wherever they stand, and anchors with positions
match passage to passage. Where no run of a text is one, its smallest run is.

A fingerprint is all anchors of a text in order of position (32-bit hashes, with their
token positions in the query); ``likeness`` is the Jaccard similarity of two
texts' anchors, every occurrence counted.

Defined results: NULL and empty texts have the empty fingerprint, alike only to
itself; a text of fewer than K tokens is one anchor, one of white space only too;
equal texts have equal fingerprints.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtrack.llm.common import free_name, let

#: SIZE is a length for tests of likeness; fingerprints have no bound
K, S, SIZE = 6, 2, 48
LONG, PIECE, ROUND = 40, 16, 2
CHUNK_ROWS, MAX_CHUNKS, FAN = 1000, 2048, 64


def tokens(text: Column) -> Column:
    plain = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")
    long = F.exists(plain, lambda t: F.char_length(t) > LONG)
    each = F.transform(plain, lambda t: F.when(F.char_length(t) > LONG, _cut(t)).otherwise(F.array(t)))
    return F.when(long, F.flatten(each)).otherwise(plain)


def _cut(token: Column) -> Column:
    """A token in parts of PIECE characters on average; a cut depends on the ROUND characters on either side of it only."""

    def parts(chars: Column) -> Column:
        def here(i: Column) -> Column:
            near = [F.get(chars, i + d) for d in range(-ROUND, ROUND)]
            return F.pmod(F.xxhash64(*near), F.lit(PIECE)) == 0

        at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(chars) - 1, F.lit(1))), here)
        bounds = F.concat(F.array(F.lit(0)), at, F.array(F.size(chars)))
        return let(
            bounds,
            lambda b: F.transform(
                F.sequence(F.lit(0), F.size(b) - 2),
                lambda k: F.array_join(F.slice(chars, F.get(b, k) + 1, F.get(b, k + 1) - F.get(b, k)), ""),
            ),
        )

    return let(F.split(token, ""), parts)


def pieces(toks: Column) -> Column:
    """Hashes of the S-token pieces, in order."""
    return F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(toks) - S, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(toks, i + d) for d in range(S)]),
    )


def anchor_places(h: Column) -> Column:
    """Starts of the runs whose smallest piece is the first or the last; without any, of the run with the smallest hash."""
    w = K - S  # pieces of a run, less one

    def edge(i: Column) -> Column:
        ends = F.least(F.get(h, i), F.get(h, i + w))
        return ends <= F.least(*[F.get(h, i + d) for d in range(1, w)])

    runs = F.sequence(F.lit(0), F.greatest(F.size(h) - 1 - w, F.lit(0)))
    least = F.array_min(F.transform(runs, lambda i: F.struct(_hash_at(h, i).alias("hash"), i.alias("pos"))))["pos"]
    return let(F.filter(runs, edge), lambda at: F.when(F.size(at) > 0, at).otherwise(F.array(least)))


def _hash_at(h: Column, i: Column) -> Column:
    parts = [F.get(h, i + d) for d in range(0, K - S + 1, S)]
    return F.shiftrightunsigned(F.xxhash64(*parts), 32)


def _tokenised(docs: DataFrame, text: str) -> tuple[DataFrame, str, str]:
    t, h = free_name(docs, "_tokens"), free_name(docs, "_pieces")
    return docs.withColumn(t, tokens(F.col(text))).withColumn(h, pieces(F.col(t))), t, h


def _whole(t: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.array_join(t, " ")), 32)


def _or_short(text: str, t: str, many: Column, one: Column) -> Column:
    empty = F.coalesce(F.char_length(text), F.lit(0)) == 0
    return F.when(empty, F.slice(F.array(one), 1, 0)).when(F.size(t) < K, F.array(one)).otherwise(many)


def with_anchors(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with ``out``: array of (pos, hash), the anchors of a text column by token position."""
    rows, t, h = _tokenised(docs, text)
    many = F.transform(
        anchor_places(F.col(h)), lambda i: F.struct(i.alias("pos"), _hash_at(F.col(h), i).alias("hash"))
    )
    one = F.struct(F.lit(0).alias("pos"), _whole(t).alias("hash"))
    return rows.withColumn(out, _or_short(text, t, many, one)).drop(t, h)


def with_fingerprint(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with ``out``: the hashes of all anchors of a text column, by position."""
    rows, t, h = _tokenised(docs, text)
    many = F.transform(anchor_places(F.col(h)), lambda i: _hash_at(F.col(h), i))
    return rows.withColumn(out, _or_short(text, t, many, _whole(t))).drop(t, h)


def hashes(anchors: Column) -> Column:
    return F.transform(anchors, lambda x: x["hash"])


def as_text(anchors: Column) -> Column:
    """Eight hex digits of the hash and eight of the position of every anchor."""
    return F.array_join(F.transform(anchors, lambda x: F.concat(F.lpad(F.hex(x["hash"]), 8, "0"), F.lpad(F.hex(x["pos"]), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two lists of hashes: common occurrences among all, by one pass over both in order of hash."""

    def side(x: Column, k: int) -> Column:
        return F.transform(x, lambda v: F.struct(v.cast("long").alias("h"), F.lit(k).alias("of_b")))

    def state(h: Column, na: Column, nb: Column, low: Column, high: Column) -> Column:
        return F.struct(h.alias("h"), na.alias("na"), nb.alias("nb"), low.alias("low"), high.alias("high"))

    def add(s: Column, x: Column) -> Column:
        same = s["h"] == x["h"]
        na, nb = F.when(same, s["na"]).otherwise(0) + (1 - x["of_b"]), F.when(same, s["nb"]).otherwise(0) + x["of_b"]
        low = s["low"] + F.when(same, 0).otherwise(F.least(s["na"], s["nb"]))
        high = s["high"] + F.when(same, 0).otherwise(F.greatest(s["na"], s["nb"]))
        return state(F.coalesce(x["h"], F.lit(-1).cast("long")), na, nb, low, high)

    none = state(F.lit(-1).cast("long"), *[F.lit(0)] * 4)  # hashes are not negative
    share = F.aggregate(
        F.sort_array(F.concat(side(a, 0), side(b, 1))),
        none,
        add,
        lambda s: (s["low"] + F.least(s["na"], s["nb"])) / F.greatest(s["high"] + F.greatest(s["na"], s["nb"]), F.lit(1)),
    )
    return F.when(a == b, F.lit(1.0)).otherwise(share)


def matched(a: Column, b: Column) -> Column:
    """Positional matches of two anchor arrays: (pos of a, pos of b) of every two equal anchors, in order of a, then b."""
    return F.flatten(
        F.transform(
            a,
            lambda x: F.transform(
                F.filter(b, lambda y: y["hash"] == x["hash"]), lambda y: F.struct(x["pos"].alias("a"), y["pos"].alias("b"))
            ),
        )
    )


def with_next(docs: DataFrame, column: str, out: str) -> DataFrame:
    """``docs`` (doc_id, ``column``, ...) with ``out``: ``column`` of the next row in descending doc_id, the first row's after the last.

    Equal ids are ordered by ``column``, NULL ids come last. Ids are cut into ranges at
    quantiles; the row that follows a range is lent to it, so a window never
    spans more than one range and rows move once.
    """
    n, high = docs.agg(F.count("doc_id"), F.max("doc_id")).first()
    cuts: list[int] = []
    if n:
        parts = min(MAX_CHUNKS, max(1, math.ceil(n / CHUNK_ROWS)))
        ask = F.array(*[F.lit(i / parts) for i in range(1, parts + 1)])
        found = docs.agg(F.percentile_approx("doc_id", ask, 20_000)).first()[0]
        cuts = sorted({*found, high})
    chunk, guest, after = (free_name(docs, x) for x in ("_chunk", "_lent", "_after"))
    own = docs.withColumn(chunk, _range_of(F.col("doc_id"), cuts)).withColumn(guest, F.lit(0))
    if cuts:
        to = F.when(F.col("doc_id") == high, F.lit(0)).otherwise(_range_of(F.col("doc_id"), cuts) + 1)
        lent = docs.where(F.col("doc_id").isin(cuts)).withColumn(chunk, to)
    else:
        lent = docs.orderBy(F.col(column).asc_nulls_first()).limit(1).withColumn(chunk, F.lit(0))
    by = Window.partitionBy(chunk).orderBy(guest, F.col("doc_id").desc_nulls_last(), F.col(column).asc_nulls_first())
    rows = own.unionByName(lent.withColumn(guest, F.lit(1)))
    rows = rows.withColumn(after, F.lead(F.struct(F.col(column).alias("v"))).over(by)).where(F.col(guest) == 0)
    return rows.withColumn(out, F.col(f"{after}.v")).drop(chunk, guest, after)


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts lie below ``key``: a coarse step over every FAN-th cut, then a fine one."""
    if not cuts:
        return F.lit(0)
    every = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    coarse = F.split(F.lit(",".join(map(str, cuts[FAN - 1 :: FAN] or [cuts[-1]]))), ",").cast("array<bigint>")
    skip = F.size(F.filter(coarse, lambda c: c < key)) * (FAN if len(cuts) >= FAN else 0)
    below = F.size(F.filter(F.slice(every, skip + 1, F.lit(FAN)), lambda c: c < key))
    return F.when(key.isNull(), F.lit(0)).otherwise(skip + below)


def edited(text: Column, following: Column) -> Column:
    """The last third of ``text`` replaced by as many first characters of ``following`` (or all of it)."""
    text, following = F.coalesce(text, F.lit("")), F.coalesce(following, F.lit(""))
    cut = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - cut), F.substring(following, F.lit(1), cut))
