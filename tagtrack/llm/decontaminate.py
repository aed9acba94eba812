"""Benchmark decontamination: a broadcast set of test n-grams, scanned over training word windows.

The n-grams of the benchmark travel to every task inside the plan. A document is
read once: its words are looked up among the *anchor* words (the longest word of
each n-gram), and only windows round an anchor are spelled out and looked up in
the n-gram set itself, so a hit is a verified hit. Everything is a column
expression over one row; the scan needs no shuffle.

The set travels inside the plan up to ``max_ngrams`` n-grams (the count is checked
first). For a larger benchmark the 64-bit hashes of its n-grams are the broadcast
set, up to ``max_hashes`` of them (checked too, 8 bytes each and the table's own): every
window is looked up by its hash where it stands, only windows found leave the
task, and those are spelled out from their text and verified against the n-grams.
Beyond that the same lookup is a shuffled join of hashes. The rows are the same on
every way.

Defined results: NULL and wordless texts have no words and no hits; NULL, empty
and wordless items have no windows; repeated documents give a row each; repeated
items count once; an item without an id can hit but is in no item list. Extra
columns of the documents are kept by ``decontaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtrack.llm import common as C

WIDTH = 10
MAX_NGRAMS, MAX_HASHES = 20_000, 4_000_000
HIT = "struct<start:int,size:int,ngram:string>"


def item_ngrams(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """ngram, size, items: each distinct n-gram, its words, the ids of its items. A short item is one n-gram."""
    items = benchmark.select("item_id", C.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(width - 1), F.lit(1)))
    grams = items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, width))).alias("g"))
    return grams.groupBy(F.concat_ws(" ", "g").alias("ngram")).agg(
        F.first(F.size("g")).alias("size"), F.collect_set("item_id").alias("items")
    )


class NgramSet:
    """The benchmark's n-grams on the driver: at most ``max_ngrams``, else ``None`` from ``collect``."""

    def __init__(self, ngrams: list[str]):
        self.by_size: dict[int, list[str]] = {}
        for g in ngrams:
            self.by_size.setdefault(g.count(" ") + 1, []).append(g)
        self.anchors = {
            n: sorted({max(g.split(" "), key=lambda w: (len(w), w)) for g in grams}) for n, grams in self.by_size.items()
        }

    @staticmethod
    def collect(grams: DataFrame, max_ngrams: int = MAX_NGRAMS) -> NgramSet | None:
        rows = grams.select("ngram").limit(max_ngrams + 1).collect()
        return None if len(rows) > max_ngrams else NgramSet([r.ngram for r in rows])

    def hits(self, w: Column) -> Column:
        """Array of (start, size, ngram) of every window of ``w`` that is an n-gram of the set; starts from 0."""
        parts = [self._hits(w, n) for n in sorted(self.by_size)]
        kind = f"array<{HIT}>"
        return F.concat(*parts).cast(kind) if parts else F.array().cast(kind)

    def _hits(self, w: Column, n: int) -> Column:
        last = F.size(w) - F.lit(n)
        at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(self.anchors[n]))
        near = F.transform(
            at, lambda p: F.sequence(F.greatest(p - (n - 1), F.lit(0)), F.greatest(F.least(p, last), F.greatest(p - (n - 1), F.lit(0))))
        )
        starts = F.array_distinct(F.flatten(near))
        spelled = F.transform(
            starts,
            lambda s: F.struct(s.alias("start"), F.lit(n).alias("size"), F.concat_ws(" ", F.slice(w, s + 1, n)).alias("ngram")),
        )
        found = F.filter(spelled, lambda x: (x["start"] <= last) & x["ngram"].isin(self.by_size[n]))
        none = F.array().cast(f"array<{HIT}>")
        return F.when(last >= 0, found).otherwise(none)


def _window_hashes(w: Column, sizes: list[int]) -> Column:
    """Array of (start, size, hash of the words) of all windows of ``w`` of the given sizes."""
    kind = "array<struct<start:int,size:int,hash:bigint>>"

    def windows(n: int) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))
        every = F.transform(at, lambda s: F.struct(s.alias("start"), F.lit(n).alias("size"), F.xxhash64(F.slice(w, s + 1, n)).alias("hash")))
        return F.when(F.size(w) >= n, every.cast(kind)).otherwise(F.array().cast(kind))

    return F.concat(F.array().cast(kind), *[windows(n) for n in sizes])


def covered(hits: Column) -> Column:
    """Distinct word positions inside any of the (start, size) spans."""
    return F.array_distinct(
        F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1)))
    )


def _with_hits(documents: DataFrame, benchmark: DataFrame, width: int, max_ngrams: int, max_hashes: int) -> tuple[DataFrame, DataFrame, bool]:
    """doc_id, key, n_words, first (1 once per row), start, size, ngram: a row per hit, or one without a hit."""
    grams = item_ngrams(benchmark, width)
    ngrams = NgramSet.collect(grams, max_ngrams)
    base = documents.select("doc_id", C.text_key(F.col("text")).alias("key"), C.words(F.col("text")).alias("w"))
    if ngrams is not None:
        rows = base.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), ngrams.hits(F.col("w")).alias("hits"))
        rows = rows.select("doc_id", "key", "n_words", F.posexplode_outer("hits").alias("i", "h"))
        first = F.when(F.coalesce("i", F.lit(0)) == 0, 1).otherwise(0).alias("first")
        return grams, rows.select("doc_id", "key", "n_words", first, "h.*"), True
    return grams, _joined_hits(base, grams, width, max_hashes), False


def _joined_hits(base: DataFrame, grams: DataFrame, width: int, max_hashes: int) -> DataFrame:
    """The rows of ``_with_hits`` for (doc_id, key, w): windows are looked up by hash, those found are verified by their words."""
    plain = base.select(
        "doc_id", "key", F.size("w").cast("long").alias("n_words"), F.lit(1).alias("first"), F.lit(None).cast(HIT).alias("hit")
    ).select("doc_id", "key", "n_words", "first", "hit.*")
    return plain.unionByName(_found(base, grams, width, max_hashes))


def _found(base: DataFrame, grams: DataFrame, width: int, max_hashes: int) -> DataFrame:
    """doc_id, key, n_words, first (0), start, size, ngram: a row per hit of each (doc_id, text)."""
    sizes = sorted(r.size for r in grams.select("size").distinct().limit(width).collect())
    hashes = grams.select(F.xxhash64(F.split("ngram", " ")).alias("hash")).distinct()
    if hashes.limit(max_hashes + 1).count() <= max_hashes:
        hashes = F.broadcast(hashes)
    windows = base.select("doc_id", "key", F.explode(C.let(F.col("w"), lambda w: _window_hashes(w, sizes))).alias("h"))
    windows = windows.select("doc_id", "key", F.col("h.start").alias("start"), F.col("h.size").alias("size"), F.col("h.hash").alias("hash"))
    # as many spans as a text has windows at most
    spans = windows.join(hashes, "hash", "left_semi").groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "size")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "spans")
    texts = base.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
    spelled = F.transform(
        "spans",
        lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size"), F.concat_ws(" ", F.slice("w", x["start"] + 1, x["size"])).alias("ngram")),
    )
    hit = texts.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), F.lit(0).alias("first"), F.explode(spelled).alias("h"))
    return hit.select("doc_id", "key", "n_words", "first", "h.*").join(grams.select("ngram"), "ngram", "left_semi")


def contamination(
    documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_ngrams: int = MAX_NGRAMS, max_hashes: int = MAX_HASHES
) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items, contaminated: a row per document.

    ``spans`` are the (start, size) word windows found, ``items`` the sorted ids (as strings) of their items.
    """
    grams, rows, fits = _with_hits(documents, benchmark, width, max_ngrams, max_hashes)
    owners = grams.select("ngram", "items")
    rows = rows.join(F.broadcast(owners) if fits else owners, "ngram", "left")
    none = F.array().cast("array<string>")
    per = rows.groupBy("doc_id", "key").agg(
        F.max("n_words").alias("n_words"),
        F.sum("first").alias("copies"),
        F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "size"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set(F.coalesce("items", F.array().cast("array<long>"))))).alias("items"),
    )
    out = per.select(
        "doc_id",
        "n_words",
        F.size(covered(F.col("spans"))).cast("long").alias("n_hit"),
        F.sort_array("spans").alias("spans"),
        F.sort_array(F.coalesce(F.col("items").cast("array<string>"), none)).alias("items"),
        (F.size("spans") > 0).alias("contaminated"),
        F.sequence(F.lit(1), F.col("copies")).alias("_copies"),
    )
    return out.select("*", F.explode("_copies").alias("_copy")).drop("_copies", "_copy")


def decontaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    mode: str = "documents",
    width: int = WIDTH,
    max_ngrams: int = MAX_NGRAMS,
    max_hashes: int = MAX_HASHES,
) -> DataFrame:
    """Documents without benchmark passages, all columns kept.

    ``documents`` drops every contaminated document; ``spans`` cuts the hit words
    (and the characters between neighbours of one span) out of the text. Both are
    projections of the scan while the n-grams fit; beyond that, the verified spans of every
    (doc_id, text) that has any are joined back, with the same result.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}")
    grams = item_ngrams(benchmark, width)
    ngrams = NgramSet.collect(grams, max_ngrams)
    if ngrams is None:
        base = documents.select("doc_id", C.text_key(F.col("text")).alias("key"), C.words(F.col("text")).alias("w"))
        found = _found(base, grams, width, max_hashes).groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "size")).alias("hits"))
        doc, key, hit = (C.free_name(documents, x) for x in ("_hit_id", "_hit_key", "hits"))
        found = found.select(F.col("doc_id").alias(doc), F.col("key").alias(key), F.col("hits").alias(hit))
        same = documents["doc_id"].eqNullSafe(F.col(doc)) & (C.text_key(documents["text"]) == F.col(key))
        if mode == "documents":
            return documents.join(found.select(doc, key), same, "left_anti")
        rows = documents.join(found, same, "left").drop(doc, key)
        return rows.withColumn("text", F.when(F.col(hit).isNull(), F.col("text")).otherwise(_cut(F.col("text"), covered(F.col(hit)), F.lit(True)))).drop(hit)
    hits = C.let(C.words(F.col("text")), ngrams.hits)
    if mode == "documents":
        return documents.where(F.size(hits) == 0)
    hit = C.free_name(documents, "hits")
    return documents.withColumn(hit, hits).withColumn("text", _cut(F.col("text"), covered(F.col(hit)), F.size(hit) > 0)).drop(hit)


def _cut(text: Column, at: Column, any_hit: Column) -> Column:
    """``text`` without the words at the positions ``at``; a gap stays in front of the word that follows it."""
    padded = F.concat(F.lit(" "), text)
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    pairs = F.regexp_extract_all(padded, F.lit(f"({gap})({word})"), F.lit(0))
    kept = F.filter(pairs, lambda p, i: ~F.array_contains(at, i))
    tail = F.regexp_extract(padded, f"({gap})$", 1)
    cut = F.concat(F.array_join(kept, ""), F.when(F.size(pairs) > 0, tail).otherwise(F.lit("")))
    return F.when(any_hit, F.ltrim(cut)).otherwise(text)
