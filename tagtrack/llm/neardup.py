"""MinHash near-duplicate detection with bottom-k sketches.

One hash function orders all word shingles; the sketch of a text keeps the
``SKETCH`` smallest. Texts with equal shingle sets form a *class* first (by a
128-bit digest and the size), and classes are compared, so copies cost one row each.

Candidates come from inverted lists over retained values. The key of a list is a
run of three neighbouring retained values (of two for the smallest sets), not
one value: a very common shingle is retained by a third of all texts, a run of
three far more seldom. Two sets that are 80 % alike share a run for certain while
their union fits a sketch, and with a probability of 1 - 5e-7 at the very threshold
beyond that. Lists of up to ``SHORT`` classes give all their pairs. A longer list,
such as that of a family of near copies, pairs its members with one centre only, the one
that stands in most of the family's lists; that links most of a family. Then the classes of long lists that are
still in different components are compared over their whole sets, behind a prefix
filter that all links pass (``_between``), so the rest is exact and no list gives all its pairs. 256-bit
marks of the sketches drop pairs that cannot be alike before they leave a list.

Of the candidate pairs, those go whose sets' parities differ in more bits than linked sets may in
values; then the smallest values of the union of both sketches estimate
the similarity, and what lies over four and a half deviations below the threshold goes. The rest
is verified on full shingle sets, made again from the texts of candidates alone: texts meet by pair,
as they are less than half of their sets' hashes, and the sets are made where both texts are.
Links then give components by label propagation with pointer jumping. All
intermediate tables are written to the shared folder.

Defined results: texts without words are linked with nothing and kept; a text of
fewer words than a shingle has one shingle, the whole sequence; NULL ids
are kept where no other id is in their group; repeated rows are in one group; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtrack.llm import arrays as A
from tagtrack.llm.common import saved

SKETCH, RUN, SHORT, PERCENT, WORDS = 40, 3, 16, 80, 5
PART_ROWS = 50_000
#: of the estimate below the threshold, at which a pair goes: one linked pair in 300,000 at the very threshold
DEVIATIONS = 4.5
#: ids that are broadcast at most; beyond that texts are shuffled to them
MAX_BROADCAST = 500_000
#: shingles of full sets that are broadcast at most (8 bytes each)
MAX_VALUES = 4_000_000
NONE = 1 << 62  # stands for a NULL id where the smallest id is sought


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (63 bits) of every text."""
    out: list[np.ndarray] = []
    for _, data, starts in A.chunks(texts):
        h, bounds = A.token_hashes(data, starts, A.PLAIN)
        acc = h.copy()
        for j in range(1, words):
            acc = A.mix(acc[:-1] * A.RADIX + h[j:]) if len(acc) > 1 else acc[:0]
        for b, e in zip(bounds[:-1], bounds[1:], strict=True):
            if e - b >= words:
                out.append(np.unique(acc[b : e - words + 1] >> np.uint64(1)))
            elif e > b:
                whole = np.array([e - b], np.uint64)
                for x in h[b:e]:
                    whole = A.mix(whole * A.RADIX + x)
                out.append(whole >> np.uint64(1))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def _lists(sets: list[np.ndarray], kind: type = np.int64) -> pa.Array:
    ends = np.cumsum([0] + [len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(kind)))


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    with np.errstate(over="ignore"):
        one = [int(A.mix(s).sum(dtype=np.uint64)) for s in sets]
        two = [int(A.mix(s * A.RADIX).sum(dtype=np.uint64)) for s in sets]
    return [pa.array(np.array(x, np.uint64).astype(np.int64)) for x in (one, two)]


def _marks(sketch: np.ndarray) -> np.ndarray:
    """A 256-bit set of the sketch's values."""
    out, at = np.zeros(4, np.uint64), sketch & np.uint64(255)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def _parity(values: np.ndarray) -> np.ndarray:
    """256 bits, each the parity of the values that fall on it: two sets differ in as many values at least as their bits."""
    odd = np.bincount((A.mix(values) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


PARITY = ("p0", "p1", "p2", "p3")
SKETCHED = "n bigint, d1 bigint, d2 bigint, b0 bigint, b1 bigint, b2 bigint, b3 bigint, p0 bigint, p1 bigint, p2 bigint, p3 bigint, sketch array<int>"


def _sketches(words: int):
    """Columns of ``SKETCHED``; a sketch has the upper half of its values, which keeps their order."""

    def run(texts: pa.Array) -> list[pa.Array]:
        sets = shingle_sets(texts, words)
        marks = np.array([_marks(s[:SKETCH]) for s in sets], np.uint64).reshape(-1, 4).astype(np.int64)
        bits = np.array([_parity(s) for s in sets], np.int64).reshape(-1, 4)
        sizes = pa.array(np.array([len(s) for s in sets], np.int64))
        columns = [pa.array(x[:, k]) for x in (marks, bits) for k in range(4)]
        return [sizes, *_digests(sets), *columns, _lists([s[:SKETCH] >> np.uint64(32) for s in sets], np.int32)]

    return run


def _signed(words: int):
    """Columns of ``SIGNED``: what tells a text's class."""

    def run(texts: pa.Array) -> list[pa.Array]:
        sets = shingle_sets(texts, words)
        return [pa.array(np.array([len(s) for s in sets], np.int64)), *_digests(sets)]

    return run


FULL = "n bigint, d1 bigint, d2 bigint, p0 bigint, p1 bigint, p2 bigint, p3 bigint, shingles array<bigint>"


def _full(words: int):
    def run(texts: pa.Array) -> list[pa.Array]:
        sets = shingle_sets(texts, words)
        bits = np.array([_parity(s) for s in sets], np.int64).reshape(-1, 4)
        columns = [pa.array(bits[:, k]) for k in range(4)]
        return [pa.array(np.array([len(s) for s in sets], np.int64)), *_digests(sets), *columns, _lists(sets)]

    return run


def _may_link(x, y, percent: int) -> Column:
    """Sizes near enough and marks in common for a link of two members; ``x`` and ``y`` give a member's column by name.

    A linked pair shares at least 18 of 40 retained values but for one in 1e7, so 14
    marks; smaller sets, all of whose values are retained, share more than 0.35 of them.
    """
    n, m = x("n"), y("n")
    common = F.lit(0)
    for k in range(4):
        common = common + F.bit_count(x(f"b{k}").bitwiseAND(y(f"b{k}")))
    near = (n * 100 >= m * percent) & (m * 100 >= n * percent) & (x("c") != y("c"))
    return near & (common >= F.least(F.lit(14), F.floor(F.least(n, m) * 0.35)))


def _keys(sketch: Column, n: Column) -> Column:
    def runs(r: int) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(sketch) - r, F.lit(0)))
        return F.transform(at, lambda i: F.xxhash64(F.lit(r), *[F.get(sketch, i + d) for d in range(r)]))

    none = F.array().cast("array<bigint>")
    return F.concat(F.when(n.between(4, 5), runs(2)).otherwise(none), F.when(n >= 5, runs(RUN)).otherwise(none))


MEMBER = ("c", "n", "b0", "b1", "b2", "b3")


def _centred(posts: DataFrame, percent: int) -> DataFrame:
    """a, b: every member of a list with its centre, the member that stands in the most of the lists (the smallest hash of equal ones).

    What the members of a family have in common makes its lists, so the member with the fewest edits of its own is in
    the most of them and is nearest to all others; the many lists of one family mostly have one centre.
    """
    often = posts.groupBy("c").agg(F.count(F.lit(1)).alias("lists"))
    rank = F.struct((-F.col("lists")).alias("few"), F.xxhash64(F.lit(0), "c").alias("h"), *MEMBER)
    centres = posts.join(often, "c").groupBy("key").agg(F.min(rank).alias("m"))
    fits = _may_link(F.col, lambda f: F.col(f"m.{f}"), percent)
    pairs = posts.join(centres, "key").where(fits)
    return pairs.select(F.least("c", "m.c").alias("a"), F.greatest("c", "m.c").alias("b")).distinct()


def _all_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """a, b: all pairs of the members of short lists (at most SHORT members each)."""
    lists = posts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*MEMBER))).alias("m"))
    lists = lists.where(F.size("m") > 1)
    first = lists.select("m", F.posexplode("m").alias("i", "x"))
    pairs = first.select("x", F.explode(F.slice("m", F.col("i") + 2, F.lit(SHORT))).alias("y"))
    pairs = pairs.where(_may_link(lambda f: F.col(f"x.{f}"), lambda f: F.col(f"y.{f}"), percent))
    return pairs.select(F.col("x.c").alias("a"), F.col("y.c").alias("b"))


def _common(n: str, m: str, percent: int) -> Column:
    """The values that two linked sets of ``n`` and ``m`` have in common at least."""
    return F.expr(f"({percent}L * ({n} + {m}) + {percent} + 99) div (100 + {percent})")


def _near_enough(n: str, m: str, parities: list[tuple[str, str]], percent: int) -> Column:
    """Parities that differ in no more bits than two linked sets may in values."""
    apart = F.lit(0)
    for x, y in parities:
        apart = apart + F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    return _common(n, m, percent) * 2 + apart <= F.col(n) + F.col(m)


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose parities and union sketch do not rule the threshold out."""
    pairs = saved(pairs, "tried")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    if ids.count() <= MAX_BROADCAST:  # only sketches that stand in a pair are dealt out
        classes = classes.join(F.broadcast(ids), "c", "left_semi")

    def side(end: str) -> DataFrame:
        return classes.select(*[F.col(x).alias(y + end) for x, y in (("c", ""), ("n", "n"), ("sketch", "s"), *zip(PARITY, PARITY))])

    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_near_enough("na", "nb", [(f"{p}a", f"{p}b") for p in PARITY], percent))
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, SKETCH)
    shared = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    whole = (F.col("na") <= SKETCH) & (F.col("nb") <= SKETCH) & (F.size(F.array_union("sa", "sb")) <= SKETCH)
    p = percent / 100
    # two values of a whole set may have one upper half
    least = F.when(whole, F.size(union) * p - 1).otherwise(F.size(union) * p - DEVIATIONS * F.sqrt(F.size(union) * p * (1 - p)))
    return both.where(shared >= least).select("a", "b")


SIGNED = "n bigint, d1 bigint, d2 bigint"


def _texts(wanted: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """c, n, p0..p3, text: one text of each of the classes ``wanted``, with their sizes and parities."""
    wanted = saved(wanted.join(classes.select("c", "rep", "d1", "d2", "n", *PARITY), "c"), "candidates")
    ids = wanted.select(F.col("rep").alias("id")).distinct()
    text = docs.select(F.coalesce("doc_id", F.lit(NONE)).alias("id"), "text")
    small = ids.count() <= MAX_BROADCAST
    text = text.join(F.broadcast(ids) if small else ids, "id", "left_semi")
    # the text of an id may be of another class: ids may repeat
    signed = A.with_columns(text.select("text"), "text", _signed(words), SIGNED)
    texts = signed.join(wanted.select("c", "d1", "d2", "n", *PARITY), ["d1", "d2", "n"]).select("c", "n", *PARITY, "text")
    texts = saved(texts, "texts")
    _gone(wanted)
    # a class comes twice only where rows of one id have one set: whole texts move for that alone
    if not texts.groupBy("c").count().where("count > 1").limit(1).count():
        return texts
    once = saved(texts.groupBy("c").agg(*[F.first(c).alias(c) for c in ("n", *PARITY, "text")]), "texts")
    _gone(texts)
    return once


def _alike(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that are linked on their full shingle sets, as a written table."""
    few = (texts.agg(F.sum("n")).first()[0] or 0) <= MAX_VALUES
    texts = F.broadcast(texts) if few else texts
    one = pairs.join(texts.select(F.col("c").alias("a"), F.col("text").alias("x")), "a")
    two = one.join(texts.select(F.col("c").alias("b"), F.col("text").alias("y")), "b")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, of = [], []
            for c in ("x", "y"):  # texts that stand in many pairs are hashed once a batch
                once = batch.column(c).dictionary_encode()
                sets.append(shingle_sets(once.dictionary, words))
                of.append(once.indices.to_pylist())
            xs, ys = sets
            fits = []
            for i, j in zip(*of):
                common = len(np.intersect1d(xs[i], ys[j], assume_unique=True))
                fits.append(common * 100 >= (len(xs[i]) + len(ys[j]) - common) * percent)
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    fits = A.mapped(two.select("a", "b", "x", "y"), linked, "a bigint, b bigint")
    return saved(_few(fits, pairs.count()), "links")


def _gone(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        for path in t.inputFiles()[:1] if t is not None else ():
            folder = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, made of tables of about ``rows`` rows, in as many partitions as that is worth: small tables cost few tasks."""
    return df.coalesce(1 + rows // PART_ROWS)


def components(links: DataFrame) -> DataFrame:
    """v, label: the smallest member of each linked node's component, for (a, b) links."""
    n = links.count()
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    edges = saved(_few(links.select(both.alias("e")).select("e.*").distinct(), n), "edges")
    labels = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label"))
    labels = saved(_few(labels, n), "labels")
    while True:
        near = edges.join(labels.select(F.col("v").alias("b"), F.col("label").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        low = labels.join(near.select(F.col("a").alias("v"), "m"), "v").select("v", F.col("label").alias("old"), F.least("label", "m").alias("m"))
        jump = labels.select(F.col("v").alias("m"), F.col("label").alias("far"))
        following = low.join(jump, "m").select("v", "old", F.least("m", "far").alias("label"))
        following = saved(_few(following, n), "labels")
        _gone(labels)
        if not following.where("label < old").limit(1).count():
            _gone(edges)
            return following.select("v", "label")
        labels = following.select("v", "label")


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """v, label after ``links`` join what ``labels`` (None at first) has: the components of the labels, not of all nodes."""
    if labels is None:
        return components(links)
    own = labels.select("v", "label")
    ends = links.join(own.select(F.col("v").alias("a"), F.col("label").alias("x")), "a", "left")
    ends = ends.join(own.select(F.col("v").alias("b"), F.col("label").alias("y")), "b", "left")
    between = ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    joined = components(saved(_few(between.where("a <> b").distinct(), links.count()), "between"))
    moved = own.join(joined.select(F.col("v").alias("label"), F.col("label").alias("to")), "label", "left")
    moved = moved.select("v", F.coalesce("to", "label").alias("label"))
    fresh = joined.join(own.select("v"), "v", "left_anti")
    out = saved(_few(moved.unionByName(fresh), labels.count() + links.count()), "labels")
    _gone(labels, joined)
    return out


def _grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    signed = saved(A.with_columns(rows, "text", _sketches(words), SKETCHED, False), "sketches")
    ids, first = F.coalesce("doc_id", F.lit(NONE)), [F.first(c).alias(c) for c in ("b0", "b1", "b2", "b3", *PARITY, "sketch")]
    classes = signed.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(ids).alias("rep"), *first)
    classes = saved(classes.withColumn("c", F.monotonically_increasing_id()), "classes")  # the written table fixes the numbers
    marks = _labels(classes, docs, words, percent)
    if marks is None:
        named = classes.select("d1", "d2", "n", F.col("rep").alias("least"))
    else:
        placed = classes.join(marks, classes["c"] == marks["v"], "left")
        placed = placed.select("d1", "d2", "n", "rep", F.coalesce("label", "c").alias("label"))
        named = placed.join(placed.groupBy("label").agg(F.min("rep").alias("least")), "label").select("d1", "d2", "n", "least")
    rows = signed.select("doc_id", "text_hash", "n", "d1", "d2").join(named, ["d1", "d2", "n"], "left")
    least = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.when(F.col("least") < NONE, F.col("least")))
    rows = rows.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), least.alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def grouped(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (smallest id of its group) and kept."""
    return _grouped(docs, words, percent).drop("text_hash")


def _labels(classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame | None:
    """v, label of every linked class; None without any link."""
    posts = classes.select("c", F.explode(F.array_distinct(_keys(F.col("sketch"), F.col("n")))).alias("key"))
    posts = posts.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("size > 1")
    posts = posts.join(classes.select(*MEMBER), "c")
    posts = saved(posts, "lists")
    long = saved(posts.where(F.col("size") > SHORT).drop("size"), "long")
    n_long = long.count()
    tried = _all_pairs(posts.where(F.col("size") <= SHORT), percent)
    if n_long:
        tried = tried.unionByName(_centred(long, percent))
    seen = saved(_estimated(tried.distinct(), classes, percent), "pairs")
    found = _checked(seen, classes, docs, words, percent)
    labels = None if found is None else components(found)
    _gone(posts, found)
    if not n_long:
        return labels
    rest = long.withColumn("label", F.col("c"))
    if labels is not None:
        rest = long.join(labels, long["c"] == labels["v"], "left").drop("v").withColumn("label", F.coalesce("label", "c"))
    ends = rest.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"))
    rest = saved(_few(rest.join(ends.where("x < y").select("key"), "key").select("c", "label").distinct(), n_long), "rest")
    _gone(long)
    return _settled(rest, seen, labels, classes, docs, words, percent)


def _settled(
    rest: DataFrame, seen: DataFrame, labels: DataFrame | None, classes: DataFrame, docs: DataFrame, words: int, percent: int
) -> DataFrame | None:
    """``labels`` after every pair of classes of ``rest`` that may be linked and lies between two components."""
    texts = _texts(rest.select("c"), classes, docs, words)
    sets = A.with_columns(texts.select("c", "text"), "text", _full(words), FULL, False)
    pairs = _estimated(_between(rest, sets, percent).join(seen, ["a", "b"], "left_anti"), classes, percent)
    pairs = saved(pairs, "pairs")
    found = _alike(pairs, texts, words, percent)
    labels = merged(labels, found) if found.limit(1).count() else labels
    _gone(texts, pairs, found, rest)
    return labels


def _between(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs of classes of two components that a prefix filter over their whole sets lets through.

    Values that only one class has link nothing, values that everyone has would link all; with all values in one
    order, rare ones first, two sets of n <= m values that are alike share one of the first
    n - ceil(2p / (1 + p) n) + 1 of the smaller with one of the first m - ceil(p m) + 1 of the larger.  A text whose
    own words fill its prefix is compared with nothing; a passage in thousands of texts stands behind
    their prefixes and is never expanded.  What share a value must also have room for enough common values
    behind it, and parities that differ in no more bits than the sets may in values.
    """
    values = sets.select("c", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    often = values.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    shared = values.join(often, "key").groupBy("c", "n").agg(F.array_sort(F.collect_list(F.struct("often", "key"))).alias("x"))
    alone = F.col("n") - F.size("x")  # values of this class only come first
    probe = F.col("n") - F.expr(f"({percent}L * n + 99) div 100") + 1
    index = F.col("n") - F.expr(f"(2 * {percent}L * n + {percent} + 99) div (100 + {percent})") + 1
    first = shared.select("c", "n", alone.alias("alone"), index.alias("index"), F.posexplode(F.slice("x", F.lit(1), F.greatest(probe - alone, F.lit(0)).cast("int"))).alias("at", "x"))
    place = F.col("alone") + F.col("at") + 1
    posts = first.select("c", "n", F.col("x.key").alias("key"), place.alias("place"), (place <= F.col("index")).alias("short")).join(rest, "c")
    mixed = posts.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    posts = saved(posts.join(mixed, "key").join(sets.select("c", *PARITY), "c"), "prefixes")
    y = posts.select("key", *[F.col(f).alias(f"{f}_y") for f in ("c", "n", "place", "label", *PARITY)])
    # of the first value they share nothing lies before it, so what lies behind must suffice
    need = _common("n", "n_y", percent)
    enough = F.least(F.col("n") - F.col("place"), F.col("n_y") - F.col("place_y")) + 1 >= need
    near = (F.col("n") * 100 >= F.col("n_y") * percent) & (F.col("label") != F.col("label_y"))
    after = (F.col("n") < F.col("n_y")) | ((F.col("n") == F.col("n_y")) & (F.col("c") < F.col("c_y")))
    fits = _near_enough("n", "n_y", [(p, f"{p}_y") for p in PARITY], percent)
    pairs = posts.where("short").join(y, "key").where(near & after & enough & fits)
    return pairs.select(F.least("c", "c_y").alias("a"), F.greatest("c", "c_y").alias("b")).distinct()


def _checked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame | None:
    """The linked ones of the candidate pairs, or None."""
    if not pairs.limit(1).count():
        return None
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), classes, docs, words)
    found = _alike(pairs, texts, words, percent)
    _gone(texts)
    return found if found.limit(1).count() else None


def deduplicated(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group with all its columns: the one with the smallest id."""
    rows = saved(_grouped(docs, words, percent), "groups")
    gone = rows.where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_text")).distinct()
    small = gone.count() <= MAX_BROADCAST
    same = docs["doc_id"].eqNullSafe(gone["_gone"]) & (F.xxhash64(docs["text"]) == gone["_text"])
    out = docs.join(F.broadcast(gone) if small else gone, same, "left_anti")
    twice = rows.where("kept AND n_shingles > 0").groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    return out.dropDuplicates(["doc_id", "text"]) if twice else out
