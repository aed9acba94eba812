"""Near-duplicates among embeddings with spherical-cap filters.

A filter is a direction and the cap of vectors whose inner product with it exceeds
``alpha``. The directions are a structured random product code: the (randomly turned)
space is cut into ``m`` blocks, a block has ``B`` random unit words, and a direction is one
word of every block, so ``R`` codes give R * B**m directions from R * m * B words. A vector is
list-decoded to all directions that exceed: only words that can still reach ``alpha``
with the best words of the other blocks are combined. Two vectors are compared where they share a filter.

``alpha`` follows from the number of vectors: a direction's cap holds about a quarter of an
unrelated vector (``LOAD``), whatever the size of the table, and there are as many
directions as let a pair at the very threshold share ``SHARED`` filters on average. So
candidates stay in proportion to the rows; a pair shares none with a probability below 1e-3
(none of 4,000 measured for two and three blocks; tests/llm measure it on a table).

Groups of copies cost no pairs. Equal vectors are one *class*. Classes that crowd a
filter gather in *balls* round a pivot, all within the link angle of it, and filters, pairs and links are
between balls and single vectors, the *units*. Angles to the pivots decide most of them for all members at once:
``angle(a, b) + r_a + r_b`` within the limit links every member of one with every member of the other, ``angle(a, b) - r_a - r_b``
beyond it none. What angles leave open is counted exactly, member by member, in blocks; only counts leave a block.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite components have no
links and are their own component; vectors of different lengths are not linked; equal vectors are
linked; a repeated row is another vector; NULL ids are kept where no other id is in their component; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtrack.llm.common import saved
from tagtrack.llm.neardup import components

LOAD = 0.25
#: filters that a pair at the threshold shares on average, and codes, by number of blocks: more blocks vary more
SHARED, CODES = {1: 24, 2: 24, 3: 48, 4: 96}, {1: 16, 2: 16, 3: 24, 4: 32}
MAX_WORDS = 2048
#: members of a filter that make it crowded, and of a block that numpy compares at once
CROWD, BLOCK = 64, 1024
#: a round of balls that places fewer than this part of the crowded classes is the last
WORTH = 0.1
SEED = 20
ULP = 1e-7


def cap(alpha: float, d: int) -> float:
    """The part of the unit sphere of ``d`` dimensions whose first coordinate is at least ``alpha``."""
    if alpha >= 1 or d < 2:
        return 0.5 if d < 2 and alpha <= 1 else 0.0
    if alpha <= -1:
        return 1.0
    angle = np.linspace(0, math.pi, 4001)
    weight = np.sin(angle) ** (d - 2) if d > 2 else np.ones_like(angle)
    total = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
    return float(np.interp(math.acos(alpha), angle, total) / total[-1])


def both_in(alpha: float, cosine: float, d: int) -> float:
    """The part of the vectors in a cap whose partner at ``cosine`` is there too."""
    if d < 3:
        return 0.5
    a = np.linspace(alpha, 1, 402)[1:-1]
    weight = (1 - a * a) ** ((d - 3) / 2)
    reach = (alpha - a * cosine) / (np.sqrt(1 - a * a) * math.sqrt(max(1 - cosine * cosine, 1e-12)))
    return float((weight * [cap(x, d - 1) for x in reach]).sum() / weight.sum())


@dataclass(frozen=True)
class Code:
    """The directions for ``n`` vectors of ``d`` dimensions: blocks, words a block, codes, and the height of the caps."""

    d: int
    m: int
    words: int
    codes: int
    alpha: float

    def book(self, code: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The turn of one code, and its words by block (a column each)."""
        rng = np.random.default_rng([SEED, self.d, self.m, self.words, code])
        q, r = np.linalg.qr(rng.normal(size=(self.d, self.d)))
        words = [rng.normal(size=(len(b), self.words)) for b in np.array_split(np.arange(self.d), self.m)]
        return q * np.sign(np.diag(r)), [w / np.linalg.norm(w, axis=0) for w in words]


def code_for(n: int, d: int, cosine: float) -> Code:
    """More vectors, more and smaller caps; caps stay wide enough for a pair at the threshold to share some."""
    top = math.cos(min(1.4 * math.acos(cosine), 1.5))
    for m in range(min(2, d), min(4, d) + 1):
        low, high = 0.0, top
        for _ in range(40):
            alpha = (low + high) / 2
            low, high = (alpha, high) if cap(alpha, d) * max(n, 1) > LOAD else (low, alpha)
        alpha = low
        directions = SHARED[m] / max(both_in(alpha, cosine, d), 1e-3) / max(cap(alpha, d), 1e-300)
        words = max(2, math.ceil((directions / CODES[m]) ** (1 / m)))
        if words <= MAX_WORDS:
            break
    return Code(d, m, words, CODES[m], alpha)


def decoded(x: np.ndarray, code: Code) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(code number, rows, directions): all directions of every code whose inner product with a unit row is at least alpha."""
    bar = code.alpha * math.sqrt(code.m)
    bounds = np.cumsum([0] + [len(b) for b in np.array_split(np.arange(code.d), code.m)])
    for k in range(code.codes):
        turn, words = code.book(k)
        y = x @ turn
        near = [y[:, a:b] @ w for a, b, w in zip(bounds[:-1], bounds[1:], words, strict=True)]
        best = np.stack([s.max(axis=1) for s in near])
        rows, sums, at = np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x), np.int64)
        for i, s in enumerate(near):
            r, j = np.nonzero(s >= (bar - best.sum(axis=0) + best[i])[:, None])  # words that can reach the bar at all
            first = np.searchsorted(r, np.arange(len(x) + 1))
            many = (first[1:] - first[:-1])[rows]
            ends = np.cumsum(many)
            take = np.repeat(first[rows] - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)
            back = np.repeat(np.arange(len(rows)), many)
            total = sums[back] + s[r[take], j[take]]
            fits = total >= bar - best[i + 1 :].sum(axis=0)[rows[back]]
            rows, sums, at = rows[back][fits], total[fits], (at[back] * code.words + j[take])[fits]
        yield k, rows, at


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    """Equally long lists as the rows of a matrix."""
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()).astype(float)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _filters(code: Code) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                c = part.column("c").to_numpy()
                for k, rows, place in decoded(unit_rows(_matrix(part.column("v"))), code):
                    f = place + k * code.words**code.m
                    yield pa.RecordBatch.from_arrays([pa.array(c[rows]), pa.array(f)], ["c", "f"])

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = unit_rows(_matrix(batch.column("x"))), unit_rows(_matrix(batch.column("y")))
            names = [n for n in batch.schema.names if n not in ("x", "y")]
            near = pa.array(np.einsum("ij,ij->i", x, y))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), near], [*names, "near"])


def _with_cosine(pairs: DataFrame) -> DataFrame:
    """``near``, the cosine of x and y, in their place."""
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields if f.name not in ("x", "y")]
    return pairs.mapInArrow(_cosines, ", ".join([*kept, "near double"]))


def _angle(near: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), near)))


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _balls(posts: DataFrame, classes: DataFrame, cosine: float) -> DataFrame | None:
    """c, u, near: the classes of crowded filters that lie within the link angle of a pivot u, and their cosine with it."""
    done, placed_before = None, 0
    crowds = posts.groupBy("f").count().where(F.col("count") >= CROWD).select("f")
    crowded = saved(posts.join(crowds, "f", "left_semi"), "crowded")
    salt = 0
    while crowded.limit(1).count():
        salt += 1
        rest = crowded if done is None else crowded.join(done.select("c"), "c", "left_anti")
        sizes = rest.groupBy("f").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= CROWD)
        home = rest.join(sizes, "f").groupBy("c").agg(F.max(F.struct("size", "f")).alias("h")).select("c", F.col("h.f").alias("f"))
        home = saved(home, "home")
        n = home.count()
        if not n:
            break
        pivots = home.groupBy("f").agg(F.min(F.struct(F.xxhash64(F.lit(salt), "c"), F.col("c"))).alias("p")).select("f", F.col("p.c").alias("u"))
        pivots = pivots.join(classes.select(F.col("c").alias("u"), F.col("v").alias("y")), "u")
        both = home.join(pivots, "f").join(classes.select("c", F.col("v").alias("x")), "c").select("c", "u", "x", "y")
        found = saved(_with_cosine(both).where(F.col("near") >= cosine), "balls")
        done = found if done is None else done.unionByName(found)
        placed = done.count()
        if placed - placed_before < WORTH * n:
            break
        placed_before = placed
    return done


def _small_pairs(posts: DataFrame, sizes: DataFrame) -> DataFrame:
    """u, w: all pairs of the units of filters with fewer than CROWD of them."""
    lists = posts.join(sizes.where(F.col("size") < CROWD).select("f"), "f").groupBy("f").agg(F.sort_array(F.collect_list("u")).alias("m"))
    first = lists.select("m", F.posexplode("m").alias("i", "u"))
    return first.select("u", F.explode(F.slice("m", F.col("i") + 2, F.lit(CROWD))).alias("w"))


def _in_blocks(rows: DataFrame, group: list[str], size: Column, block: int) -> DataFrame:
    """The rows of each group dealt over blocks, a copy for every pair of blocks (i <= j) that a block is in."""
    rows = rows.withColumn("_n", F.ceil(size / block).cast("int"))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(F.lit(3), *[c for c in ("u", "c") if c in rows.columns]), F.col("_n")).cast("int"))
    return rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select(
        "*", F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j")
    )


def _large_pairs(posts: DataFrame, sizes: DataFrame, units: DataFrame, cosine: float) -> DataFrame:
    """u, w: the pairs of the units of crowded filters that may hold a link, compared in blocks."""
    limit = math.acos(cosine) + ULP
    rows = posts.join(sizes.where(F.col("size") >= CROWD), "f").join(units.select("u", "v", "r"), "u")
    rows = _in_blocks(rows, ["f"], F.col("size"), BLOCK)

    def near(part: pd.DataFrame) -> pd.DataFrame:
        i, j = int(part["i"].iloc[0]), int(part["j"].iloc[0])
        a, b = part[part["_b"] == i], part[part["_b"] == j]
        x, y = (unit_rows(_matrix(s["v"])) if len(s) else np.zeros((0, 1)) for s in (a, b))
        if not len(a) or not len(b):
            return pd.DataFrame({"u": pd.Series(dtype="int64"), "w": pd.Series(dtype="int64")})
        angle = np.arccos(np.clip(x @ y.T, -1, 1)) - a["r"].to_numpy()[:, None] - b["r"].to_numpy()[None, :]
        p, q = np.nonzero(angle <= limit)
        u, w = a["u"].to_numpy()[p], b["u"].to_numpy()[q]
        once = (u < w) if i == j else (u != w)
        return pd.DataFrame({"u": np.minimum(u, w)[once], "w": np.maximum(u, w)[once]})

    return rows.groupBy("f", "i", "j").applyInPandas(near, "u long, w long")


def _counted(open_pairs: DataFrame, members: DataFrame, sizes: DataFrame, cosine: float) -> DataFrame:
    """u, w, c, links: the links that members of a pair of units have in the other unit, counted in blocks; u = w is one unit with itself."""
    mine, of = members.select("u", "c", "v", "n"), sizes.select("u", "members")
    wide = F.sqrt(F.col("m_u").cast("double") * F.col("m_w"))  # balanced blocks: some BLOCK members of either side
    pairs = open_pairs.join(of.select("u", F.col("members").alias("m_u")), "u").join(of.select(F.col("u").alias("w"), F.col("members").alias("m_w")), "w")
    pairs = pairs.select("u", "w", F.ceil(F.least(F.col("m_u"), wide) / BLOCK).cast("int").alias("k_u"), F.ceil(F.col("m_w") / BLOCK).cast("int").alias("k_w"))
    pairs = pairs.withColumn("k_u", F.when(F.col("u") == F.col("w"), F.col("k_w")).otherwise(F.col("k_u")))

    def part(k: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(5), "c"), F.col(k)).cast("int")

    left = pairs.join(mine, "u").withColumn("i", part("k_u")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k_w") - 1)))
    right = pairs.join(mine.withColumnRenamed("u", "w"), "w").withColumn("j", part("k_w")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k_u") - 1)))
    cols = ["u", "w", "i", "j", "c", "v", "n"]
    rows = left.select(*cols, F.lit(0).alias("side")).unionByName(right.select(*cols, F.lit(1).alias("side")))

    def count(part: pd.DataFrame) -> pd.DataFrame:
        a, b = part[part["side"] == 0], part[part["side"] == 1]
        u, w = int(part["u"].iloc[0]), int(part["w"].iloc[0])
        if not len(a) or not len(b):
            return pd.DataFrame({"u": [], "w": [], "c": [], "links": []}).astype("int64")
        linked = (unit_rows(_matrix(a["v"])) @ unit_rows(_matrix(b["v"])).T) >= cosine
        linked &= a["c"].to_numpy()[:, None] != b["c"].to_numpy()[None, :]
        out = [pd.DataFrame({"c": a["c"], "links": linked @ b["n"].to_numpy()})]
        if u != w:  # a unit with itself has every block on either side already
            out.append(pd.DataFrame({"c": b["c"], "links": linked.T @ a["n"].to_numpy()}))
        out = pd.concat(out)
        return out[out["links"] > 0].assign(u=u, w=w)[["u", "w", "c", "links"]]

    return rows.groupBy("u", "w", "i", "j").applyInPandas(count, "u long, w long, c long, links long")


def _linked_units(units: DataFrame, posts: DataFrame, cosine: float) -> DataFrame:
    """u, w, sure: pairs of units with a link for certain between all members, or perhaps between some (u = w: inside one)."""
    sizes = posts.groupBy("f").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    pairs = _small_pairs(posts, sizes).unionByName(_large_pairs(posts, sizes, units, cosine)).distinct()
    x = units.select("u", F.col("v").alias("x"), F.col("r").alias("r_u"))
    y = units.select(F.col("u").alias("w"), F.col("v").alias("y"), F.col("r").alias("r_w"))
    both = _with_cosine(pairs.join(x, "u").join(y, "w").select("u", "w", "r_u", "r_w", "x", "y"))
    angle, limit = _angle(F.col("near")), math.acos(cosine)
    reach = F.col("r_u") + F.col("r_w")
    single = reach == 0
    sure = F.when(single, F.col("near") >= cosine).otherwise(angle + reach <= limit - ULP)
    some = F.when(single, F.col("near") >= cosine).otherwise(angle - reach <= limit + ULP)
    inside = units.where("members > 1").select("u", F.col("u").alias("w"), (F.col("r") * 2 <= limit - ULP).alias("sure"))
    return both.where(some).select("u", "w", sure.alias("sure")).unionByName(inside)


def linked(vectors: DataFrame, vector: str, cosine: float) -> DataFrame:
    """c, h1, h2, links, least: per class of equal vectors of one length its links to other classes and the smallest id of its component."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") + 0.0)  # one zero
    rows = vectors.select("id", F.col(vector)).where(_usable(F.col(vector))).select("id", v.alias("v"))
    classes = rows.groupBy("v").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    classes = saved(classes.select(F.monotonically_increasing_id().alias("c"), "v", "low", "n"), "classes")
    parts = []
    for d, n in sorted((r["d"], r["n"]) for r in classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()):
        same = classes.where(F.size("v") == d)
        parts.append(_linked_of(same, code_for(n, d, cosine), cosine))
    if not parts:
        return classes.select(*_keys(F.col("v")), F.col("n").alias("links"), F.col("low").alias("least"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _keys(v: Column) -> list[Column]:
    return [F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(7), v).alias("h2")]


def _linked_of(classes: DataFrame, code: Code, cosine: float) -> DataFrame:
    posts = saved(classes.select("c", "v").mapInArrow(_filters(code), "c long, f long"), "filters")
    placed = _balls(posts, classes, cosine)
    if placed is None:
        members = classes.select("c", F.col("c").alias("u"), F.lit(0.0).alias("angle"), "v", "n", "low")
        unit_posts = posts.select(F.col("c").alias("u"), "f")
    else:
        own = F.when(F.col("c") == F.col("u"), F.lit(0.0)).otherwise(_angle(F.col("near")))
        placed = saved(placed.select("c", "u", own.alias("angle")), "placed")
        members = classes.join(placed, "c", "left").select("c", F.coalesce("u", "c").alias("u"), F.coalesce("angle", F.lit(0.0)).alias("angle"), "v", "n", "low")
        unit_posts = posts.join(placed.select("c", "u"), "c", "left").select(F.coalesce("u", "c").alias("u"), "f").distinct()
    sizes = members.groupBy("u").agg(F.max("angle").alias("r"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("members"), F.min("low").alias("low"))
    units = saved(sizes.join(classes.select(F.col("c").alias("u"), "v"), "u"), "units")
    pairs = saved(_linked_units(units, unit_posts, cosine), "linked-units")
    counted = saved(_counted(pairs.where("NOT sure").select("u", "w"), members, units, cosine), "counted")
    certain = pairs.where("sure AND u <> w")
    edges = certain.select("u", "w").unionByName(counted.where("u <> w").select("u", "w")).distinct()
    marks = components(saved(edges.select(F.col("u").alias("a"), F.col("w").alias("b")), "links"))
    total = units.select(F.col("u").alias("w"), "rows")
    ends = certain.select("u", "w").unionByName(certain.select(F.col("w").alias("u"), F.col("u").alias("w")))
    outside = ends.join(total, "w").groupBy("u").agg(F.sum("rows").alias("outside"))
    inside = pairs.where("sure AND u = w").select("u").join(units.select("u", F.col("rows").alias("inside")), "u")
    singly = counted.groupBy("c").agg(F.sum("links").alias("singly"))
    least = units.join(marks, units["u"] == marks["v"], "left").select("u", "low", F.coalesce("label", "u").alias("label"))
    least = least.join(least.groupBy("label").agg(F.min("low").alias("least")), "label").select("u", "least")
    per_unit = units.select("u").join(outside, "u", "left").join(inside, "u", "left").join(least, "u")
    out = members.join(per_unit, "u").join(singly, "c", "left")
    zero = F.lit(0)
    among = F.when(F.col("inside").isNotNull(), F.col("inside") - 1).otherwise(F.col("n") - 1)  # its equals, and all of a ball that is linked throughout
    links = among + F.coalesce("outside", zero) + F.coalesce("singly", zero)
    return out.select(*_keys(F.col("v")), links.cast("long").alias("links"), "least")


def grouped(df: DataFrame, id: str = "vec_id", vector: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """A row per vector: its id, n_links (vectors at ``cosine`` or more), component_id (smallest id reachable by links) and kept."""
    rows = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").alias("vector"))
    found = linked(rows, "vector", cosine)
    v = F.transform("vector", lambda x: x.cast("double") + 0.0)
    keyed = rows.select("id", *[F.when(_usable(F.col("vector")), k).alias(n) for k, n in zip(_keys(v), ("h1", "h2"), strict=True)])
    out = keyed.join(found, ["h1", "h2"], "left")
    least = F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select(
        F.col("id").alias(id), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), least.alias("component_id"),
        F.col("id").eqNullSafe(least).alias("kept"),
    )
