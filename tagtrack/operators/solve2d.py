"""Planar position from ranges.

The linear least-squares system depends on the anchors only, so its
pseudo-inverse is a property of the layout: a position is a constant plus a
weighted sum of squared ranges.  That makes the solver a projection on tick
rows, and one combinable ``sum`` per axis on long range rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtrack import constants as K
from tagtrack.functions.geometry import circle_pair
from tagtrack.operators import align

Layout = Mapping[int, tuple[float, ...]]


def layout_weights(layout: Layout) -> tuple[dict[int, tuple[float, float]], tuple[float, float]] | None:
    """Per-anchor weights on the squared range and the constant term, or None.

    None means no unique solution: fewer than three anchors, or collinear ones.
    """
    ids = sorted(layout)
    if len(ids) < 3:
        return None
    x0, y0 = layout[ids[0]][:2]
    rows = [(2.0 * (layout[i][0] - x0), 2.0 * (layout[i][1] - y0)) for i in ids[1:]]
    known = [layout[i][0] ** 2 + layout[i][1] ** 2 - x0**2 - y0**2 for i in ids[1:]]
    aa, ab, bb = (sum(r[i] * r[j] for r in rows) for i, j in ((0, 0), (0, 1), (1, 1)))
    det = aa * bb - ab * ab
    if abs(det) < K.SINGULAR:
        return None
    pinv = [((bb * a - ab * b) / det, (aa * b - ab * a) / det) for a, b in rows]
    weights = {i: (-p[0], -p[1]) for i, p in zip(ids[1:], pinv)}
    weights[ids[0]] = (sum(p[0] for p in pinv), sum(p[1] for p in pinv))
    const = tuple(sum(p[axis] * k for p, k in zip(pinv, known)) for axis in (0, 1))
    return weights, const


def position(layout: Layout, col=align.dist_col) -> tuple[Column, Column]:
    """(x, y) from the tick's distance columns; NULL when any active range is missing."""
    solved = layout_weights(layout)
    if solved is None:
        none = F.lit(None).cast("double")
        return none, none
    weights, const = solved
    axes = []
    for axis in (0, 1):
        total = F.lit(const[axis])
        for a in sorted(weights):
            total = total + F.lit(weights[a][axis]) * F.col(col(a)) * F.col(col(a))
        axes.append(total)
    return axes[0], axes[1]


def pair_points(layout: Layout, col=align.dist_col) -> Column:
    """Candidate points of a two-anchor layout; empty unless both ranges are there."""
    none = F.array().cast("array<struct<x:double,y:double>>")
    if len(layout) != 2:
        return none
    a, b = sorted(layout)
    (ax, ay), (bx, by) = layout[a][:2], layout[b][:2]
    both = F.col(col(a)).isNotNull() & F.col(col(b)).isNotNull()
    pts = circle_pair(F.lit(ax), F.lit(ay), F.col(col(a)), F.lit(bx), F.lit(by), F.col(col(b)))
    return F.when(both, pts).otherwise(none)


#: rows of an anchor table that are broadcast at most
MAX_ANCHORS = 10_000


def weight_table(anchors: DataFrame) -> DataFrame:
    """The same weights for every layout of an anchor table.

    A layout has a handful of anchors, so the window per layout is bounded.
    Layouts without a unique solution are left out.
    """
    w = Window.partitionBy("layout_id")
    first = w.orderBy("anchor_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x0, y0 = F.first("ax").over(first), F.first("ay").over(first)
    rel = anchors.select(
        "layout_id",
        "anchor_id",
        (F.lit(2.0) * (F.col("ax") - x0)).alias("a"),
        (F.lit(2.0) * (F.col("ay") - y0)).alias("b"),
        (F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay") - x0 * x0 - y0 * y0).alias("k"),
        (F.min("anchor_id").over(w) == F.col("anchor_id")).alias("is_ref"),
        F.count(F.lit(1)).over(w).alias("n_active"),
    )
    sums = rel.select(
        "*",
        F.sum(F.col("a") * F.col("a")).over(w).alias("aa"),
        F.sum(F.col("a") * F.col("b")).over(w).alias("ab"),
        F.sum(F.col("b") * F.col("b")).over(w).alias("bb"),
    ).withColumn("det", F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab"))
    usable = sums.where((F.col("n_active") >= 3) & (F.abs("det") >= K.SINGULAR))
    px = (F.col("bb") * F.col("a") - F.col("ab") * F.col("b")) / F.col("det")
    py = (F.col("aa") * F.col("b") - F.col("ab") * F.col("a")) / F.col("det")
    inv = usable.select("layout_id", "anchor_id", "is_ref", "n_active", "k", px.alias("px"), py.alias("py"))

    def weight(p: str) -> Column:
        return F.when(F.col("is_ref"), F.sum(p).over(w)).otherwise(-F.col(p))

    return inv.select(
        "layout_id",
        "anchor_id",
        "n_active",
        weight("px").alias("wx"),
        weight("py").alias("wy"),
        F.sum(F.col("px") * F.col("k")).over(w).alias("cx"),
        F.sum(F.col("py") * F.col("k")).over(w).alias("cy"),
    )


def solve_long(ranges: DataFrame, anchors: DataFrame, keys: Sequence[str] = (*align.KEYS, "t")) -> DataFrame:
    """Positions straight from long range rows that carry ``layout_id``.

    Ticks that miss an active anchor are dropped; of an anchor's repeats on a tick
    the last arrival counts.  Rows move once, by tick.  The weight table is
    broadcast after a check of its size; a larger one is left to the optimizer.
    """
    sq = F.col("distance_cm") * F.col("distance_cm")
    weights = weight_table(anchors)
    small = len(anchors.limit(MAX_ANCHORS + 1).collect()) <= MAX_ANCHORS
    by_tick = ranges.repartition(*keys)
    if "arrival" in ranges.columns:
        by_tick = by_tick.groupBy(*keys, "layout_id", "anchor_id").agg(
            F.max_by("distance_cm", "arrival").alias("distance_cm")
        )
    return (
        by_tick.join(F.broadcast(weights) if small else weights, ["layout_id", "anchor_id"])
        .groupBy(*keys)
        .agg(
            F.sum(F.col("wx") * sq).alias("_x"),
            F.sum(F.col("wy") * sq).alias("_y"),
            F.first("cx").alias("_cx"),
            F.first("cy").alias("_cy"),
            F.count("distance_cm").alias("_n"),
            F.first("n_active").alias("_m"),
        )
        .where("_n = _m")
        .select(*keys, (F.col("_x") + F.col("_cx")).alias("x"), (F.col("_y") + F.col("_cy")).alias("y"))
    )
