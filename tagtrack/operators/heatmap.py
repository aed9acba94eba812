"""Occupancy grid of the court, its smoothing and colours.

Grids stay sparse until the end: cells with hits are spread to their
neighbours by an inline 7x7 stencil, and only a dense report adds empty cells.
A grid has at most rows x cols cells, so per-grid windows are bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtrack import constants as K
from tagtrack.functions import geometry as G
from tagtrack.operators import align


#: rows of a band of the grid
BAND = 12


def heat(positions: DataFrame, keys: Sequence[str] = align.KEYS, until: float | None = None) -> DataFrame:
    """Hits per cell from in-court positions; ``until`` freezes a snapshot time."""
    placed = positions.where(G.on_court(F.col("x"), F.col("y")))
    if until is not None:
        placed = placed.where(F.col("t") <= F.lit(until))
    return (
        placed.select(*keys, G.heat_row(F.col("y")).alias("row"), G.heat_col(F.col("x")).alias("col"))
        .groupBy(*keys, "row", "col")
        .agg(F.count(F.lit(1)).alias("hits"))
    )


def interval_of(t: Column, times: Sequence[float]) -> Column:
    """Number of the first of the ascending ``times`` that is not before ``t``; as many as there are beyond the last.

    A tree of comparisons, so a row costs the logarithm of the number of times.
    """
    if not times:
        return F.lit(0)
    half = len(times) // 2
    right = interval_of(t, times[half + 1 :]) + (half + 1)
    return F.when(t <= F.lit(float(times[half])), interval_of(t, times[:half])).otherwise(right)


def heat_snapshots(positions: DataFrame, times: Sequence[float], keys: Sequence[str] = align.KEYS) -> DataFrame:
    """Occupancy as it stood at each of ``times``: keys, snapshot_id, heat_version, row, col, hits.

    ``snapshot_id`` is the place of the time in ``times``, ``heat_version`` the in-court samples
    of the key up to it: the same version means the same grid. Positions are read once and
    counted per cell and interval between two snapshots; a cell's running count then stands
    for every snapshot until the cell changes again. Windows span the intervals of a cell, one row each.
    A key has no rows for snapshots before its first in-court sample; equal times give equal
    grids; no times, or only NULL and NaN ones, no rows.
    """
    keys = list(keys)
    known = [(float(at), i) for i, at in enumerate(times) if at is not None and at == at]
    moments = sorted({at for at, _ in known})
    placed = positions.where(G.on_court(F.col("x"), F.col("y")))
    placed = placed.where(F.col("t") <= F.lit(moments[-1]) if moments else F.lit(False))
    cells = placed.select(
        *keys, G.heat_row(F.col("y")).alias("row"), G.heat_col(F.col("x")).alias("col"),
        interval_of(F.col("t"), moments).alias("_i"),
    )
    deltas = cells.groupBy(*keys, "row", "col", "_i").agg(F.count(F.lit(1)).alias("_n"))
    here = Window.partitionBy(*keys, "row", "col").orderBy("_i")
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = F.coalesce(F.lead("_i").over(here), F.lit(len(moments))) - 1
    lasting = deltas.select(*keys, "row", "col", "_i", F.sum("_n").over(so_far).alias("hits"), until.alias("_until"))
    grids = lasting.withColumn("_i", F.explode(F.sequence("_i", "_until")))
    versions = deltas.groupBy(*keys, "_i").agg(F.sum("_n").alias("_n"))
    later = Window.partitionBy(*keys).orderBy("_i")
    versions = versions.select(
        *keys, F.col("_i").alias("_from"),
        F.sum("_n").over(later.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("heat_version"),
        (F.coalesce(F.lead("_i").over(later), F.lit(len(moments))) - 1).alias("_last"),
    )
    versions = versions.select(*keys, F.explode(F.sequence("_from", "_last")).alias("_i"), "heat_version")
    ids = [F.array(*[F.lit(i) for at, i in known if at == moment]) for moment in moments] or [F.array(F.lit(0))]
    named = F.explode(F.get(F.array(*ids), F.col("_i"))).alias("snapshot_id")
    return grids.join(versions, [*keys, "_i"]).select(*keys, named, "heat_version", "row", "col", "hits")


def heat_summary(grid: DataFrame, keys: Sequence[str] = align.KEYS) -> DataFrame:
    """Version (number of in-court samples), peak and filled cells of each grid."""
    return grid.groupBy(*keys).agg(
        F.sum("hits").alias("version"), F.max("hits").alias("max_hits"), F.count(F.lit(1)).alias("cells")
    )


def _stencil(radius: int) -> Column:
    span = range(-radius, radius + 1)
    return F.array(
        *[
            F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(1.0 / (1 + dx * dx + dy * dy)).alias("w"))
            for dy in span
            for dx in span
        ]
    )


def _inside(row: Column, col: Column) -> Column:
    return row.between(0, K.HEAT_ROWS - 1) & col.between(0, K.HEAT_COLS - 1)


def kernel_sums(grid: DataFrame, radius: int = K.HEAT_RADIUS, keys: Sequence[str] = align.KEYS) -> DataFrame:
    """Weighted hits reaching each cell, before normalisation.

    A cell is sent to its band of rows and lent to the next one where it reaches
    that, once or twice in all; the stencil is applied and summed inside the band.
    """
    first, last = F.col("row") - radius, F.col("row") + radius
    reach = F.sequence(F.floor(F.greatest(first, F.lit(0)) / BAND), F.floor(F.least(last, F.lit(K.HEAT_ROWS - 1)) / BAND))
    bands = grid.select(*keys, "row", "col", "hits", F.explode(reach).alias("_band")).repartition(*keys, "_band")
    spread = bands.select(*keys, "_band", "row", "col", "hits", F.explode(_stencil(radius)).alias("_k"))
    moved = spread.select(
        *keys,
        "_band",
        (F.col("row") + F.col("_k.dy")).alias("row"),
        (F.col("col") + F.col("_k.dx")).alias("col"),
        (F.col("hits") * F.col("_k.w")).alias("_v"),
    )
    return (
        moved.where(_inside(F.col("row"), F.col("col")) & (F.floor(F.col("row") / BAND) == F.col("_band")))
        .groupBy(*keys, "_band", "row", "col")
        .agg(F.sum("_v").alias("weighted"))
        .drop("_band")
    )


def kernel_weight(row: Column, col: Column, radius: int = K.HEAT_RADIUS) -> Column:
    """Sum of the stencil weights that fall inside the grid around a cell.

    Only the distance to each border matters, at most ``radius``: the centre,
    four arms and four quadrants, each looked up by its clipped reach.
    """
    reach = range(radius + 1)
    arm = F.array(*[F.lit(sum(1.0 / (1 + i * i) for i in range(1, n + 1))) for n in reach])
    quadrant = F.array(
        *[
            F.lit(float(sum(1.0 / (1 + i * i + j * j) for i in range(1, n + 1) for j in range(1, m + 1))))
            for n in reach
            for m in reach
        ]
    )

    def clip(v: Column) -> Column:
        return F.least(v, F.lit(radius))

    up, down = clip(row), clip(F.lit(K.HEAT_ROWS - 1) - row)
    left, right = clip(col), clip(F.lit(K.HEAT_COLS - 1) - col)
    total = F.lit(1.0)
    for side in (up, down, left, right):
        total = total + arm[side]
    for v in (up, down):
        for h in (left, right):
            total = total + quadrant[v * (radius + 1) + h]
    return total


def smooth_heat(
    grid: DataFrame, radius: int = K.HEAT_RADIUS, keys: Sequence[str] = align.KEYS, dense: bool = False
) -> DataFrame:
    """Smoothed occupancy.  ``dense`` adds the cells nothing reached, as 0."""
    reached = kernel_sums(grid, radius, keys)
    if dense:
        cells = F.explode(F.sequence(F.lit(0), F.lit(K.HEAT_ROWS * K.HEAT_COLS - 1)))
        full = (
            grid.select(*keys)
            .distinct()
            .select(*keys, cells.alias("_i"))
            .select(
                *keys,
                F.expr(f"cast(_i div {K.HEAT_COLS} as int)").alias("row"),
                (F.col("_i") % K.HEAT_COLS).alias("col"),
            )
        )
        reached = full.join(reached, [*keys, "row", "col"], "left").fillna(0.0, ["weighted"])
    value = F.col("weighted") / kernel_weight(F.col("row"), F.col("col"), radius)
    return reached.select(*keys, "row", "col", value.alias("value"))


def coloured(smoothed: DataFrame, keys: Sequence[str] = align.KEYS) -> DataFrame:
    """Cell colours relative to the peak of the same grid."""
    peak = F.max("value").over(Window.partitionBy(*keys))
    rgba = smoothed.withColumn("_peak", peak).select(
        *keys, "row", "col", "value", G.heat_rgba(F.col("value"), F.col("_peak")).alias("_c")
    )
    return rgba.select(*keys, "row", "col", "value", "_c.*")
