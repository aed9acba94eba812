"""Player motion from positions: segments, speed, jumps, trails and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtrack import constants as K
from tagtrack.functions.geometry import metres, speed_kmh
from tagtrack.operators import align, scan


def _airborne(jump: Column) -> Column:
    # a missing height means "not airborne"
    return F.coalesce(jump >= K.JUMP_CM, F.lit(False))


def segments(positions: DataFrame, keys: Sequence[str] = align.KEYS, jump: str | None = None) -> DataFrame:
    """Distance and speed of each step and, with ``jump``, take-offs.

    Rows need t, dt, x, y and the chunk column; only rows with a position take
    part.  Speed uses the tick's own duration, not the gap between fixes.
    """
    placed = positions.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    fields = ["x", "y"]
    if jump:
        placed = placed.withColumn("airborne", _airborne(F.col(jump)))
        fields.append("airborne")
    prev = scan.with_previous(placed, keys, "t", fields)
    dx, dy = F.col("x") - F.col("prev_x"), F.col("y") - F.col("prev_y")
    moving = F.col("prev_x").isNotNull() & (F.col("dt") > 0)
    out = prev.withColumn("step_cm", F.when(moving, F.sqrt(dx * dx + dy * dy)))
    out = out.withColumn("speed_cm_s", F.col("step_cm") / F.when(F.col("dt") > 0, F.col("dt")))
    if jump:
        rising = F.col("airborne") & ~F.coalesce(F.col("prev_airborne"), F.lit(False))
        out = out.withColumn("takeoff", rising)
    return out.drop(*[f"prev_{c}" for c in fields])


def totals(positions: DataFrame, keys: Sequence[str] = align.KEYS, jump: str | None = None) -> DataFrame:
    """Per-player totals; one combinable aggregate over the segments.

    Without ``jump`` the jump columns are NULL: they cannot be observed in 2D.
    """
    return summed(segments(positions, keys, jump), keys, jump)


def summed(seg: DataFrame, keys: Sequence[str] = align.KEYS, jump: str | None = None) -> DataFrame:
    """The totals of segments that are there already."""
    zero = F.lit(0.0)
    if jump:
        jumps = [
            F.sum(F.col("takeoff").cast("long")).alias("jump_count"),
            F.greatest(F.coalesce(F.max(jump), zero), zero).alias("max_jump_cm"),
        ]
    else:
        jumps = [F.lit(None).cast("long").alias("jump_count"), F.lit(None).cast("double").alias("max_jump_cm")]
    return seg.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        F.greatest(F.max("t"), zero).alias("time_s"),
        F.coalesce(F.sum("step_cm"), zero).alias("distance_cm"),
        F.coalesce(F.sum("speed_cm_s"), zero).alias("speed_sum_cm_s"),
        F.coalesce(F.max("speed_cm_s"), zero).alias("max_speed_cm_s"),
        *jumps,
    )


def average_speed(total: DataFrame) -> Column:
    """Distance over elapsed time; 0 before any time has passed."""
    elapsed = F.col("time_s")
    return F.when(elapsed > 0, F.col("distance_cm") / F.when(elapsed > 0, elapsed)).otherwise(F.lit(0.0))


def player_card(positions: DataFrame, keys: Sequence[str] = align.KEYS, jump: str | None = None) -> DataFrame:
    """The card figures: km/h, metres, jumps and samples per player."""
    return card(totals(positions, keys, jump), keys)


def card(total: DataFrame, keys: Sequence[str] = align.KEYS) -> DataFrame:
    """Totals in the units of the card."""
    return total.select(
        *keys,
        "samples",
        "time_s",
        metres(F.col("distance_cm")).alias("distance_m"),
        speed_kmh(average_speed(total)).alias("avg_speed_kmh"),
        speed_kmh(F.col("max_speed_cm_s")).alias("max_speed_kmh"),
        "speed_sum_cm_s",
        "jump_count",
        "max_jump_cm",
    )


def running_peaks(positions: DataFrame, keys: Sequence[str] = align.KEYS, jump: str | None = None) -> DataFrame:
    """Time, speed and jump maxima so far, per tick."""
    seg = segments(positions, keys, jump)
    measures = {
        "max_time_s": ("max", F.col("t")),
        "max_speed_so_far": ("max", F.coalesce(F.col("speed_cm_s"), F.lit(0.0))),
    }
    if jump:
        measures["max_jump_so_far"] = ("max", F.coalesce(F.col(jump), F.lit(0.0)))
    return scan.running(seg, keys, ["t"], measures)


def trail(
    positions: DataFrame, n: int = K.TRAIL_POINTS, keys: Sequence[str] = align.KEYS, order: str = "t"
) -> DataFrame:
    """Last ``n`` rows of each key, ranked from the newest.

    Chunk counts say which chunks can still hold one of the last ``n`` rows, so
    the ranking sees at most ``n`` rows plus one chunk of a key.
    """
    keys = list(keys)
    later = Window.partitionBy(*keys).orderBy(F.col(scan.CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = positions.groupBy(*keys, scan.CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    needed = counts.withColumn("_after", F.coalesce(F.sum("_n").over(later), F.lit(0))).where(F.col("_after") < n)
    few = positions.join(needed.select(*keys, scan.CHUNK), [*keys, scan.CHUNK], "left_semi")
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return few.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n)
