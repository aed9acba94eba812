"""Column expressions for distances, circles, filters, units and the court grid."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagtrack import constants as K


def clamp(v: Column, lo: float, hi: float) -> Column:
    # greatest and least skip NULL, so a missing value is kept missing by hand
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(lo)), F.lit(hi)))


def floor_at(v: Column, lo: float) -> Column:
    return F.when(v.isNotNull(), F.greatest(v, F.lit(lo)))


def distance_2d(ax, ay, bx, by) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def distance_3d(ax, ay, az, bx, by, bz) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay) + (bz - az) * (bz - az))


def lerp(a, b, u) -> Column:
    return a + (b - a) * u


def ground_distance(slant: Column, anchor_height: float = K.ANCHOR_Z, tag_height: float = K.TAG_BASE_Z) -> Column:
    """Slant range to the range on the floor for an assumed tag height."""
    dz = anchor_height - tag_height
    return F.sqrt(floor_at(slant * slant - F.lit(dz * dz), 0.0))


def ground_ranges(raw_3d: Column, anchor_height: float = K.ANCHOR_Z, tag_height: float = K.TAG_BASE_Z) -> Column:
    """The same projection over a map anchor -> slant range."""
    return F.transform_values(raw_3d, lambda _, d: ground_distance(d, anchor_height, tag_height))


def precision_percent(err: Column, tolerance: float | Column) -> Column:
    """100 at no error, 0 at the tolerance; NULL error stays NULL."""
    return clamp(F.lit(100.0) * (F.lit(1.0) - err / tolerance), 0.0, 100.0)


def alpha_for_dt(alpha: float | Column, dt: Column) -> Column:
    """Per-tick smoothing factor re-timed from the 60 Hz reference tick to ``dt``."""
    a = clamp(F.lit(alpha) if not isinstance(alpha, Column) else alpha, 0.0, K.MAX_ALPHA)
    return F.when(dt <= 0, a).otherwise(F.lit(1.0) - F.pow(F.lit(1.0) - a, dt * F.lit(float(K.TICK_HZ))))


def decay_rate(alpha: float) -> float:
    """Continuous decay (1/s) equal to smoothing factor ``alpha`` at the reference tick."""
    a = min(max(alpha, 0.0), K.MAX_ALPHA)
    return -math.log1p(-a) * K.TICK_HZ


def filter_delay(alpha: float | Column, dt: Column) -> Column:
    """Time constant (s) of a smoothing filter updated every ``dt``."""
    a = F.lit(alpha) if not isinstance(alpha, Column) else alpha
    keep = F.greatest(F.lit(1e-6), F.lit(1.0) - a)
    # keep = 1 has log 0; that case is the a <= 0 branch
    delay = floor_at(-dt / F.log(F.when(keep < 1, keep)), 0.0)
    return F.when((a <= 0) | (dt <= 0), F.lit(0.0)).otherwise(delay)


def circle_pair(x0, y0, r0, x1, y1, r1) -> Column:
    """Intersections of two circles: empty, or two points (equal when tangent)."""
    dx, dy = x1 - x0, y1 - y0
    d2 = dx * dx + dy * dy
    d = F.sqrt(d2)
    apart = (d > r0 + r1) | (d < F.abs(r0 - r1)) | (d == 0)
    # foot of the chord and half chord, as fractions of the centre distance
    along = F.when(d > 0, (r0 * r0 - r1 * r1 + d2) / (F.lit(2.0) * d2))
    half = F.sqrt(F.greatest(F.lit(0.0), r0 * r0 - along * along * d2)) / F.when(d > 0, d)
    point = lambda s: F.struct(
        (x0 + along * dx - F.lit(s) * half * dy).alias("x"), (y0 + along * dy + F.lit(s) * half * dx).alias("y")
    )
    none = F.array().cast("array<struct<x:double,y:double>>")
    return F.when(apart, none).otherwise(F.array(point(1.0), point(-1.0)))


def speed_kmh(cm_s: Column) -> Column:
    return cm_s * F.lit(K.CMS_TO_KMH)


def metres(cm: Column) -> Column:
    return cm / F.lit(100.0)


def millis(s: Column) -> Column:
    return s * F.lit(1000.0)


def jump_height(z: Column) -> Column:
    return floor_at(z - F.lit(K.TAG_BASE_Z), 0.0)


def on_court(x: Column, y: Column) -> Column:
    return x.between(K.COURT_LEFT, K.COURT_RIGHT) & y.between(K.COURT_TOP, K.COURT_BOTTOM)


def _cell(v: Column, low: float, extent: float, n: int) -> Column:
    # the far edge belongs to the last cell
    return clamp(F.floor((v - F.lit(low)) / F.lit(extent) * F.lit(n)), 0, n - 1).cast("int")


def heat_col(x: Column) -> Column:
    return _cell(x, K.COURT_LEFT, K.COURT_LENGTH, K.HEAT_COLS)


def heat_row(y: Column) -> Column:
    return _cell(y, K.COURT_TOP, K.COURT_WIDTH, K.HEAT_ROWS)


def heat_rgba(value: Column, peak: Column) -> Column:
    """Two-segment ramp (green to yellow to red) as ``struct<r,g,b,a>``."""
    ratio = F.when(peak <= 0, F.lit(0.0)).otherwise(clamp(value / F.when(peak > 0, peak), 0.0, 1.0))
    cool, warm = ratio * 2.0, (ratio - 0.5) * 2.0
    is_cool = ratio <= 0.5
    # fixed values: ramp end points
    r = F.when(is_cool, (40 + 215 * cool).cast("int")).otherwise(F.lit(255))
    g = F.when(is_cool, (170 + 55 * (1 - cool)).cast("int")).otherwise((170 * (1 - warm)).cast("int"))
    b = F.when(is_cool, F.lit(30.0)).otherwise(30 * (1 - warm))
    a = F.lit(56) + (110 * ratio).cast("int")
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a"))


def hoops() -> tuple[tuple[float, float], tuple[float, float]]:
    return (K.COURT_LEFT + K.HOOP_OFFSET, K.CENTER_Y), (K.COURT_RIGHT - K.HOOP_OFFSET, K.CENTER_Y)


def hoop_distance(x: Column, y: Column) -> Column:
    """Distance to the nearer hoop."""
    (lx, ly), (rx, ry) = hoops()
    return F.least(
        distance_2d(x, y, F.lit(lx), F.lit(ly)),
        distance_2d(x, y, F.lit(rx), F.lit(ry)),
    )


def court_zone(x: Column, y: Column) -> Column:
    """First matching court area, from the most specific to the least."""
    hoop = hoop_distance(x, y)
    from_end = F.least(x - F.lit(K.COURT_LEFT), F.lit(K.COURT_RIGHT) - x)
    side = F.abs(y - F.lit(K.CENTER_Y))
    to_ft = F.sqrt((from_end - K.KEY_LENGTH) * (from_end - K.KEY_LENGTH) + side * side)
    centre = distance_2d(x, y, F.lit(K.CENTER_X), F.lit(K.CENTER_Y))
    arc_reach = F.lit(K.HOOP_OFFSET)
    inside_corner = (from_end <= arc_reach) & (side <= K.COURT_WIDTH / 2 - K.CORNER_THREE)
    inside_arc = (from_end > arc_reach) & (hoop <= K.THREE_POINT_R)
    return (
        F.when(x.isNull() | y.isNull(), F.lit(None).cast("string"))
        .when(~on_court(x, y), F.lit("out"))
        .when(hoop <= K.RESTRICTED_R, F.lit("restricted"))
        .when((from_end <= K.KEY_LENGTH) & (side <= K.KEY_WIDTH / 2), F.lit("paint"))
        .when((to_ft <= K.FREE_THROW_R) & (from_end > K.KEY_LENGTH), F.lit("free_throw"))
        .when(centre <= K.CENTER_CIRCLE_R, F.lit("centre_circle"))
        .when(inside_corner | inside_arc, F.lit("two_point"))
        .otherwise(F.lit("three_point"))
    )
