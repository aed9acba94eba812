"""The boards' own clocks on one time base.

A board stamps its lines with the milliseconds since it was switched on; the receiver adds its
own stamp when a line arrives, after a delay that is never negative.  So within one *boot* of a board
the points (ms, arrival - ms) lie above a line whose height is the offset of the board's clock
and whose slope is its drift, and touch it where a line came without delay: the
lower envelope.  A chunk of board time is reduced to its lowest point, a combinable
aggregate; the envelope line of a boot is the edge of the lower hull of those points
below their mean, which is the line with the least sum of distances under all of them.

A boot begins where the counter or the milliseconds fall and the arrival does not explain it
by a late line: the offset rises by more than ``LATE_MS``.  Device times rise with ``ms`` within a boot,
and a boot never begins before the one before it has ended.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtrack import constants as K
from tagtrack.operators import scan

KEYS = ("run_id", "tag_id", "session", "src")
#: a line may arrive this much later than its neighbours without being another boot's
LATE_MS = int(K.MAX_AGE_S * 1000)
#: a chunk of board time with one lowest point, and the drift that a board may have at most
POINT_MS, MAX_DRIFT = 60_000, 500e-6


def lower_hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the corners of the lower hull, from left to right."""
    hull: list[int] = []
    for i in np.lexsort((y, x)).tolist():
        if hull and x[hull[-1]] == x[i]:
            continue
        while len(hull) > 1:
            a, b = hull[-2:]
            if (y[b] - y[a]) * (x[i] - x[a]) < (y[i] - y[a]) * (x[b] - x[a]):
                break
            hull.pop()
        hull.append(i)
    return np.array(hull, int)


def supporting(x: np.ndarray, y: np.ndarray, middle: float, max_drift: float = MAX_DRIFT) -> tuple[float, float]:
    """(height at 0, slope) of the hull's edge at ``middle``; the slope is bounded."""
    slope = 0.0
    if len(x) > 1:
        right = min(max(int(np.searchsorted(x, middle)), 1), len(x) - 1)
        slope = float(np.clip((y[right] - y[right - 1]) / (x[right] - x[right - 1]), -max_drift, max_drift))
    return float((y - slope * x).min()), slope


def envelope(x: np.ndarray, y: np.ndarray, max_drift: float = MAX_DRIFT) -> tuple[float, float]:
    """(height at 0, slope) of the line under all points with the least sum of distances; the slope is bounded."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    at = lower_hull(x, y)
    return supporting(x[at], y[at], float(x.mean()), max_drift)


def boots(lines: DataFrame, keys: Sequence[str] = KEYS, chunk_s: float = 3600.0) -> DataFrame:
    """Add ``boot``, the number of restarts of the board before a line; lines have us (arrival), arrival, ms and cb."""
    rows = lines.withColumn("_o", F.struct("us", "arrival", "ms")).withColumn(scan.CHUNK, scan.chunk_of(F.col("us") / F.lit(1e6), chunk_s))
    prev = scan.with_previous(rows.withColumn("_y", F.col("us") / 1000 - F.col("ms")), keys, "_o", ["ms", "cb", "_y"], "_before_")
    fell = (F.col("ms") < F.col("_before_ms")) | (F.col("cb") < F.col("_before_cb"))
    opens = F.coalesce(fell & (F.col("_y") - F.col("_before__y") > LATE_MS), F.lit(False)).cast("int")
    numbered = scan.running(prev.select(*rows.columns, opens.alias("_opens")), keys, ["_o"], {"boot": ("sum", F.col("_opens"))})
    return numbered.select(*lines.columns, F.col("boot").cast("long").alias("boot"))


def boot_lines(numbered: DataFrame, keys: Sequence[str] = KEYS, point_ms: int = POINT_MS) -> DataFrame:
    """keys, boot, height, drift, floor_us: the envelope of every boot, and the end of the boots before it.

    One row per chunk of board time reaches the fit, however many lines there were.
    """
    keys = list(keys)
    y = F.col("us") / 1000 - F.col("ms")
    chunk = F.floor(F.col("ms") / point_ms).alias("_c")
    points = numbered.groupBy(*keys, "boot", chunk).agg(
        F.min(F.struct(y.alias("y"), F.col("ms").cast("double").alias("x"))).alias("p"), F.max("ms").alias("top")
    )
    kinds = {f.name: f.dataType.simpleString() for f in numbered.schema.fields}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["boot long, height double, drift double, top long"])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            lines = [envelope(x, y) for x, y in zip(part["x"], part["y"], strict=True)]
            out = part[[*keys, "boot"]].assign(height=[h for h, _ in lines], drift=[d for _, d in lines])
            yield out.assign(top=part["top"])

    # a row per boot with its points: a group of its own per boot would cost milliseconds a boot
    rows = points.groupBy(*keys, "boot").agg(F.array_sort(F.collect_list("p")).alias("p"), F.max("top").alias("top"))
    fitted = rows.select(*keys, "boot", "p.x", "p.y", "top").mapInPandas(fit, schema)
    before = Window.partitionBy(*keys).orderBy("boot").rowsBetween(Window.unboundedPreceding, -1)  # a row per boot
    end = on_base(F.col("top"), F.col("height"), F.col("drift"))
    return fitted.select(*keys, "boot", "height", "drift", F.max(end).over(before).alias("floor_us"))


def on_base(ms: Column, height: Column, drift: Column) -> Column:
    """Microseconds on the receiver's clock of a board's millisecond."""
    return F.round((ms * (1 + drift) + height) * 1000).cast("long")


def with_device_time(lines: DataFrame, keys: Sequence[str] = KEYS, barrier=None) -> DataFrame:
    """Add ``boot`` and ``device_us``: when a line was sent, in microseconds on the receiver's clock.

    ``lines`` have the key columns, us (arrival stamp in microseconds), arrival (order of
    equal stamps), ms and cb; keys, us and ms are not NULL.
    """
    numbered = boots(lines, keys)
    if barrier is not None:
        numbered = barrier(numbered)
    fitted = boot_lines(numbered, keys)
    sent = on_base(F.col("ms"), F.col("height"), F.col("drift"))
    out = numbered.join(fitted, [*keys, "boot"])
    return out.select(*lines.columns, "boot", F.greatest(sent, F.coalesce("floor_us", sent)).alias("device_us"))
