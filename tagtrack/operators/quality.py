"""Health of the ranging network, from device telemetry and the calibration log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtrack import constants as K
from tagtrack.operators import scan
from tagtrack.operators.ingest import measured


def failed_share(telemetry: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Share of lines whose last measurement failed."""
    failed = (~F.col("measured")).cast("double")
    return (
        measured(telemetry)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("lines"), F.avg(failed).alias("failed_share"))
    )


#: one board: sessions repeat on every court, and a court's boards share its sessions
BOARD = ("tag_id", "session", "src")


def _chunked(telemetry: DataFrame, ts: str, chunk_s: float = 3600.0) -> DataFrame:
    """Rows with ``_us``, the order within a board, and a chunk; a stamp may be a timestamp or milliseconds."""
    stamp = F.unix_micros(ts) if dict(telemetry.dtypes)[ts] == "timestamp" else F.col(ts).cast("long") * 1000
    timed = telemetry.withColumn("_us", stamp)
    return timed.withColumn(scan.CHUNK, scan.chunk_of(F.col("_us") / F.lit(1e6), chunk_s))


def response_rate(
    telemetry: DataFrame, ts: str = "ingest_ts", period: str = "1 second", seconds: float = 1.0,
    keys: Sequence[str] = BOARD,
) -> DataFrame:
    """New measurements of a board per window against the 10 Hz target, and its restarts.

    Lines repeat on a timer, so the device counter is what counts: the steps from
    the line before, also across the border of a window.  A counter below the one
    before means a restart, after which it counts from 0.  The first line of a
    board has no step.
    """
    prev = scan.with_previous(_chunked(telemetry, ts), keys, "_us", ["cb"], "_before_")
    step = F.col("cb") - F.col("_before_cb")
    gained = F.when(step < 0, F.col("cb")).otherwise(step)
    return (
        prev.groupBy(*keys, F.window(ts, period).alias("_w"))
        .agg(
            F.sum(gained).alias("_gained"),
            F.count_if(step < 0).alias("restarts"),
            F.count(F.lit(1)).alias("lines"),
        )
        .select(
            *keys,
            F.col("_w.start").alias("window_start"),
            "lines",
            "restarts",
            (F.col("_gained") / F.lit(seconds * K.TARGET_HZ)).alias("rate"),
        )
    )


def stale_anchors(
    telemetry: DataFrame, now: Column, ts: str = "ingest_ts", keys: Sequence[str] = ("session",),
    timeout_ms: int = K.STALE_MS,
) -> DataFrame:
    """Age of the last complete line of each board and whether it is too old."""
    age = (F.unix_micros(now) - F.unix_micros("last_ts")) / F.lit(1000.0)
    return (
        telemetry.groupBy(*keys)
        .agg(F.max(ts).alias("last_ts"))
        .withColumn("age_ms", age)
        .withColumn("stale", F.col("age_ms") > timeout_ms)
    )


def exact_median(rows: DataFrame, value: str, keys: Sequence[str], width: float = 1.0) -> DataFrame:
    """keys, median: the lower median of each group by two passes of counting.

    Values are counted per bucket; the bucket that holds the middle rank is found
    from the counts, then cut finer, and in the end the distinct values of one small
    bucket are counted.  No task ever holds the values of a group.
    """
    keys, x = list(keys), F.col(value)
    known = rows.where(x.isNotNull() & ~F.isnan(x))
    need = known.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / 2).alias("_rank"))
    for step in (width, width / 1024, None):
        bucket = x if step is None else F.floor(x / F.lit(step))
        counts = known.groupBy(*keys, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        # buckets of a group, never its rows
        upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = counts.withColumn("_upto", F.sum("_n").over(upto)).join(need, keys)
        found = ranked.where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
        if step is None:
            return found.select(*keys, F.col("_b").alias("median"))
        need = found.select(*keys, "_b", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"))
        known = known.withColumn("_b", bucket).join(need.select(*keys, "_b"), [*keys, "_b"]).drop("_b")
        need = need.drop("_b")
    raise AssertionError


def calibration_bias(ranges: DataFrame, known: str = "known_cm", keys: Sequence[str] = ("anchor_id",)) -> DataFrame:
    """Spread of each anchor's ranges and their offset from the known distance; the median is exact."""
    rows = ranges.withColumn("_r", F.col("distance_cm") - F.col(known))
    spread = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("distance_cm").alias("mean_cm"),
        F.stddev_samp("distance_cm").alias("stddev_cm"),
        F.avg("_r").alias("bias_cm"),
        F.stddev_samp("_r").alias("residual_stddev_cm"),
    )
    middle = exact_median(rows.select(*keys, "_r"), "_r", keys)
    return spread.join(middle.withColumnRenamed("median", "median_residual_cm"), list(keys), "left")


def first_of_repeats(telemetry: DataFrame, ts: str = "ingest_ts", keys: Sequence[str] = BOARD) -> DataFrame:
    """One row per device measurement: a board re-sends its last value on a timer.

    A measurement is a run of lines of a board with the same counter; the first line
    of each run stays, with the run's length as ``copies``.  The counter starts again
    after a restart, so a value that comes back later is a new measurement.
    """
    keys = list(keys)
    rest = [c for c in telemetry.columns if c not in (*keys, ts)]
    prev = scan.with_previous(_chunked(telemetry, ts), keys, "_us", ["cb"], "_before_")
    opens = F.when(F.col("cb").eqNullSafe(F.col("_before_cb")), F.lit(0)).otherwise(F.lit(1))
    runs = scan.running(prev, keys, ["_us"], {"_run": ("sum", opens)})
    return runs.groupBy(*keys, "_run").agg(
        F.min(ts).alias(ts), *[F.min_by(c, "_us").alias(c) for c in rest], F.count(F.lit(1)).alias("copies")
    ).drop("_run")


def session_spans(
    df: DataFrame, ts: str, gap_ms: int = K.STALE_MS, keys: Sequence[str] = ("tag_id",), chunk_s: float = 3600.0
) -> DataFrame:
    """Start, end and size of the spans without a gap longer than ``gap_ms``.

    The batch form of a session window.  It numbers the spans with the chunked
    ordered operators, so a tag with most of the rows is not one task; the end
    is the last row plus the gap.
    """
    keys = list(keys)
    timed = df.select(*keys, F.unix_micros(ts).alias("_us"))
    timed = timed.withColumn(scan.CHUNK, scan.chunk_of(F.col("_us") / F.lit(1e6), chunk_s))
    prev = scan.with_previous(timed, keys, "_us", ["_us"], "_before")
    opens = F.when(F.col("_us") - F.col("_before_us") <= gap_ms * 1000, F.lit(0)).otherwise(F.lit(1))
    numbered = scan.running(prev, keys, ["_us"], {"_span": ("sum", opens)})
    return (
        numbered.groupBy(*keys, "_span")
        .agg(F.min("_us").alias("_a"), F.max("_us").alias("_b"), F.count(F.lit(1)).alias("n"))
        .select(
            *keys,
            F.timestamp_micros("_a").alias("start"),
            F.timestamp_micros(F.col("_b") + F.lit(gap_ms * 1000)).alias("end"),
            "n",
        )
    )
