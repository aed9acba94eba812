"""Streaming forms of the message and range jobs.

Stateless jobs are the batch expressions on a streaming table.  Windowed ones
carry a watermark equal to the freshness limit, which bounds their state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagtrack import constants as K
from tagtrack.operators import heatmap, ingest

WATERMARK = f"{int(K.MAX_AGE_S)} seconds"


def write_log(messages: DataFrame, path: str, checkpoint: str, mode: str = "compat", trigger: dict | None = None) -> StreamingQuery:
    """Append calibration-log rows as partitioned files; exactly once by checkpoint.

    The default trigger drains what is there and stops; pass
    ``{"processingTime": "50 milliseconds"}`` to follow a live source.
    """
    rows = ingest.log_rows(messages, mode)
    dated = rows.withColumn("run_date", F.substring("timestamp_iso", 1, 10))
    return (
        dated.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("run_date")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _order(ranges: DataFrame, ts: str) -> Column:
    return F.struct(ts, *[c for c in ("arrival",) if c in ranges.columns])


def latest_ranges(ranges: DataFrame, ts: str = "ingest_ts") -> DataFrame:
    """Last value and stamp of each anchor of each tag (update or complete mode); the last arrival of equal stamps."""
    return ranges.groupBy("tag_id", "anchor_id").agg(
        F.max(ts).alias("last_ts"),
        F.max_by("distance_cm", _order(ranges, ts)).alias("distance_cm"),
        F.count(F.lit(1)).alias("n"),
    )


def fresh(latest: DataFrame, now: str, max_age_s: float = K.MAX_AGE_S) -> DataFrame:
    """Rows of the latest table that are not too old at ``now``; nothing is deleted."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("last_ts")) / F.lit(1e6)
    return latest.where(age <= max_age_s)


def tick_windows(ranges: DataFrame, ts: str = "ingest_ts", width: str = f"{K.SUPERFRAME_MS} milliseconds") -> DataFrame:
    """Last value of each anchor per superframe."""
    return (
        ranges.withWatermark(ts, WATERMARK)
        .groupBy("tag_id", "anchor_id", F.window(ts, width).alias("tick"))
        .agg(F.max_by("distance_cm", _order(ranges, ts)).alias("distance_cm"), F.count(F.lit(1)).alias("n"))
        .select("tag_id", "anchor_id", F.col("tick.start").alias("tick_start"), "distance_cm", "n")
    )


def session_gaps(messages: DataFrame, ts: str = "ingest_ts", gap: str = f"{K.STALE_MS} milliseconds") -> DataFrame:
    """Spans in which a tag kept talking without a stale gap."""
    return (
        messages.withWatermark(ts, WATERMARK)
        .groupBy("tag_id", F.session_window(ts, gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("tag_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
    )


def running_heat(positions: DataFrame) -> DataFrame:
    """Occupancy so far per tag and cell (update or complete mode)."""
    return heatmap.heat(positions)
