"""Table schemas shared by sources, operators and streams."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGES = T.StructType(
    [
        T.StructField("ingest_ts", T.TimestampType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("source_port", T.IntegerType()),
        T.StructField("message", T.StringType()),
    ]
)
RANGES_LOG = T.StructType(
    [
        T.StructField("timestamp_iso", T.StringType()),
        T.StructField("timestamp_s", T.DoubleType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("source_port", T.IntegerType()),
        T.StructField("event", T.StringType()),
        T.StructField("anchor_id", T.LongType()),
        T.StructField("distance_cm", T.DoubleType()),
        T.StructField("raw_message", T.StringType()),
        T.StructField("fields_json", T.StringType()),
    ]
)
TELEMETRY = T.StructType(
    [
        T.StructField("session", T.StringType()),
        T.StructField("src", T.StringType()),
        T.StructField("dst", T.StringType()),
        T.StructField("cb", T.LongType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("lastDist", T.IntegerType()),
        T.StructField("d1", T.IntegerType()),
        T.StructField("ms", T.LongType()),
    ]
)
RANGES = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("tag_id", T.LongType()),
        T.StructField("t", T.DoubleType()),
        T.StructField("arrival", T.LongType()),
        T.StructField("anchor_id", T.LongType()),
        T.StructField("distance_cm", T.DoubleType()),
    ]
)
ANCHORS = T.StructType(
    [
        T.StructField("layout_id", T.IntegerType()),
        T.StructField("layout_name", T.StringType()),
        T.StructField("anchor_id", T.IntegerType()),
        T.StructField("ax", T.DoubleType()),
        T.StructField("ay", T.DoubleType()),
        T.StructField("az", T.DoubleType()),
    ]
)
TRUTH = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("tag_id", T.LongType()),
        T.StructField("t", T.DoubleType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("z", T.DoubleType()),
    ]
)
