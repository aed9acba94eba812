"""Calibration log: append-only CSV with nine columns, one row per (message, anchor)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtrack import schemas
from tagtrack.operators import ingest


def log_name(started: datetime) -> str:
    """Name of a capture started at the given time."""
    return started.strftime("uwb_calibration_%Y%m%d_%H%M%S.csv")


def write_log(messages: DataFrame, path: str, mode: str = "compat") -> None:
    """Append the log rows; every part file carries the header.

    Rows are sorted by stamp and anchor within a part, without a global sort.
    """
    rows = ingest.log_rows(messages, mode).sortWithinPartitions("timestamp_s", "raw_message", "anchor_id")
    rows.write.mode("append").option("header", True).option("escape", '"').csv(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Scan one or many logs (globs allowed), with the file each row came from."""
    return (
        spark.read.schema(schemas.RANGES_LOG)
        .option("header", True)
        .option("escape", '"')
        .csv(path)
        .withColumn("log_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    )
