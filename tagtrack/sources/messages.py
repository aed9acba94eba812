"""Where messages, truth and anchor tables come from; batch and stream alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagtrack import schemas
from tagtrack.functions import text as X

FORMATS = ("parquet", "orc", "json", "csv")


def _shape(df: DataFrame, message: Column) -> DataFrame:
    """The message columns in order, then whatever else the caller's table has."""
    cols = set(df.columns)
    optional = {"source_ip": "string", "source_port": "int"}
    extra = [F.col(c) if c in cols else F.lit(None).cast(t).alias(c) for c, t in optional.items()]
    rest = [c for c in df.columns if c not in ("ingest_ts", "message", "value", *optional)]
    return df.select("ingest_ts", *extra, message.alias("message"), *rest)


def _schema(extra: str | None) -> T.StructType:
    more = T._parse_datatype_string(extra).fields if extra else []
    return T.StructType([*schemas.MESSAGES.fields, *more])


def with_arrival(rows: DataFrame, name: str = "arrival") -> DataFrame:
    """Number the rows of a table just read from files: by path, then by place in the file, without gaps.

    Spark packs the pieces of files into tasks by size, so a task's number says nothing about
    paths.  Rows of one piece are together, though: a first pass counts the rows of every
    (path, start of the piece), their running sum is where a piece begins, and
    a row's number is that plus its place in the piece.  No row moves; the joined table has a row
    per piece.  The number depends on the files alone, so a second read gives the same.
    """
    inside = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    # the place is taken before anything could reorder or drop rows
    placed = rows.select("*", inside.alias("_piece"), F.monotonically_increasing_id().alias("_id"))
    pieces = placed.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("_path").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_path", F.col("_piece.path"))
    files = pieces.groupBy("_path").agg(F.sum("_n").alias("_rows"))
    start = F.coalesce(F.sum("_rows").over(Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("_path", start.alias("_start"))  # a row per file
    pieces = pieces.select("_piece", "_path", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_done"))
    pieces = pieces.join(files, "_path").select("_piece", (F.col("_start") + F.col("_done") - F.col("_first")).alias("_shift"))
    return placed.join(pieces, "_piece").select(*rows.columns, (F.col("_id") + F.col("_shift")).alias(name))


def _numbered(rows: DataFrame, wanted: bool) -> DataFrame:
    return with_arrival(rows) if wanted and "arrival" not in rows.columns else rows


def _csv(reader):
    # quotes inside a quoted field are doubled, as the log writes them; columns go by place, so the header must agree;
    # a quoted text may hold line feeds, so a file is read by one task
    return reader.option("header", True).option("escape", '"').option("enforceSchema", False).option("multiLine", True)


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet", extra: str | None = None, numbered: bool = False) -> DataFrame:
    """Message table from files.  ``text`` has one message per line, stamped with the file time.

    ``extra`` names further columns of the files that are kept, such as
    ``run_id long, tag_id long``.  ``numbered`` adds ``arrival``, the rows in order of path and place in
    the file, where the files bring none; a filter on the stamps then comes after the read.
    """
    if fmt == "text":
        lines = spark.read.text(path).select("value", F.col("_metadata.file_modification_time").alias("ingest_ts"))
        return _shape(_numbered(lines, numbered), X.clean_message(F.col("value")))
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    reader = spark.read.schema(_schema(extra))
    if fmt == "csv":
        reader = _csv(reader)
    return _shape(_numbered(reader.format(fmt).load(path), numbered), X.clean_message(F.col("message")))


def stream_messages(
    spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None, extra: str | None = None
) -> DataFrame:
    """The same table as a stream of arriving files; an order of arrival is one of the ``extra`` columns."""
    reader = spark.readStream.schema(_schema(extra)).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        reader = _csv(reader)
    return _shape(reader.load(path), X.clean_message(F.col("message")))


def from_kafka(records: DataFrame) -> DataFrame:
    """Kafka records (batch or stream) to messages: value is the text, key the sender address.

    A sender's records share a partition, so ``arrival``, the offset, orders equal stamps.
    """
    return records.select(
        F.col("timestamp").alias("ingest_ts"),
        F.col("key").cast("string").alias("source_ip"),
        F.lit(None).cast("int").alias("source_port"),
        X.clean_message(F.col("value")).alias("message"),
        *[F.col(c) for c in ("partition",) if c in records.columns],
        *[F.col("offset").alias("arrival") for c in ("offset",) if c in records.columns],
    )


def captured(messages: DataFrame, start: str, duration_s: float | None) -> DataFrame:
    """Messages of a capture that begins at ``start``; None runs without end.

    Both bounds are plain comparisons on the stamp, so they reach the scan.
    """
    begin = F.lit(start).cast("timestamp")
    out = messages.where(F.col("ingest_ts") >= begin)
    if duration_s is None:
        return out
    return out.where(F.col("ingest_ts") < begin + F.make_dt_interval(secs=F.lit(float(duration_s))))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Known trajectory samples, one row per (run, tag, t)."""
    return spark.read.schema(schemas.TRUTH).parquet(path)
