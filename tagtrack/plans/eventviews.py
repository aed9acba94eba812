"""Positioning inputs derived from the generic ``events`` table.

Deterministic stand-ins (messages, ranges, truth) whose size follows the table:
a tag per user, a tick per event, four anchors per tick.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtrack import constants as K
from tagtrack.operators import scan

LAYOUT = {a: (x, y) for a, (x, y, _) in K.LAYOUTS_3D[4][1].items()}
LAYOUT_Z = K.LAYOUTS_3D[4][1]
TICK_S = 0.05


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def sequenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events numbered per tag in time order; days bound what one task must sort."""
    ev = events(spark, sf_dir).select(
        "event_id",
        F.col("user_id").alias("tag_id"),
        "ts",
        "value",
        scan.never_null(F.datediff("ts", F.lit("1970-01-01"))).alias("day"),
    )
    out = scan.with_index(ev, ["tag_id"], ["ts", "event_id"], "seq", chunk="day")
    return out.select(
        F.lit(0).cast("long").alias("run_id"),
        "tag_id",
        F.col("seq").cast("int").alias("seq"),
        (F.col("seq") * F.lit(TICK_S)).alias("t"),
        "event_id",
        "value",
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq, tag = F.col("seq"), F.col("tag_id")
    hop = F.when((seq % 20).isin(10, 11, 12), F.lit(60.0)).otherwise(F.lit(0.0))
    return sequenced(spark, sf_dir).select(
        "run_id",
        "tag_id",
        "seq",
        "t",
        "event_id",
        (F.lit(1250.0) + F.lit(1300.0) * F.sin(F.lit(0.05) * seq + tag)).alias("x"),
        (F.lit(900.0) + F.lit(650.0) * F.cos(F.lit(0.031) * seq + tag)).alias("y"),
        (F.lit(95.0) + hop).alias("z"),
    )


def ranges(spark: SparkSession, sf_dir: str, slant: bool = False) -> DataFrame:
    """Ranges to four corner anchors with deterministic noise and gaps.

    ``slant`` gives three-dimensional ranges, otherwise ranges on the floor.
    """
    spots = F.array(
        *[
            F.struct(F.lit(a).alias("anchor_id"), *[F.lit(v).alias(n) for n, v in zip(("ax", "ay", "az"), xyz)])
            for a, xyz in LAYOUT_Z.items()
        ]
    )
    rows = truth(spark, sf_dir).select("*", F.explode(spots).alias("_a"))
    dx, dy, dz = F.col("x") - F.col("_a.ax"), F.col("y") - F.col("_a.ay"), F.col("z") - F.col("_a.az")
    sq = dx * dx + dy * dy + dz * dz if slant else dx * dx + dy * dy
    anchor, ev = F.col("_a.anchor_id"), F.col("event_id")
    noise = (ev * 7 + anchor * 13) % 37 - 18
    return rows.where((ev + anchor) % 29 != 0).select(
        "run_id",
        "tag_id",
        "t",
        "seq",
        ev.alias("arrival"),
        anchor.alias("anchor_id"),
        (F.sqrt(sq) + noise).alias("distance_cm"),
    )


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = events(spark, sf_dir).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_of(events(spark, sf_dir))


def messages_of(source: DataFrame) -> DataFrame:
    """Ten message shapes over the events, from clean lists to device lines and noise."""
    ev = F.col("event_id")
    k = (ev % 4 + 1).cast("string")
    k2 = ((ev + 1) % 4 + 1).cast("string")
    v = F.floor(F.col("value") * 10).cast("int").cast("string")
    cb, ms = F.floor(ev / 3).cast("long").cast("string"), (ev * 100).cast("string")

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    uwb = ("UWB,session=0x100", k, ",src=0x1111")
    shapes = [
        text("A", k, "=", v, ";A", k2, "=", v),
        text("A", k, " D1=", v),
        text("anchor=", k, ",d1=", v),
        text("anchor=", k, ",valid=0,dist=", v),
        text(*uwb, ",dst=0x2222,cb=", cb, ",status=0,lastDist=", v, ",d1=", v, ",ms=", ms),
        text(*uwb, ",dst=0x2222,cb=", cb, ",status=4,lastDist=65535,d1=-1,ms=", ms),
        text("id=", k, " range=", v, ",5 event=calib"),
        text("dist", k, ": ", v, ",5 type=probe"),
        F.lit("heartbeat"),
        text(*uwb, ",cb=", cb),
    ]
    message = F.lit(None).cast("string")
    for i, shape in reversed(list(enumerate(shapes))):
        message = F.when(ev % 10 == i, shape).otherwise(message)
    return source.select(
        "event_id",
        F.col("user_id").alias("tag_id"),
        F.col("ts").cast("timestamp").alias("ingest_ts"),
        F.concat(F.lit("10.0.0."), k).alias("source_ip"),
        F.lit(K.UDP_PORT).alias("source_port"),
        message.alias("message"),
    )


def range_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges as a tag would send them: a message per anchor, stamped, in order of arrival."""
    r = ranges(spark, sf_dir)
    number = F.round("distance_cm", 2).cast("string")
    return r.select(
        "run_id", "tag_id", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")).alias("ingest_ts"),
        "arrival", F.concat(F.lit("A"), F.col("anchor_id").cast("string"), F.lit("="), number).alias("message"),
    )


def board_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a board per tag, one every ten seconds: it restarts at every thirtieth, its clock drifts, its lines are delayed.

    ``sent_us`` is when a line was sent, which a job does not know.
    """
    seq, ev = F.col("seq").cast("long"), F.col("event_id")
    boot, sent = F.floor(seq / 30).cast("long"), seq * 10_000_000 + 1_000_000_000_000
    up_ms = (seq - boot * 30) * 10_000 + 3000
    drift = (F.col("tag_id") % 5 - 2) * F.lit(40e-6)
    return sequenced(spark, sf_dir).select(
        "run_id", "tag_id", F.lit("0x1001").alias("session"), F.lit("0x1111").alias("src"),
        (sent + ev * 7919 % 1800 * 1000).alias("us"), ev.alias("arrival"),
        F.floor(up_ms * (1 + drift)).cast("long").alias("ms"), (seq % 30).alias("cb"), sent.alias("sent_us"),
    )
