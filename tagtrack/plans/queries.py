"""Registered queries: each operator applied to the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tagtrack import constants as K
from tagtrack.functions import geometry as G
from tagtrack.functions import text as X
from tagtrack.operators import accuracy, align, clock, heatmap, ingest, motion, quality, scan, smooth, solve2d, solve3d, zones
from tagtrack.plans import eventviews as V
from tagtrack.plans import locate
from tagtrack.plans.barrier import fresh_path, shared_checkpoint
from tagtrack.sources import log
from tagtrack.sources import messages as M
from tagtrack.sources import settings as S
from tagtrack.streaming import boardclock, jobs, repeats, track3d, tracker

Query = Callable[[SparkSession, str], DataFrame]
IDS = (1, 2, 3, 4)
PAIR = {a: V.LAYOUT[a] for a in (1, 3)}
TAG = ["tag_id"]
KEYS = list(align.KEYS)
DIST = {align.dist_col(a): align.smooth_col(a) for a in IDS}


def _r(c: str | Column, n: int = 4, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    # adding 0 turns -0.0 into 0.0
    return (F.round(col, n) + F.lit(0.0)).alias(name or c)


def _rs(names: list[str], n: int = 4) -> list[Column]:
    return [_r(c, n) for c in names]


# --- messages -----------------------------------------------------------------


def parse_fields(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.with_fields(V.messages(spark, sf)).select("event_id", F.explode("fields").alias("k", "v"))


def parse_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.parse_ranges(V.messages(spark, sf)).select("event_id", "anchor_id", "distance_cm")


def parse_ranges_session(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.parse_ranges(V.messages(spark, sf), "session").select("event_id", "anchor_id", "distance_cm")


def event_label(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.with_event(V.messages(spark, sf)).select("event_id", "event")


def fields_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.with_fields(V.messages(spark, sf))
    return rows.select("event_id", X.fields_json(F.col("fields")).alias("fields_json"))


def ranges_log(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.log_rows(V.messages(spark, sf))


def log_files(spark: SparkSession, sf: str) -> DataFrame:
    """Calibration log written as CSV files and scanned again."""
    path = fresh_path(spark, "uwb_calibration_*").replace("*", "20260513_141522")
    log.write_log(V.messages(spark, sf), path)
    return log.read_log(spark, path).drop("log_file")


def message_files(spark: SparkSession, sf: str) -> DataFrame:
    """Messages written as CSV, with a quote in every text, and read with their own columns."""
    path = fresh_path(spark, "messages")
    quoted = F.concat("message", F.lit(' note="a,b"'))
    columns = ["ingest_ts", "source_ip", "source_port", "message", "event_id", "tag_id"]
    V.messages(spark, sf).withColumn("message", quoted).select(columns).write.option("header", True).option("escape", '"').csv(path)
    rows = M.read_messages(spark, path, "csv", extra="event_id long, tag_id long")
    return rows.select("event_id", "tag_id", "message")


def ranges_device_time(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges on the boards' own clock, which only device lines have."""
    kept, _ = ingest.ranges_of(V.messages(spark, sf), "session", time="device")
    return kept.select("tag_id", _r("t"), "anchor_id", "distance_cm")


def device_clock(spark: SparkSession, sf: str) -> DataFrame:
    """Board lines on one time base: restarts, drift and delays taken out."""
    out = clock.with_device_time(V.board_lines(spark, sf), barrier=shared_checkpoint)
    return out.select("tag_id", "arrival", "boot", _r(F.col("device_us") / 1e6, 3, "t"))


def ranges_device_clock(spark: SparkSession, sf: str) -> DataFrame:
    """The same road from texts: ranges of device lines by the time they were sent."""
    line = F.concat(
        F.lit("UWB,session="), "session", F.lit(",src="), "src", F.lit(",dst=0x2222,cb="), F.col("cb").cast("string"), F.lit(",status=0,lastDist="),
        F.col("cb").cast("string"), F.lit(",d1="), F.col("cb").cast("string"), F.lit(",ms="), F.col("ms").cast("string"),
    )
    sent = V.board_lines(spark, sf).select("run_id", "tag_id", "arrival", F.timestamp_micros("us").alias("ingest_ts"), line.alias("message"))
    kept, _ = ingest.ranges_of(sent, "session", time="clock")
    return kept.select("tag_id", "arrival", _r("t", 3), "anchor_id", "distance_cm")


def truth_file(spark: SparkSession, sf: str) -> DataFrame:
    """The known trajectory from its table."""
    path = fresh_path(spark, "truth")
    V.truth(spark, sf).select("run_id", "tag_id", "t", "x", "y", "z").write.parquet(path)
    return M.read_truth(spark, path).select("tag_id", _r("t"), *_rs(["x", "y", "z"], 4))


def rows_written(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.log_rows(V.messages(spark, sf)).groupBy("source_ip").agg(F.count(F.lit(1)).alias("rows"))


def bounded_capture(spark: SparkSession, sf: str) -> DataFrame:
    part = M.captured(V.messages(spark, sf), "2024-01-03 00:00:00", 5 * 86400.0)
    return ingest.parse_ranges(part).groupBy("anchor_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event")
    )


def message_counts(spark: SparkSession, sf: str) -> DataFrame:
    return V.messages(spark, sf).groupBy("tag_id").agg(
        F.count(F.lit(1)).alias("packet_count"), F.max_by("message", "event_id").alias("last_message")
    )


def telemetry_valid(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.telemetry(V.messages(spark, sf)).select(
        "event_id", "session", "src", "dst", "cb", "status", F.col("lastDist").alias("last_dist"), "d1", "ms"
    )


def telemetry_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.telemetry_rejects(V.messages(spark, sf)).select("event_id", "message")


def sentinel_clean(spark: SparkSession, sf: str) -> DataFrame:
    rows = quality.measured(ingest.telemetry(V.messages(spark, sf)))
    return rows.groupBy("measured").agg(
        F.count(F.lit(1)).alias("n"), F.count("d1").alias("n_d1"), F.sum("lastDist").alias("sum_last_dist")
    )


def failed_share(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.failed_share(ingest.telemetry(V.messages(spark, sf)))
    return out.select("session", "lines", _r("failed_share", 6))


def session_anchor_map(spark: SparkSession, sf: str) -> DataFrame:
    tel = ingest.telemetry(V.messages(spark, sf))
    session = F.col("session")
    return tel.select(
        "event_id",
        "session",
        ingest.session_anchor(session).alias("anchor_id"),
        ingest.session_address(session).alias("address"),
    )


def response_rate(spark: SparkSession, sf: str) -> DataFrame:
    tel = ingest.telemetry(V.messages(spark, sf)).withColumn("device_ts", F.timestamp_millis("ms"))
    out = quality.response_rate(tel, "device_ts", "60 seconds", 60.0)
    return out.select("tag_id", "session", "src", F.unix_millis("window_start").alias("window_ms"), "lines", "restarts", _r("rate", 6))


def stale_anchors(spark: SparkSession, sf: str) -> DataFrame:
    tel = ingest.telemetry(V.messages(spark, sf))
    out = quality.stale_anchors(tel, F.lit("2024-01-30 23:00:00").cast("timestamp"), keys=["tag_id"])
    return out.select("tag_id", _r("age_ms", 3), "stale")


def repeat_suppress(spark: SparkSession, sf: str) -> DataFrame:
    """Device measurements by board, with a counter that restarts every twentieth measurement."""
    tel = ingest.telemetry(V.messages(spark, sf)).select("src", F.pmod("cb", F.lit(20)).alias("cb"), "ms", "status", "d1")
    return quality.first_of_repeats(tel, "ms", ["src"])


def session_gaps(spark: SparkSession, sf: str) -> DataFrame:
    device = V.messages(spark, sf).select("tag_id", F.timestamp_millis(F.col("event_id") * 100).alias("device_ts"))
    out = quality.session_spans(device, "device_ts")
    return out.select("tag_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n")


def calibration_bias(spark: SparkSession, sf: str) -> DataFrame:
    true = V.truth(spark, sf)
    spots = F.array(
        *[F.struct(F.lit(a).alias("anchor_id"), F.lit(x).alias("ax"), F.lit(y).alias("ay")) for a, (x, y) in V.LAYOUT.items()]
    )
    known = true.select("run_id", "tag_id", "t", F.explode(spots).alias("_a"), "x", "y").select(
        "run_id", "tag_id", "t", "_a.anchor_id",
        G.distance_2d(F.col("_a.ax"), F.col("_a.ay"), F.col("x"), F.col("y")).alias("known_cm"),
    )
    rows = V.ranges(spark, sf).join(known, ["run_id", "tag_id", "t", "anchor_id"])
    out = quality.calibration_bias(rows)
    return out.select(
        "anchor_id", "n", *_rs(["mean_cm", "stddev_cm", "median_residual_cm", "bias_cm", "residual_stddev_cm"], 3)
    )


# --- alignment ------------------------------------------------------------------


def latest_per_anchor(spark: SparkSession, sf: str) -> DataFrame:
    out = align.latest_per_anchor(V.ranges(spark, sf))
    return out.select("tag_id", "anchor_id", _r("t"), _r("distance_cm", 3), "n")


def live_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Live table: the latest value of each anchor that is still fresh at the tag's last arrival."""
    last = align.latest_per_anchor(V.ranges(spark, sf))
    # a tag has at most eight anchors, so this window is bounded
    now = F.max("t").over(Window.partitionBy(*KEYS))
    out = last.where(F.col("anchor_id").between(1, 8)).withColumn("age_s", now - F.col("t"))
    return out.where(F.col("age_s") <= K.MAX_AGE_S).select("tag_id", "anchor_id", _r("distance_cm", 3), _r("age_s"))


def _held(spark: SparkSession, sf: str, max_age: float = K.MAX_AGE_S) -> DataFrame:
    r = V.ranges(spark, sf)
    return align.hold(r, align.tick_grid(r, 8.0, K.MAX_AGE_S), IDS, max_age)


def asof_hold(spark: SparkSession, sf: str) -> DataFrame:
    held = _held(spark, sf)
    seen = F.array(
        *[F.struct(F.lit(a).alias("anchor_id"), F.col(f"d{a}").alias("d"), F.col(f"age{a}").alias("age")) for a in IDS]
    )
    rows = held.select("tag_id", "tick", F.explode(seen).alias("_s")).where(F.col("_s.d").isNotNull())
    return rows.select("tag_id", "tick", "_s.anchor_id", _r(F.col("_s.d"), 3, "distance_cm"), _r(F.col("_s.age"), 4, "age_s"))


def anchor_status(spark: SparkSession, sf: str) -> DataFrame:
    held = _held(spark, sf, 0.06)
    return held.select("tag_id", "tick", align.complete(IDS).alias("valid"), align.status_text(IDS).alias("status"))


def packet_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = align.packets(align.event_ticks(V.ranges(spark, sf), IDS), IDS, "log")
    return rows.select("tag_id", _r("t"), F.size("raw").alias("n_raw"), "valid", "source", _r(F.col("raw")[1], 3, "d1"))


def complete_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return align.complete_ticks(V.ranges(spark, sf), IDS).select(
        "tag_id", _r("t"), F.col("n_anchors").cast("int").alias("n_anchors"), "complete"
    )


def tick_delta(spark: SparkSession, sf: str) -> DataFrame:
    return align.with_dt(align.event_ticks(V.ranges(spark, sf), IDS)).select("tag_id", _r("t"), _r("dt", 6))


def tick_window_100ms(spark: SparkSession, sf: str) -> DataFrame:
    stamped = V.ranges(spark, sf).withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")))
    out = stamped.groupBy("tag_id", "anchor_id", F.window("ts", "100 milliseconds").alias("_w")).agg(
        F.max_by("distance_cm", "arrival").alias("distance_cm"), F.count(F.lit(1)).alias("n")
    )
    return out.select(
        "tag_id", "anchor_id", F.unix_millis("_w.start").alias("window_ms"), _r("distance_cm", 3), "n"
    )


def run_segments(spark: SparkSession, sf: str) -> DataFrame:
    ev = V.events(spark, sf).select(
        F.col("user_id").alias("tag_id"), "ts", "event_id", "event_type",
        scan.never_null(F.datediff("ts", F.lit("1970-01-01"))).alias("chunk"),
    )
    runs = align.with_run(ev, TAG, ["ts", "event_id"], F.col("event_type") == "error")
    return runs.select("tag_id", "event_id", "run_id")


def active_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges with the coordinates of their anchor in the layout chosen per tag."""
    chosen = V.ranges(spark, sf).withColumn("layout_id", F.pmod(F.col("tag_id"), F.lit(5)).cast("int") + 2)
    rows = chosen.join(S.anchor_table(spark, "3d"), ["layout_id", "anchor_id"])
    return rows.groupBy("layout_id", "layout_name", "anchor_id", "ax", "ay", "az").agg(
        F.count(F.lit(1)).alias("n"), _r(F.avg("distance_cm"), 3, "mean_cm")
    )


# --- smoothing and positions ------------------------------------------------------


def ema_distance(spark: SparkSession, sf: str) -> DataFrame:
    out = smooth.smooth(align.event_ticks(V.ranges(spark, sf), IDS), KEYS, DIST, 0.12, dt=None)
    return out.select("tag_id", _r("t"), *_rs(list(DIST.values()), 3))


def _ticks2d(spark: SparkSession, sf: str) -> DataFrame:
    x, y = solve2d.position(V.LAYOUT)
    ticks = align.event_ticks(V.ranges(spark, sf), IDS)
    return ticks.select(*KEYS, scan.CHUNK, "t", F.lit(V.TICK_S).alias("dt"), x.alias("x"), y.alias("y"))


def _pos2d(spark: SparkSession, sf: str) -> DataFrame:
    return _ticks2d(spark, sf).where(F.col("x").isNotNull())


def ema_position(spark: SparkSession, sf: str) -> DataFrame:
    out = smooth.smooth(_ticks2d(spark, sf), KEYS, {"x": "xs", "y": "ys"}, 0.10)
    return out.select("tag_id", _r("t"), *_rs(["xs", "ys"], 3))


def project_ground(spark: SparkSession, sf: str) -> DataFrame:
    out = locate.project_ranges(V.ranges(spark, sf, slant=True))
    return out.select("tag_id", _r("t"), "anchor_id", _r("slant_cm", 3), _r("distance_cm", 3))


def locate_2d(spark: SparkSession, sf: str) -> DataFrame:
    r = V.ranges(spark, sf).withColumn("layout_id", F.lit(4))
    out = solve2d.solve_long(r, S.anchor_table(spark, "3d"))
    return out.select("tag_id", _r("t"), *_rs(["x", "y"], 3))


def locate_2d_full(spark: SparkSession, sf: str) -> DataFrame:
    out = locate.locate_2d(V.ranges(spark, sf), V.LAYOUT, truth=V.truth(spark, sf))
    return out.select(
        "tag_id", _r("t"), "valid", *_rs(["x_raw", "y_raw", "x", "y", "raw_err", "smooth_err", "avg_smooth_err"], 3)
    )


def locate_2d_frame(spark: SparkSession, sf: str) -> DataFrame:
    """The regular-clock mode: a held value is applied at every tick until it is too old."""
    out = locate.locate_2d(V.ranges(spark, sf), V.LAYOUT, mode="frame")
    return out.select("tag_id", _r("t"), "valid", *_rs(["x_raw", "y_raw", "x", "y"], 3))


def locate_3d_to_2d(spark: SparkSession, sf: str) -> DataFrame:
    out = locate.locate_3d_to_2d(V.ranges(spark, sf, slant=True), V.LAYOUT)
    return out.select("tag_id", _r("t"), *_rs(["x_raw", "y_raw", "x", "y"], 3), _r(F.col("raw_3d")[1], 3, "slant_1"))


def circle_pairs(spark: SparkSession, sf: str) -> DataFrame:
    ticks = align.event_ticks(V.ranges(spark, sf), list(PAIR))
    pts = ticks.select("tag_id", "t", solve2d.pair_points(PAIR).alias("p")).where(F.size("p") == 2)
    cells = [_r(F.col("p")[i][c], 3, f"{c}{i + 1}") for i in (0, 1) for c in ("x", "y")]
    return pts.select("tag_id", _r("t"), *cells)


def locate_3d_point(spark: SparkSession, sf: str) -> DataFrame:
    ticks = align.event_ticks(V.ranges(spark, sf, slant=True), IDS)
    out = solve3d.locate_points(ticks, V.LAYOUT_Z).where(F.col("x").isNotNull())
    return out.select("tag_id", _r("t"), *_rs(["x", "y", "z"], 3))


def locate_3d_track(spark: SparkSession, sf: str) -> DataFrame:
    out = locate.locate_3d(V.ranges(spark, sf, slant=True), V.LAYOUT_Z)
    cols = ["x_raw", "y_raw", "z_raw", "x", "y", "z", "delay_total_s"]
    return out.select("tag_id", _r("t"), *_rs(cols, 3))


def score_3d_track(spark: SparkSession, sf: str) -> DataFrame:
    """The whole 3D job with its delayed truth and running figures."""
    out = locate.locate_3d(V.ranges(spark, sf, slant=True), V.LAYOUT_Z, truth=V.truth(spark, sf))
    cols = ["x", "y", "z", "err3d", "traj_err_3d", "measured_delay", "avg_err3d", "avg_precision", "path_ratio"]
    return out.select("tag_id", _r("t"), *_rs(cols, 3))


# --- motion ---------------------------------------------------------------------


def _hops(spark: SparkSession, sf: str) -> DataFrame:
    t = V.truth(spark, sf)
    return scan.with_chunk(t).select(
        *KEYS, scan.CHUNK, "t", F.lit(V.TICK_S).alias("dt"), "x", "y", G.jump_height(F.col("z")).alias("jump")
    )


def segment_speed(spark: SparkSession, sf: str) -> DataFrame:
    return motion.segments(_pos2d(spark, sf)).select("tag_id", _r("t"), *_rs(["step_cm", "speed_cm_s"], 2))


_CARD = ["time_s", "distance_m", "avg_speed_kmh", "max_speed_kmh"]


def player_card(spark: SparkSession, sf: str) -> DataFrame:
    card = motion.player_card(_pos2d(spark, sf))
    return card.select("tag_id", "samples", *_rs(_CARD, 4), "jump_count", "max_jump_cm")


def player_card_3d(spark: SparkSession, sf: str) -> DataFrame:
    card = motion.player_card(_hops(spark, sf), jump="jump")
    return card.select("tag_id", "samples", *_rs(_CARD, 4), _r("speed_sum_cm_s", 2), "jump_count", _r("max_jump_cm"))


def jumps(spark: SparkSession, sf: str) -> DataFrame:
    seg = motion.segments(_hops(spark, sf), jump="jump")
    return seg.where("takeoff").select("tag_id", _r("t"), _r("jump"))


def running_max(spark: SparkSession, sf: str) -> DataFrame:
    out = motion.running_peaks(_hops(spark, sf), jump="jump")
    return out.select("tag_id", _r("t"), _r("max_time_s"), _r("max_speed_so_far", 2), _r("max_jump_so_far"))


def trail_220(spark: SparkSession, sf: str) -> DataFrame:
    return motion.trail(_pos2d(spark, sf)).select("tag_id", "rank", _r("t"), *_rs(["x", "y"], 3))


def trail_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The same trail over a larger table: the last rows of each supplier's shipments."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_suppkey", "l_orderkey", "l_linenumber", F.datediff("l_shipdate", F.lit("1990-01-01")).alias("day")
    )
    rows = li.select(
        "l_suppkey",
        (F.col("day").cast("long") * 100000000 + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        scan.never_null(F.floor(F.col("day") / 30)).alias(scan.CHUNK),
    )
    return motion.trail(rows, 220, ["l_suppkey"], "pos").select("l_suppkey", "rank", "pos")


def running_total_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Running peak and count over shipments, the ordered operators on a larger table."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity",
        scan.never_null(F.floor(F.datediff("l_shipdate", F.lit("1990-01-01")) / 30)).alias(scan.CHUNK),
    )
    out = scan.running(
        li, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"],
        {"peak": ("max", F.col("l_quantity")), "n": ("count", F.lit(1)), "total": ("sum", F.col("l_quantity"))},
    )
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "peak", "n", "total")


# --- heatmap and zones --------------------------------------------------------------


def heat_cells(spark: SparkSession, sf: str) -> DataFrame:
    return heatmap.heat(_pos2d(spark, sf)).select("tag_id", "row", "col", "hits")


def heatmap_max(spark: SparkSession, sf: str) -> DataFrame:
    return heatmap.heat_summary(heatmap.heat(_pos2d(spark, sf))).select("tag_id", "version", "max_hits", "cells")


def heatmap_kernel(spark: SparkSession, sf: str) -> DataFrame:
    return heatmap.kernel_sums(heatmap.heat(_pos2d(spark, sf))).select("tag_id", "row", "col", _r("weighted", 6))


def heatmap_smooth(spark: SparkSession, sf: str) -> DataFrame:
    return heatmap.smooth_heat(heatmap.heat(_pos2d(spark, sf))).select("tag_id", "row", "col", _r("value", 6))


def heatmap_dense(spark: SparkSession, sf: str) -> DataFrame:
    """The dense smoothed grid of the whole court, all tags together."""
    grid = heatmap.heat(_pos2d(spark, sf), ["run_id"])
    return heatmap.smooth_heat(grid, keys=["run_id"], dense=True).select("row", "col", _r("value", 6))


def heatmap_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return heatmap.heat(_pos2d(spark, sf), until=2.0).select("tag_id", "row", "col", "hits")


#: a hundred snapshots, one every 0.05 s
SNAPSHOTS = [round(0.517 + 0.05 * i, 3) for i in range(100)]


def heat_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    out = heatmap.heat_snapshots(_pos2d(spark, sf), SNAPSHOTS)
    return out.select("tag_id", "snapshot_id", "heat_version", "row", "col", "hits")


def heat_snapshots_rgba(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothed and coloured grids of three snapshots of all tags together."""
    keys = ["run_id", "snapshot_id", "heat_version"]
    grids = heatmap.heat_snapshots(_pos2d(spark, sf), [1.0, 2.0, 4.0], ["run_id"])
    fixed = heatmap.smooth_heat(grids, keys=keys).withColumn("value", F.round("value", 6))
    return heatmap.coloured(fixed, keys).select("snapshot_id", "heat_version", "row", "col", "r", "g", _r("b", 3), "a")


def heat_rgba(spark: SparkSession, sf: str) -> DataFrame:
    smoothed = heatmap.smooth_heat(heatmap.heat(_pos2d(spark, sf), ["run_id"]), keys=["run_id"])
    # the ramp truncates, so both sides must start from the same decimals
    fixed = smoothed.withColumn("value", F.round("value", 6))
    return heatmap.coloured(fixed, ["run_id"]).select("row", "col", "r", "g", _r("b", 3), "a")


def zone_time(spark: SparkSession, sf: str) -> DataFrame:
    return zones.zone_time(_pos2d(spark, sf)).select("tag_id", "zone", "samples", _r("seconds"))


def hoop_distance(spark: SparkSession, sf: str) -> DataFrame:
    return zones.hoop_distance(_pos2d(spark, sf)).select("tag_id", _r("t"), _r("hoop_cm", 3))


# --- accuracy ----------------------------------------------------------------------


def _scored2d(spark: SparkSession, sf: str) -> DataFrame:
    est = _pos2d(spark, sf).withColumn("x_raw", F.col("x")).withColumn("y_raw", F.col("y"))
    ema = smooth.smooth(est, KEYS, {"x_raw": "xs", "y_raw": "ys"}, 0.10)
    named = ema.select(*KEYS, scan.CHUNK, "t", "x_raw", "y_raw", F.col("xs").alias("x"), F.col("ys").alias("y"))
    return accuracy.errors_2d(accuracy.with_truth(named, V.truth(spark, sf)), 100.0)


def error_final_2d(spark: SparkSession, sf: str) -> DataFrame:
    out = accuracy.final_errors_2d(_scored2d(spark, sf))
    return out.select("tag_id", "n", *_rs([c for c in out.columns if c[:3] in ("avg", "max")], 3))


def error_running_2d(spark: SparkSession, sf: str) -> DataFrame:
    out = accuracy.running_errors_2d(shared_checkpoint(_scored2d(spark, sf)))
    return out.select("tag_id", _r("t"), *_rs([c for c in out.columns if c[:3] in ("avg", "max")], 3))


def precision(spark: SparkSession, sf: str) -> DataFrame:
    rows = accuracy.with_truth(_pos2d(spark, sf), V.truth(spark, sf))
    err = G.distance_2d(F.col("true_x"), F.col("true_y"), F.col("x"), F.col("y"))
    return rows.select("tag_id", _r("t"), _r(err, 3, "err"), _r(G.precision_percent(err, 100.0), 3, "precision"))


def filter_delay(spark: SparkSession, sf: str) -> DataFrame:
    ticks = align.with_dt(align.event_ticks(V.ranges(spark, sf), IDS))
    d1, d2 = G.filter_delay(0.12, F.col("dt")), G.filter_delay(0.08, F.col("dt"))
    return ticks.where(F.col("dt").isNotNull()).select(
        "tag_id", _r("t"), _r(G.millis(d1 + d2), 3, "delay_ms"), _r(G.alpha_for_dt(0.12, F.col("dt")), 6, "alpha")
    )


def truth_at_delay(spark: SparkSession, sf: str) -> DataFrame:
    aims = _pos2d(spark, sf).select(*KEYS, "t", (F.col("t") - 0.3301).alias("at"))
    out = accuracy.truth_at(aims, V.truth(spark, sf), "at", history=40)
    return out.select("tag_id", _r("t"), *_rs(["at_x", "at_y", "at_z"], 3))


def truth_between_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Delayed truth of ticks that lie between the samples of the truth."""
    aims = _pos2d(spark, sf).select(*KEYS, (F.col("t") + 0.0213).alias("t"), (F.col("t") - 0.2301).alias("at"))
    out = accuracy.truth_at(aims, V.truth(spark, sf), "at", history=10)
    return out.select("tag_id", _r("t"), *_rs(["at_x", "at_y", "at_z"], 3))


def _est3d(spark: SparkSession, sf: str) -> DataFrame:
    est = _ticks2d(spark, sf).withColumn("z", F.when(F.col("x").isNotNull(), F.lit(95.0)))
    return accuracy.with_truth(est, V.truth(spark, sf))


def best_delay(spark: SparkSession, sf: str) -> DataFrame:
    out = accuracy.best_delay(_est3d(spark, sf))
    return out.select("tag_id", _r("t"), _r("measured_delay"), _r("delay_err", 3))


def error_3d(spark: SparkSession, sf: str) -> DataFrame:
    est = _est3d(spark, sf).withColumn("x_raw", F.col("x")).withColumn("delay_total_s", F.lit(0.3301))
    track = est.select(*KEYS, scan.CHUNK, "t", "x", "y", "z", "x_raw", "delay_total_s")
    out = locate.score_3d(track, V.truth(spark, sf), 90.0)
    cols = ["err3d", "errxy", "errz", "precision", "traj_err_3d", "traj_err_xy", "traj_err_z", "traj_precision", "avg_err3d",
            "avg_errxy", "avg_errz", "avg_precision", "avg_delay_total_s", "avg_measured_delay", "avg_traj_err_3d",
            "avg_traj_err_xy", "avg_traj_err_z", "avg_traj_precision", "max_measured_delay", "path_ratio"]
    # a mean height error may lie on the edge of three digits
    fine = ["traj_err_z", "avg_traj_err_z"]
    return out.select("tag_id", _r("t"), *_rs([c for c in cols if c not in fine], 3), *_rs(fine, 6))


# --- settings ----------------------------------------------------------------------


def settings_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    """Settings documents assembled from the events, good and bad ones alike."""
    ev = V.events(spark, sf)
    k = F.get_json_object("props", "$.k")
    doc = F.concat(
        F.lit('{"settings_version": '), (F.col("event_id") % 3).cast("string"),
        F.lit(', "active_anchor_count": '), k,
        F.lit(', "alpha_dist": '), F.round(F.col("value") / 50, 4).cast("string"),
        F.lit(', "precision_tolerance_cm": "'), F.when(F.col("event_type") == "error", F.lit("bad")).otherwise(k), F.lit('"}'),
    )
    out = S.sanitize(ev.select("event_id", doc.alias("raw")), "2d")
    return out.select(
        "event_id", "active_anchor_count", _r("alpha_dist"), _r("alpha_pos"), _r("precision_tolerance_cm"), "layouts_apply"
    )


def alpha_sweep(spark: SparkSession, sf: str) -> DataFrame:
    out = locate.alpha_sweep(
        V.ranges(spark, sf), V.LAYOUT, V.truth(spark, sf), [0.12, 0.5], [100.0, 200.0], {"a1_x+50": {1: (50.0, 0.0)}}
    )
    return out.select("alpha", "tolerance_cm", "anchor_shift", "n", *_rs(["avg_err", "avg_precision"], 3))


# --- streams ------------------------------------------------------------------------


Parts = Iterable[object]


def _staged(rows: DataFrame, part: Column, n: int, name: str) -> tuple[DataFrame, Parts]:
    """A stream over an empty folder, and the ``n`` parts of the rows that come into it, one with every step of an iteration.

    The rows are made once and written by part; a part is as many files as tasks write.
    """
    spark = rows.sparkSession
    staged, table = fresh_path(spark, f"{name}-parts"), fresh_path(spark, name)
    rows.withColumn("_part", part.cast("int")).write.partitionBy("_part").parquet(staged)
    every = spark.read.schema(StructType([*rows.schema.fields, StructField("_part", IntegerType())])).parquet(staged)
    # the folder is there before its first part
    spark.createDataFrame([], rows.schema).write.parquet(table)

    def come() -> Iterator[int]:
        for k in range(n):
            every.where(F.col("_part") == k).select(*rows.columns).write.mode("append").parquet(table)
            yield k

    return spark.readStream.schema(rows.schema).parquet(table), come()


def _drain(stream: DataFrame, name: str, mode: str, keys: list[str] | None = None, parts: Parts = (None,)) -> DataFrame:
    """Run a stream over what is there and read back what it wrote; with ``parts``, again after each of them has come.

    ``append`` rows are final. ``update`` rows are logged with the number of their
    batch, and the last one of every key is read: a batch that is repeated changes
    nothing. ``complete`` replaces the table of the batch before.
    """
    spark = stream.sparkSession
    out, progress = fresh_path(spark, name), fresh_path(spark, f"{name}-progress")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    elif mode == "update":
        writer = writer.foreachBatch(lambda df, k: df.withColumn("_batch", F.lit(k)).write.mode("append").parquet(out))
    else:
        writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    for _ in parts:
        writer.start().awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(out)
    log = spark.read.schema(stream.schema.add("_batch", "long")).parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    return log.groupBy(*keys).agg(*[F.max_by(c, "_batch").alias(c) for c in rest])


def alpha_sweep_3d(spark: SparkSession, sf: str) -> DataFrame:
    settings = [{}, {"alpha_dist": 0.5, "alpha_pos": 0.5, "precision_tolerance_cm": 200.0}, {"alpha_dist": 0.9, "alpha_pos": 0.3}]
    out = locate.alpha_sweep_3d(V.ranges(spark, sf, slant=True), V.LAYOUT_Z, V.truth(spark, sf), settings)
    averages = [c for c in out.columns if c.startswith("avg_")]
    return out.select("setting", "alpha_dist", "alpha_pos", "precision_tolerance_cm", "n", *_rs(averages, 3))


def stream_ranges_log(spark: SparkSession, sf: str) -> DataFrame:
    live = V.messages_of(V.event_stream(spark, sf))
    out, progress = fresh_path(spark, "log"), fresh_path(spark, "log-progress")
    jobs.write_log(live, out, progress).awaitTermination()
    return spark.read.parquet(out).select("raw_message", "event", "anchor_id", "distance_cm", "fields_json")


def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    live = ingest.parse_ranges(V.messages_of(V.event_stream(spark, sf)))
    out = _drain(jobs.latest_ranges(live), "latest", "update", ["tag_id", "anchor_id"])
    return out.select("tag_id", "anchor_id", F.unix_micros("last_ts").alias("last_us"), "distance_cm", "n")


def stream_tick_window(spark: SparkSession, sf: str) -> DataFrame:
    live = ingest.parse_ranges(V.messages_of(V.event_stream(spark, sf)))
    out = _drain(jobs.tick_windows(live), "ticks", "update", ["tag_id", "anchor_id", "tick_start"])
    return out.select("tag_id", "anchor_id", F.unix_millis("tick_start").alias("tick_ms"), "distance_cm", "n")


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    device = V.event_stream(spark, sf).select(
        F.col("user_id").alias("tag_id"), F.timestamp_millis(F.col("event_id") * 100).alias("device_ts")
    )
    out = _drain(jobs.session_gaps(device, "device_ts"), "sessions", "complete")
    return out.select("tag_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n")


def stream_repeat_suppress(spark: SparkSession, sf: str) -> DataFrame:
    tel = ingest.telemetry(V.messages_of(V.event_stream(spark, sf)))
    timed = tel.select("tag_id", "session", "src", F.pmod("cb", F.lit(20)).alias("cb"), F.timestamp_millis("ms").alias("device_ts"))
    # the table is in order already: nothing has to wait
    out = _drain(repeats.first_of_repeats(timed, "device_ts", wait_s=0.0), "repeats", "append")
    return out.where("NOT late").select("tag_id", "session", "src", "cb", F.unix_millis("device_ts").alias("ms"))


def _closed(rows: DataFrame, part: Column, n: int, name: str) -> tuple[DataFrame, Parts]:
    """Rows as a stream in ``n`` parts, one a batch; a last line of no board, far in the future, releases what boards hold."""
    last = rows.sparkSession.createDataFrame([tuple({"tag_id": -1, "session": "end", "src": "end", "cb": 0}.get(c) for c in rows.columns)], rows.schema)
    last = last.withColumn("device_ts", F.lit("2100-01-01 00:00:00").cast("timestamp")).withColumn("_end", F.lit(n))
    every = rows.withColumn("_end", part.cast("int")).unionByName(last)
    live, parts = _staged(every, F.col("_end"), n + 1, name)
    return live.drop("_end"), parts


def stream_repeat_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    """Device measurements of lines that arrive up to two seconds late, over several batches: as if they had come in order."""
    tel = ingest.telemetry(V.messages(spark, sf))
    rows = tel.select("tag_id", "session", "src", F.pmod("cb", F.lit(20)).alias("cb"), F.timestamp_millis(F.col("ms")).alias("device_ts"))
    came = F.unix_micros("device_ts") + F.pmod(F.xxhash64("tag_id", "device_ts"), F.lit(int(K.MAX_AGE_S * 1e6) - 1000))
    cuts = rows.select(F.percentile_approx(came, [k / 5 for k in range(1, 5)]).alias("c")).first()["c"] or []
    part = sum(((came > c).cast("int") for c in cuts), F.lit(0))
    live, parts = _closed(rows, part, len(cuts) + 1, "shuffled")
    out = _drain(repeats.first_of_repeats(live, "device_ts"), "repeats", "append", parts=parts).where("NOT late AND tag_id >= 0")
    return out.select("tag_id", "session", "src", "cb", F.unix_millis("device_ts").alias("ms"))


def stream_device_clock(spark: SparkSession, sf: str) -> DataFrame:
    """Device times of board lines that arrive over several batches: boots counted, times off by the delay and the drift bound at most."""
    rows = V.board_lines(spark, sf).select("tag_id", "session", "src", "cb", "ms", "sent_us", F.timestamp_micros("us").alias("device_ts"))
    part = F.least(F.floor((F.col("sent_us") - 1_000_000_000_000) / 250_000_000), F.lit(PARTS - 1))
    live, parts = _closed(rows, part, PARTS, "board-lines")
    out = _drain(boardclock.device_time(live, "device_ts"), "board-times", "append", parts=parts).where("NOT late AND tag_id >= 0")
    off = F.col("device_us") - F.col("sent_us")
    return out.groupBy("tag_id", "boot").agg(
        F.count(F.lit(1)).alias("lines"), F.max("cb").alias("last_cb"), F.bool_and(off.between(-150_000, 1_820_000)).alias("within_delay")
    )


def stream_fresh(spark: SparkSession, sf: str) -> DataFrame:
    """Live table of a stream with the values that are fresh at a given time."""
    live = ingest.parse_ranges(V.messages_of(V.event_stream(spark, sf)))
    out = _drain(jobs.latest_ranges(live), "fresh", "update", ["tag_id", "anchor_id"])
    return jobs.fresh(out, "2024-01-25 00:00:00", 86400.0).select("tag_id", "anchor_id", "distance_cm")


def stream_heat(spark: SparkSession, sf: str) -> DataFrame:
    """Running occupancy over a stream of positions."""
    table = fresh_path(spark, "placed")
    _pos2d(spark, sf).select(*KEYS, "t", "x", "y").repartition(3).write.parquet(table)
    schema = spark.read.parquet(table).schema
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(table)
    out = _drain(jobs.running_heat(live), "heat", "update", [*KEYS, "row", "col"])
    return out.select("tag_id", "row", "col", "hits")


PARTS = 4


def _arriving(rows: DataFrame, name: str, t: Column, anchor: Column) -> tuple[DataFrame, Parts]:
    """Rows as a stream in time order, a part per batch, cut in the middle of a stamp."""
    part = F.floor((t / V.TICK_S + (anchor - 1) / 4 + 0.5) / 20)
    return _staged(rows, F.least(part, F.lit(PARTS - 1)), PARTS, name)


def stream_track(spark: SparkSession, sf: str) -> DataFrame:
    """Stateful tracking over the ranges, written out first so that they arrive as files."""
    rows = V.ranges(spark, sf).select("run_id", "tag_id", "t", "arrival", "anchor_id", "distance_cm")
    live, parts = _arriving(rows, "ranges", F.col("t"), F.col("anchor_id"))
    out = tracker.final_ticks(_drain(tracker.track(live, V.LAYOUT), "track", "append", parts=parts))
    return out.select("tag_id", _r("t"), *_rs(["x_raw", "y_raw", "x", "y"], 3))


def messages_to_positions(spark: SparkSession, sf: str) -> DataFrame:
    """The whole road: texts to ranges to held, smoothed positions."""
    ranges, _ = ingest.ranges_of(V.range_messages(spark, sf))
    out = locate.locate_2d(shared_checkpoint(ranges), V.LAYOUT)
    return out.select("tag_id", _r("t"), "valid", *_rs(["x_raw", "y_raw", "x", "y"], 3))


def stream_messages_to_positions(spark: SparkSession, sf: str) -> DataFrame:
    """The same road over a stream of messages."""
    sent = V.range_messages(spark, sf)
    anchor = F.substring("message", 2, 1).cast("int")
    live, parts = _arriving(sent, "messages", F.unix_micros("ingest_ts") / 1e6, anchor)
    ranges, _ = ingest.ranges_of(live)
    out = tracker.final_ticks(_drain(tracker.track(ranges, V.LAYOUT), "positions", "append", parts=parts))
    return out.select("tag_id", _r("t"), *_rs(["x_raw", "y_raw", "x", "y"], 3))


def card_from_locate_2d(spark: SparkSession, sf: str) -> DataFrame:
    """Player card of the smoothed, carried estimate."""
    card = motion.player_card(shared_checkpoint(locate.locate_2d(V.ranges(spark, sf), V.LAYOUT)))
    return card.select("tag_id", "samples", *_rs(_CARD, 4), "jump_count", "max_jump_cm")


def card_from_locate_3d(spark: SparkSession, sf: str) -> DataFrame:
    """Player card of the 3D estimate, jumps from its height; quick filters, so that hops of 0.15 s show."""
    track = locate.locate_3d(V.ranges(spark, sf, slant=True), V.LAYOUT_Z, QUICK)
    card = motion.player_card(shared_checkpoint(track).withColumn("jump", G.jump_height(F.col("z"))), jump="jump")
    return card.select("tag_id", "samples", *_rs(_CARD, 3), "jump_count", _r("max_jump_cm", 3))


QUICK = {"alpha_dist": 0.7, "alpha_pos": 0.6}


def _tracks(spark: SparkSession, sf: str, settings: dict[str, float]) -> track3d.Tracks:
    """A 3D stream run over the ranges, in files that are cut in the middle of a stamp."""
    rows = V.ranges(spark, sf, slant=True).select("run_id", "tag_id", "t", "arrival", "anchor_id", "distance_cm")
    tracks = track3d.Tracks(spark, V.LAYOUT_Z, fresh_path(spark, "tracks"), settings)
    live, parts = _arriving(rows, "slant", F.col("t"), F.col("anchor_id"))
    progress = fresh_path(spark, "tracks-progress")
    for _ in parts:
        tracks.start(live, progress).awaitTermination()
    return tracks


def stream_track_3d(spark: SparkSession, sf: str) -> DataFrame:
    """The sequential 3D track over several batches, as the batch job gives it."""
    track, _ = _tracks(spark, sf, {}).finished()
    return track.select("tag_id", _r("t"), *_rs(["x_raw", "y_raw", "z_raw", "x", "y", "z"], 3))


def stream_card_3d(spark: SparkSession, sf: str) -> DataFrame:
    """The running card of the 3D stream after its last batch."""
    _, card = _tracks(spark, sf, QUICK).finished()
    return card.select("tag_id", "samples", *_rs(_CARD, 3), "jump_count", _r("max_jump_cm", 3))


def heat_from_locate_2d(spark: SparkSession, sf: str) -> DataFrame:
    """Heat report of the estimate: cells, smoothing and colours in one chain."""
    placed = locate.locate_2d(V.ranges(spark, sf), V.LAYOUT).where(F.col("x").isNotNull())
    smoothed = heatmap.smooth_heat(heatmap.heat(placed, ["run_id"]), keys=["run_id"])
    return heatmap.coloured(smoothed.withColumn("value", F.round("value", 6)), ["run_id"]).select("row", "col", "r", "g", _r("b", 3), "a")


def locate_3d_async(spark: SparkSession, sf: str) -> DataFrame:
    """3D track from stamps of one anchor each: ranges are held between their arrivals."""
    seq = F.round(F.col("t") / V.TICK_S).cast("int")
    one = V.ranges(spark, sf, slant=True).where(F.col("anchor_id") == seq % 4 + 1)
    out = locate.locate_3d(one, V.LAYOUT_Z, mode="event")
    return out.select("tag_id", _r("t"), *_rs(["x_raw", "y_raw", "z_raw", "x", "y", "z"], 3))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        parse_fields, parse_ranges, parse_ranges_session, event_label, fields_json, ranges_log, rows_written,
        bounded_capture, message_counts, telemetry_valid, telemetry_rejects, sentinel_clean, failed_share,
        session_anchor_map, response_rate, stale_anchors, repeat_suppress, session_gaps, calibration_bias,
        latest_per_anchor, live_ranges, asof_hold, anchor_status, packet_rows, complete_ticks, tick_delta,
        tick_window_100ms, run_segments, active_layout, ema_distance, ema_position, project_ground, locate_2d,
        locate_2d_full, locate_2d_frame, locate_3d_to_2d, circle_pairs, locate_3d_point, locate_3d_track, score_3d_track, segment_speed,
        player_card, player_card_3d, jumps, running_max, trail_220, trail_lines, running_total_lines, heat_cells,
        heatmap_max, heatmap_kernel, heatmap_smooth, heatmap_dense, heatmap_snapshot, heat_snapshots,
        heat_snapshots_rgba, heat_rgba, zone_time,
        hoop_distance, error_final_2d, error_running_2d, precision, filter_delay, truth_at_delay, truth_between_samples, best_delay,
        error_3d, settings_sanitize, alpha_sweep, alpha_sweep_3d, stream_ranges_log, stream_latest, stream_tick_window,
        stream_sessions, stream_repeat_suppress, stream_track, messages_to_positions,
        stream_messages_to_positions, card_from_locate_2d, heat_from_locate_2d, locate_3d_async,
        stream_fresh, stream_heat, card_from_locate_3d, stream_track_3d, stream_card_3d, device_clock, ranges_device_clock, stream_repeat_shuffled, stream_device_clock, log_files, message_files, ranges_device_time, truth_file,
    )
}
