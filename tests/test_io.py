"""Sources, the calibration log, settings documents and streams from files."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import SF
from tagtrack.operators import align
from tagtrack.plans import eventviews as V
from tagtrack.plans import locate
from tagtrack.sources import log, messages, settings
from tagtrack.streaming import jobs, tracker

ROWS = [("2024-01-01 10:00:00.123", "10.0.0.1", 4210, " A1=5;A2=6 "), ("2024-01-01 10:00:09", "10.0.0.2", 4210, "heartbeat"),
        ("2024-01-01 10:00:20", "10.0.0.1", 4210, 'id=3 dist=7 note="q,x"')]


@pytest.fixture()
def table(spark):
    df = spark.createDataFrame(ROWS, "ts string, source_ip string, source_port int, message string")
    return df.select(F.col("ts").cast("timestamp").alias("ingest_ts"), "source_ip", "source_port", "message")


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_read_messages(spark, table, tmp_path, fmt):
    path = str(tmp_path / fmt)
    writer = table.write.format(fmt)
    (writer.option("header", True).option("escape", '"') if fmt == "csv" else writer).save(path)
    got = messages.read_messages(spark, path, fmt).orderBy("ingest_ts").collect()
    assert got[0].message == "A1=5;A2=6" and got[1].source_ip == "10.0.0.2" and len(got) == 3
    assert got[2].message == 'id=3 dist=7 note="q,x"'


def test_read_text_lines(spark, tmp_path):
    (tmp_path / "in.txt").write_text("A1=5\n\nA2=6\n")
    got = messages.read_messages(spark, str(tmp_path / "in.txt"), "text").collect()
    assert sorted(r.message for r in got) == ["", "A1=5", "A2=6"] and got[0].ingest_ts is not None


def test_capture_bounds_reach_the_scan(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "m"))
    df = messages.captured(messages.read_messages(spark, str(tmp_path / "m")), "2024-01-01 10:00:00", 9.0)
    assert df.count() == 1
    assert "PushedFilters: [IsNotNull(ingest_ts), GreaterThanOrEqual" in df._jdf.queryExecution().executedPlan().toString()
    assert messages.captured(table, "2024-01-01 10:00:05", None).count() == 2


def test_log_round_trip(spark, table, tmp_path):
    path = str(tmp_path / log.log_name(datetime(2026, 5, 13, 14, 15, 22)))
    assert path.endswith("uwb_calibration_20260513_141522.csv")
    log.write_log(table, path)
    log.write_log(table, path)
    got = log.read_log(spark, path).orderBy("timestamp_s", "anchor_id").collect()
    assert len(got) == 6 and got[0].timestamp_iso == "2024-01-01T10:00:00.123"
    assert [(r.anchor_id, r.distance_cm) for r in got[::2]] == [(1, 5.0), (2, 6.0), (3, 7.0)]
    assert got[4].raw_message == 'id=3 dist=7 note="q,x"' and got[4].fields_json == '{"dist":"7","id":"3","note":"\\"q"}'
    assert got[0].log_file.startswith("part-")


def test_settings_documents(spark):
    docs = [
        '{"alpha_dist": 0.5, "active_anchor_count": 9, "settings_version": 2}',
        "[1]", "nope", '{"alpha_dist": "abc", "alpha_pos": 0.5}', '{"active_anchor_count": "4.5"}',
        '{"alpha_pos": 5, "active_anchor_count": 3.9}', '{"alpha_pos": null, "alpha_dist": 0.9}',
        '{"settings_version": 2, "alpha_pos": 0.5, "layouts": {"2": {"anchors": {"1": ["q", 7]}}}}',
    ]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, raw string")
    got = [(r.active_anchor_count, r.alpha_dist, r.alpha_pos, r.layouts_apply) for r in settings.sanitize(df).orderBy("i").collect()]
    default = (4, 0.12, 0.10, False)
    assert got == [(6, 0.5, 0.1, True), default, default, default, default, (3, 0.12, 0.95, False), default, default]
    three = settings.sanitize(df, "3d").where("i = 1").first()
    assert (three.alpha_pos, three.precision_tolerance_cm, three.noise_ratio) == (0.08, 90.0, 0.012)
    flat = settings.sanitize(df, "3d_to_2d").where("i = 1").first()
    assert (flat.anchor_height_cm, flat.tag_assumed_height_cm) == (600.0, 95.0)


def test_layout_documents(spark):
    docs = [
        '{"settings_version": 2, "layouts": {"2": {"name": "x", "anchors": {"1": [1, 2], "2": [1, 2, 3]}}}}',
        '{"settings_version": 1, "layouts": {"2": {"anchors": {"1": [7, 7]}}}}',
        '{"settings_version": 2, "layouts": {"2": {"anchors": {"1": ["q", 7]}}}}',
    ]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, raw string")
    rows = settings.layout_rows(df)
    assert rows.groupBy("i").count().select(F.min("count")).first()[0] == 20
    got = {(r.i, r.anchor_id): (r.layout_name, r.ax, r.ay) for r in rows.where("layout_id = 2").collect()}
    default = ("2 ancres : ligne", -320.0, 900.0)
    assert got[(0, 1)] == ("x", 1.0, 2.0) and got[(0, 2)] == ("x", 2820.0, 900.0)
    assert got[(1, 1)] == default and got[(2, 1)] == default


def test_tracker_over_files_and_a_restart_equals_batch(spark, tmp_path):
    cols = ["run_id", "tag_id", "t", "arrival", "anchor_id", "distance_cm"]
    ranges = V.ranges(spark, SF).select(*cols).where("tag_id < 4").cache()
    src, out, progress = (str(tmp_path / p) for p in ("src", "out", "progress"))
    schema = ranges.schema

    def drain():
        live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        query = (
            tracker.track(live, V.LAYOUT).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()

    for lo, hi in ((0.0, 1.0), (1.0, 2.0)):
        ranges.where((F.col("t") > lo) & (F.col("t") <= hi)).coalesce(1).write.mode("append").parquet(src)
    drain()
    ranges.where("t > 2.0").coalesce(1).write.mode("append").parquet(src)
    drain()
    batch = locate.locate_2d(ranges, V.LAYOUT)
    both = tracker.final_ticks(spark.read.parquet(out)).alias("s").join(batch.alias("b"), ["tag_id", "t"], "full")
    apart = [F.abs(F.col(f"s.{c}") - F.col(f"b.{c}")) > 1e-6 for c in ("x", "y", "x_raw", "y_raw")]
    nulls = [F.col(f"s.{c}").isNull() != F.col(f"b.{c}").isNull() for c in ("x", "x_raw")]
    wrong = both.where(F.greatest(*[F.coalesce(a, F.lit(False)).cast("int") for a in apart + nulls]) == 1)
    assert wrong.count() == 0
    assert both.count() == ranges.select("tag_id", "t").distinct().count()


def test_streaming_log_restarts_without_repeats(spark, table, tmp_path):
    src, out, progress = (str(tmp_path / p) for p in ("src", "out", "progress"))
    for _ in range(2):
        table.coalesce(1).write.mode("append").parquet(src)
        jobs.write_log(messages.stream_messages(spark, src, max_files=1), out, progress).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 6 and str(got.first().run_date) == "2024-01-01"


def test_fresh_rows(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:01")], "anchor_id int, s string")
    last = df.select("anchor_id", F.col("s").cast("timestamp").alias("last_ts"))
    assert [r.anchor_id for r in jobs.fresh(last, "2024-01-01 00:00:02.5").collect()] == [2]


def test_event_plan_is_one_table(spark):
    """The held ticks of the event mode come from one pass, without a union or a cross join."""
    r = spark.createDataFrame([], "run_id long, tag_id long, t double, arrival long, anchor_id int, distance_cm double")
    plan = align.hold_events(align.event_ticks(r, [1, 2, 3]), [1, 2, 3])._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Join" not in plan
