"""Cases in which rows used to get lost or counted wrongly."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tagtrack import constants as K
from tagtrack.operators import accuracy, align, ingest, quality, solve2d
from tagtrack.plans import barrier, locate
from tagtrack.sources import messages
from tagtrack.streaming import tracker

RANGES = "run_id long, tag_id long, t double, arrival long, anchor_id long, distance_cm double"
FLAT = {a: xy for a, xy in K.LAYOUTS_2D[4][1].items()}


def telemetry(spark, rows):
    df = spark.createDataFrame(rows, "tag_id long, session string, src string, cb long, s double")
    return df.withColumn("ingest_ts", F.timestamp_micros(F.round(F.col("s") * 1e6).cast("long"))).drop("s")


def test_measures_after_a_restart_are_new(spark):
    lines = [0, 0, 1, 2, 2, 2, 0, 1, 1]  # the board restarts before the last three
    rows = [(1, "0x1001", "a", cb, 0.1 * i) for i, cb in enumerate(lines)] + [(2, "0x1001", "a", cb, 0.05 + 0.1 * i) for i, cb in enumerate(lines)]
    got = quality.first_of_repeats(telemetry(spark, rows)).orderBy("tag_id", "ingest_ts").collect()
    assert [(r.cb, r.copies) for r in got if r.tag_id == 1] == [(0, 2), (1, 1), (2, 3), (0, 1), (1, 2)]
    assert len(got) == 10


def test_a_counter_that_stands_still_is_one_measure(spark):
    rows = [(1, "s", "a", 7, float(i)) for i in range(20)]
    got = quality.first_of_repeats(telemetry(spark, rows)).collect()
    assert [(r.cb, r.copies) for r in got] == [(7, 20)]


def test_healthy_board_has_rate_one(spark):
    rows = [(tag, "0x1001", "a", i, 0.05 + 0.1 * i) for tag in (1, 2) for i in range(50)]
    got = quality.response_rate(telemetry(spark, rows)).collect()
    rates = sorted((r.tag_id, r.window_start.second, r.rate) for r in got)
    assert len(rates) == 10
    assert all(rate == pytest.approx(0.9 if second == 0 else 1.0) for _, second, rate in rates)


def test_wide_anchor_numbers(spark):
    texts = ["A99999999999=5", "anchor=9999999999 d1=4", "A123456789012345678901234567890=5;A1=6", "A1=5"]
    df = spark.createDataFrame([(t,) for t in texts], "message string")
    got = sorted((r.anchor_id, r.distance_cm) for r in ingest.parse_ranges(df).collect())
    assert (99999999999, 5.0) in got and (9999999999, 4.0) in got and (1, 6.0) in got
    assert [r.message for r in ingest.oversized(df).collect()] == [texts[2]]


def test_long_letter_digit_text_is_read_in_linear_time(spark):
    df = spark.createDataFrame([("a1" * 500_000 + " A1=5",)], "message string")
    ingest.with_fields(df).collect()
    start = time.perf_counter()
    assert ingest.with_fields(df).first().fields == {"a1": "5"}
    assert time.perf_counter() - start < 5


@pytest.mark.parametrize("text", ["A2D1=350", "a=1,b=2", "5dist=3", "_x=1 y_=2", "a a=1", "é=1 b:2", "k = v;k=w", "1a1=2", "=3 x=", "a==b"])
def test_key_pattern_gives_the_same_fields(spark, text):
    import re

    pattern = re.compile(r"(?<![A-Za-z])([A-Za-z][A-Za-z0-9_]*)\s*[:=]\s*([^,;\s]+)")
    want = {k.lower(): v for k, v in pattern.findall(text)}
    assert ingest.with_fields(spark.createDataFrame([(text,)], "message string")).first().fields == want


def test_anchor_numbers_above_63_do_not_collide(spark):
    rows = [(0, 1, 0.0, 0, 1, 5.0), (0, 1, 0.0, 1, 65, 6.0), (0, 1, 1.0, 2, 65, 6.0), (0, 1, 1.0, 3, 65, 7.0)]
    got = align.complete_ticks(spark.createDataFrame(rows, RANGES), [1, 65]).orderBy("t").collect()
    assert [(r.n_anchors, r.complete) for r in got] == [(2, True), (1, False)]


def test_truth_on_other_doubles_of_the_same_time(spark):
    ticks = [(0, 1, i / 60.0) for i in range(700)]
    truth = [(0, 1, i * (1.0 / 60.0), float(i), 0.0, 0.0) for i in range(700)]
    est = spark.createDataFrame(ticks, "run_id long, tag_id long, t double")
    known = spark.createDataFrame(truth, "run_id long, tag_id long, t double, x double, y double, z double")
    assert accuracy.with_truth(est, known).where("true_x IS NULL").count() == 0


def test_truth_between_its_own_stamps(spark):
    ticks = [(0, 1, t) for t in (-0.5, 0.0, 0.25, 59.9, 60.5, 61.0, 70.0)]
    truth = [(0, 1, t, 10 * t, -t, 1.0) for t in (0.0, 1.0, 59.0, 61.0)]
    est = spark.createDataFrame(ticks, "run_id long, tag_id long, t double")
    known = spark.createDataFrame(truth, "run_id long, tag_id long, t double, x double, y double, z double")
    got = {r.t: r.true_x for r in accuracy.with_truth_between(est, known).collect()}
    assert got == {-0.5: None, 0.0: 0.0, 0.25: 2.5, 59.9: pytest.approx(599.0), 60.5: pytest.approx(605.0), 61.0: 610.0, 70.0: None}


def test_ticks_without_truth_are_no_delay_samples(spark):
    rows = [(0, 1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (0, 1, 0.1, 5.0, 0.0, 0.0, None, None, None), (0, 1, 0.15, 5.0, 0.0, 0.0, 9.0, 0.0, 0.0),
            (0, 1, 0.2, 0.5, 0.0, 0.0, None, None, None)]
    cols = "run_id long, tag_id long, t double, x double, y double, z double, true_x double, true_y double, true_z double"
    got = {r.t: (r.measured_delay, r.delay_err) for r in accuracy.best_delay(spark.createDataFrame(rows, cols)).collect()}
    assert got[0.1] == (None, None)
    assert got[0.2] == (pytest.approx(0.2), pytest.approx(0.5))


def test_repeat_beside_a_missing_anchor_is_no_fix(spark):
    layout = FLAT
    ids = sorted(layout)
    p = (700.0, 700.0)
    d = {a: math.dist(p, layout[a]) for a in ids}
    good = [(0, 1, 1.0, i, a, 4, d[a]) for i, a in enumerate(ids)]
    bad = [(0, 1, 2.0, i, a, 4, d[a]) for i, a in enumerate([ids[0], ids[1], ids[2], ids[2]])]
    twice = [(0, 1, 3.0, i, a, 4, v) for i, (a, v) in enumerate([(ids[0], 1.0), *[(a, d[a]) for a in ids]])]
    df = spark.createDataFrame(good + bad + twice, "run_id long, tag_id long, t double, arrival long, anchor_id int, layout_id int, distance_cm double")
    spots = spark.createDataFrame([(4, a, *layout[a]) for a in ids], "layout_id int, anchor_id int, ax double, ay double")
    got = {r.t: (r.x, r.y) for r in solve2d.solve_long(df, spots).collect()}
    assert set(got) == {1.0, 3.0}
    assert got[1.0] == pytest.approx(p) and got[3.0] == pytest.approx(p)


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 1001])
def test_exact_median(spark, n):
    rnd = random.Random(n)
    groups = {"a": [rnd.gauss(0, 50) for _ in range(n)], "b": [float(rnd.randrange(3)) for _ in range(n)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None)]
    got = {r.g: r.median for r in quality.exact_median(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    assert got == {g: sorted(vs)[(n + 1) // 2 - 1] for g, vs in groups.items()}


def test_messages_keep_their_columns_and_order(spark, tmp_path):
    rows = [(1, 10, "A1=5", 3), (1, 11, "A2=6", 4), (None, 12, "A1=7", 5), (1, None, "A1=8", 6), (1, 13, "A1=nan dist=1", 7)]
    df = spark.createDataFrame(rows, "tag_id long, s long, message string, arrival long").withColumn("ingest_ts", F.timestamp_seconds("s"))
    path = str(tmp_path / "m")
    df = df.withColumns({"source_ip": F.lit("h"), "source_port": F.lit(1), "run_id": F.lit(9).cast("long")})
    names = ["ingest_ts", "source_ip", "source_port", "message", "run_id", "tag_id", "arrival"]
    df.select(names).write.option("header", True).csv(path)
    read = messages.read_messages(spark, path, "csv", extra="run_id long, tag_id long, arrival long")
    kept, rejected = ingest.ranges_of(read)
    got = sorted(tuple(r) for r in kept.collect())
    assert got == [(9, 1, 10.0, 3, 1, 5.0), (9, 1, 11.0, 4, 2, 6.0)]
    assert sorted(r.reason for r in rejected.collect()) == ["no tag", "no time"]
    plain = str(tmp_path / "p")
    df.select(names[:-1]).write.parquet(plain)
    numbered = messages.read_messages(spark, plain, extra="run_id long, tag_id long", numbered=True)
    assert len({r.arrival for r in numbered.collect()}) == 5


def test_device_time(spark):
    line = "UWB,session=0x1002,src=0x1111,dst=0x2222,cb=1,status=0,lastDist=50,d1=50,ms=2500"
    df = spark.createDataFrame([(line,), ("A1=5",)], "message string").withColumn("ingest_ts", F.timestamp_seconds(F.lit(99)))
    kept, rejected = ingest.ranges_of(df, "session", time="device")
    assert [(r.t, r.anchor_id, r.distance_cm) for r in kept.collect()] == [(2.5, 2, 50.0)]
    assert [r.reason for r in rejected.collect()] == ["no time"]


def test_kafka_records_keep_their_offsets(spark):
    df = spark.createDataFrame([("10.0.0.1", "A1=5", 0, 42)], "key string, value string, partition int, offset long")
    got = messages.from_kafka(df.withColumn("timestamp", F.current_timestamp())).first()
    assert (got.arrival, got.partition, got.source_ip) == (42, 0, "10.0.0.1")


def test_clusters_need_a_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        barrier.shared_folder(Session())


def test_3d_from_stamps_of_one_anchor(spark):
    layout = K.LAYOUTS_3D[4][1]
    ids = sorted(layout)
    rows = []
    for i in range(40):
        a = ids[i % 4]
        rows.append((0, 1, i / 30.0, i, a, math.dist((900.0, 700.0, 100.0), layout[a])))
    df = spark.createDataFrame(rows, RANGES)
    assert locate.locate_3d(df, layout).where("x_raw IS NOT NULL").count() == 0
    for mode in ("event", "frame"):
        got = locate.locate_3d(df, layout, mode=mode, hz=30.0).where("x_raw IS NOT NULL").orderBy("t").collect()
        assert len(got) >= 37
        assert (got[-1].x_raw, got[-1].y_raw) == (pytest.approx(900, abs=20), pytest.approx(700, abs=20))


def drained(spark, tmp_path, batches):
    src, out, progress = (str(tmp_path / p) for p in ("src", "out", "progress"))
    for rows in batches:
        spark.createDataFrame(rows, RANGES).coalesce(1).write.mode("append").parquet(src)
    live = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    query = (
        tracker.track(live, FLAT).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return tracker.final_ticks(spark.read.parquet(out)).orderBy("t").collect()


def walk(n):
    rows = []
    for i in range(n):
        p = (700.0 + 10 * i, 800.0)
        rows += [(0, 1, i * 0.05, i * 4 + k, a, math.dist(p, FLAT[a])) for k, a in enumerate(sorted(FLAT))]
    return rows


def test_a_stamp_cut_by_a_batch_is_one_tick(spark, tmp_path):
    rows = walk(12)
    whole = drained(spark, tmp_path / "a", [rows])
    cut = drained(spark, tmp_path / "b", [rows[:9], rows[9:18], rows[18:19], rows[19:]])
    assert [tuple(r) for r in cut] == [tuple(r) for r in whole] and len(whole) == 12


def test_late_rows_leave_the_track_alone(spark, tmp_path):
    rows = walk(12)
    late = (0, 1, 0.1, 99, sorted(FLAT)[0], 9999.0)
    whole = drained(spark, tmp_path / "a", [rows[:24], rows[24:]])
    got = drained(spark, tmp_path / "b", [rows[:24], [late], rows[24:]])
    assert [tuple(r)[:-1] for r in got] == [tuple(r)[:-1] for r in whole]
    assert got[-1].late == 1 and whole[-1].late == 0
