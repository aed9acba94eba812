"""Board clocks on one base: restarts, drift, late lines, batch and stream."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagtrack.operators import clock, ingest, quality
from tagtrack.sources import messages as M
from tagtrack.streaming import boardclock, repeats

LINES = "run_id long, tag_id long, session string, src string, us long, arrival long, ms long, cb long, true_us long"


def board(rng, tag, src, drift, spans, step_ms=500, jitter_ms=40, begin_us=10**12):
    """Lines of a board over its boots (start in s, length in s), in order of arrival."""
    rows = []
    for start, length in spans:
        for k in range(int(length * 1000 / step_ms)):
            true = begin_us + start * 10**6 + k * step_ms * 1000
            ms = int((true - begin_us - start * 10**6) / 1000 / (1 + drift)) + 7
            rows.append([0, tag, "0x1001", src, true + rng.randrange(jitter_ms * 1000), 0, ms, k, true])
    rows.sort(key=lambda r: r[4])
    for i, r in enumerate(rows):
        r[5] = i
    return rows


def fixture(jitter_ms=40):
    rng = random.Random(4)
    rows = board(rng, 1, "a", 80e-6, [(0, 1500)], jitter_ms=jitter_ms)
    rows += board(rng, 1, "b", -120e-6, [(100, 700), (805, 400), (1210, 30)], jitter_ms=jitter_ms)
    rows += board(rng, 2, "a", 0.0, [(0, 4)], jitter_ms=jitter_ms)
    return rows


def test_envelope_is_the_best_line_below():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = rng.uniform(0, 100, 12), rng.uniform(0, 5, 12)
        height, slope = clock.envelope(x, y, 10.0)
        assert (y - height - slope * x).min() >= -1e-9
        best = min((y - y[i] - (y[j] - y[i]) / (x[j] - x[i]) * (x - x[i])).sum()
                   for i in range(12) for j in range(12)
                   if x[i] < x[j] and (y - y[i] - (y[j] - y[i]) / (x[j] - x[i]) * (x - x[i])).min() >= -1e-9)
        assert (y - height - slope * x).sum() == pytest.approx(best)
    assert clock.envelope(np.array([5.0]), np.array([3.0])) == (3.0, 0.0)


def test_restarts_and_drift_give_times_that_never_run_back(spark):
    df = spark.createDataFrame(fixture(), LINES)
    got = clock.with_device_time(df).collect()
    assert len(got) == df.count()
    by_board = {}
    for r in got:
        by_board.setdefault((r.tag_id, r.src), []).append(r)
        assert abs(r.device_us - r.true_us) <= 45_000
    assert {k: max(r.boot for r in v) for k, v in by_board.items()} == {(1, "a"): 0, (1, "b"): 2, (2, "a"): 0}
    for rows in by_board.values():
        rows.sort(key=lambda r: (r.boot, r.ms))
        assert all(a.device_us <= b.device_us for a, b in zip(rows, rows[1:]))


def test_drift_is_taken_out(spark):
    """With most lines delayed the error stays far below what 120 ppm of drift would make."""
    df = spark.createDataFrame(fixture(400), LINES)
    late = [abs(r.device_us - r.true_us) for r in clock.with_device_time(df).where("tag_id = 1 AND boot = 0").collect()]
    assert max(late) < 30_000


def test_a_late_line_is_no_restart(spark):
    rows = board(random.Random(2), 1, "a", 0.0, [(0, 60)])
    rows[50][4] += 1_500_000  # arrives behind three later ones
    got = clock.with_device_time(spark.createDataFrame(rows, LINES)).collect()
    assert {r.boot for r in got} == {0} and max(abs(r.device_us - r.true_us) for r in got) <= 45_000


def test_ranges_on_the_device_clock_keep_their_order(spark):
    """The newest range is the newest after a restart, and other messages are told apart."""
    text = "UWB,session=0x1001,src=a,dst=d,cb={},status=0,lastDist=5,d1={},ms={}"
    sent = [(100.0, text.format(90, 1, 90_000)), (100.1, text.format(91, 2, 90_100)), (103.2, text.format(0, 3, 200)), (104.0, "A1=9")]
    df = spark.createDataFrame([(1, t, m) for t, m in sent], "tag_id long, s double, message string")
    df = df.withColumn("ingest_ts", F.timestamp_micros((F.col("s") * 1e6).cast("long"))).drop("s")
    kept, rest = ingest.ranges_of(df, "session", "clock")
    got = sorted((r.t, r.distance_cm) for r in kept.collect())
    assert [d for _, d in got] == [1.0, 2.0, 3.0] and got[0][0] == pytest.approx(100.0) and got[2][0] == pytest.approx(103.2)
    assert [(r.message, r.reason) for r in rest.collect()] == [("A1=9", "no time")]


def arriving(spark, rows, schema, path, cuts, name="us"):
    """Files in order of arrival, one a batch, and a last line that releases what boards hold."""
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(path)
    live = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    return live.withColumn("ts", F.timestamp_micros(name))


def drained(stream, tmp_path):
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
    writer.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(str(tmp_path / "out")).collect()


@pytest.mark.parametrize("cuts", [[], [400, 401, 900], [1, 7, 2000, 3000, 3500]])
def test_streamed_times_never_run_back_at_any_cut(spark, tmp_path, cuts):
    rows = sorted(fixture(), key=lambda r: r[4]) + [[0, 9, "s", "end", 4 * 10**15, 0, 0, 0, 0]]
    live = arriving(spark, rows, LINES, str(tmp_path / "in"), cuts).drop("us", "arrival")
    got = [r for r in drained(boardclock.device_time(live, "ts"), tmp_path) if r.src != "end"]
    assert len(got) == len(rows) - 1 and not any(r.late for r in got)
    boards = {}
    for r in got:
        assert abs(r.device_us - r.true_us) <= 45_000
        boards.setdefault((r.tag_id, r.src), []).append(r)
    assert {k: max(r.boot for r in v) for k, v in boards.items()} == {(1, "a"): 0, (1, "b"): 2, (2, "a"): 0}
    for rows in boards.values():
        rows.sort(key=lambda r: (r.boot, r.ms))
        assert all(a.device_us <= b.device_us for a, b in zip(rows, rows[1:]))


REPEATS = "tag_id long, session string, src string, cb long, arrival long, us long, d1 int"


@pytest.mark.parametrize("cuts", [[], [30, 31, 32, 100], list(range(10, 380, 37))])
def test_lines_up_to_two_seconds_late_give_the_batch_result(spark, tmp_path, cuts):
    rng = random.Random(8)
    sent = []
    for tag in (1, 2):
        cb = 0
        for k in range(200):
            cb = 0 if k in (60, 61, 140) else cb + rng.choice([0, 0, 1])
            sent.append((tag, "s", "a", cb, k, 10**12 + k * 130_000 + tag, None if k % 3 else k))
    shuffled = sorted(sent, key=lambda r: r[5] + rng.randrange(1_999_000)) + [(9, "s", "end", 0, 0, 4 * 10**15, None)]
    live = arriving(spark, shuffled, REPEATS, str(tmp_path / "in"), cuts).drop("us")
    got = [r for r in drained(repeats.first_of_repeats(live, "ts"), tmp_path) if r.src != "end"]
    assert not any(r.late for r in got)
    batch = spark.createDataFrame(sent, REPEATS).withColumn("ts", F.timestamp_micros("us"))
    want = quality.first_of_repeats(batch, "ts").collect()
    key = lambda r: (r.tag_id, r.cb, r.arrival, r.d1 is None, r.d1 or 0)
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(want) > 100


def test_later_lines_are_told_apart(spark, tmp_path):
    sent = [(1, "s", "a", k, k, 10**12 + k * 1_000_000, k) for k in range(10)]
    came = [r for r in sent if r[3] != 3] + [sent[3], (9, "s", "end", 0, 0, 4 * 10**15, 0)]
    live = arriving(spark, came, REPEATS, str(tmp_path / "in"), [7, 9]).drop("us")
    got = [r for r in drained(repeats.first_of_repeats(live, "ts"), tmp_path) if r.src != "end"]
    assert [r.cb for r in got if r.late] == [3] and sorted(r.cb for r in got if not r.late) == [0, 1, 2, 4, 5, 6, 7, 8, 9]


def test_arrival_follows_paths_and_places(spark, tmp_path):
    """Whatever the sizes of files and of the pieces they are read in, and the same on a second read."""
    want = []
    for name, n in (("day=1", 2), ("day=2", 3000), ("day=3", 1), ("day=4", 700)):
        lines = [f"A1={name[-1]}.{i}" for i in range(n)]
        want += lines
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("20k", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = M.read_messages(spark, str(tmp_path), "text", numbered=True)
            assert [r.message for r in sorted(rows.select("arrival", "message").collect())] == want
            some = rows.where("message LIKE '%7'").collect()
            assert len(some) > 300 and all(want[r.arrival] == r.message for r in some)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_line_feed_in_a_quoted_text_stays_inside(spark, tmp_path):
    df = spark.createDataFrame([("A1=5\nA2=6", 3), ("x", 4)], "message string, tag_id long").withColumn("ingest_ts", F.timestamp_micros(F.lit(10**12)))
    columns = ["ingest_ts", F.lit("a").alias("source_ip"), F.lit(1).alias("source_port"), "message", "tag_id"]
    df.select(*columns).write.option("header", True).option("escape", '"').csv(str(tmp_path / "m"))
    got = M.read_messages(spark, str(tmp_path / "m"), "csv", extra="tag_id long", numbered=True).collect()
    assert sorted((r.message, r.tag_id) for r in got) == [("A1=5\nA2=6", 3), ("x", 4)] and len({r.arrival for r in got}) == 2
