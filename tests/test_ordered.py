"""Chunked ordered operators against plain loops, for several chunk widths."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tagtrack.operators import align, quality, scan, smooth

KEYS = ["run_id", "tag_id"]


def table(n=400, tags=3, missing=0.2, gaps=0.02, seed=5):
    rnd = random.Random(seed)
    rows = []
    for tag in range(tags):
        t = 0.0
        for i in range(n):
            t += rnd.choice([0.016, 0.02, 0.05]) if rnd.random() > gaps else rnd.uniform(1, 400)
            v = None if rnd.random() < missing else rnd.uniform(100, 900)
            u = None if rnd.random() < missing else rnd.uniform(-50, 50)
            rows.append((0, tag, round(t, 6), v, u))
    return rows


@pytest.fixture(scope="module")
def rows():
    return table()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "run_id long, tag_id long, t double, v double, u double").cache()


def by_tag(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)
    return out


@pytest.mark.parametrize("width", [0.03, 1.0, 60.0, 1e6])
def test_previous_next_running(frame, rows, width):
    df = scan.with_chunk(frame.withColumn("_t", F.col("t")), "t", width)
    prev = {(r.tag_id, r.t): (r.prev_v, r.prev__t) for r in scan.with_previous(df, KEYS, "t", ["v", "_t"]).collect()}
    nxt = {(r.tag_id, r.t): r.next_v for r in scan.with_next(df, KEYS, "t", ["v"]).collect()}
    run = {
        (r.tag_id, r.t): r
        for r in scan.running(
            df, KEYS, ["t"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "n": ("count", F.col("v")), "lo": ("min", F.col("v"))}
        ).collect()
    }
    idx = {(r.tag_id, r.t): r.seq for r in scan.with_index(df, KEYS, ["t"]).collect()}
    for tag, track in by_tag(rows).items():
        seen = []
        for i, r in enumerate(track):
            key = (tag, r[2])
            assert prev[key] == ((track[i - 1][3], track[i - 1][2]) if i else (None, None))
            assert nxt[key] == (track[i + 1][3] if i + 1 < len(track) else None)
            assert idx[key] == i + 1
            if r[3] is not None:
                seen.append(r[3])
            got = run[key]
            assert got.n == len(seen)
            assert got.m == (max(seen) if seen else None) and got.lo == (min(seen) if seen else None)
            assert got.s == pytest.approx(sum(seen)) if seen else got.s is None


@pytest.mark.parametrize("alpha,width", [(0.12, 60.0), (0.12, 0.03), (0.95, 2.7), (0.95, 0.5), (0.01, 60.0), (0.5, 10.0)])
def test_smoothing_equals_the_recurrence(frame, rows, alpha, width):
    assert width <= smooth.chunk_width(alpha)
    df = scan.with_chunk(frame, "t", width)
    out = smooth.smooth(df, KEYS, {"v": "sv", "u": "su"}, alpha, dt=None).collect()
    got = {(r.tag_id, r.t): r for r in out}
    assert len(got) == len(rows)
    for tag, track in by_tag(rows).items():
        state = [None, None]
        for i, r in enumerate(track):
            dt = r[2] - track[i - 1][2] if i else 0.0
            a = alpha if dt <= 0 else 1 - (1 - alpha) ** (dt * 60)
            for j in (0, 1):
                x = r[3 + j]
                if x is not None:
                    state[j] = x if state[j] is None else a * x + (1 - a) * state[j]
            g = got[(tag, r[2])]
            for want, have in zip(state, (g.sv, g.su)):
                if want is None:
                    assert have is None
                else:
                    assert have == pytest.approx(want, abs=1e-8)
            assert g.dt == (pytest.approx(dt) if i else None)


def test_smoothing_with_given_durations(spark):
    rows = [(0, 0, float(i), float(i % 7), 1 / 60) for i in range(50)]
    df = scan.with_chunk(spark.createDataFrame(rows, "run_id long, tag_id long, t double, v double, dt double"), "t", 5.0)
    out = smooth.smooth(df, KEYS, {"v": "s"}, 0.3).orderBy("t").collect()
    s = None
    for r in out:
        s = r.v if s is None else 0.3 * r.v + 0.7 * s
        assert r.s == pytest.approx(s, abs=1e-9)


def arrivals(n=300, seed=3):
    rnd = random.Random(seed)
    rows, t = [], 0.0
    for i in range(n):
        t += rnd.choice([0.05, 0.3, 2.0, 2.5]) if rnd.random() < 0.3 else 0.02
        rows.append((0, 1, round(t, 3), i, rnd.randint(1, 3), float(i)))
    return rows


@pytest.mark.parametrize("width", [0.7, 60.0])
def test_hold_on_a_clock(spark, width):
    rows = arrivals()
    r = spark.createDataFrame(rows, "run_id long, tag_id long, t double, arrival long, anchor_id int, distance_cm double")
    grid = align.tick_grid(r, 10.0, 2.0, width=width)
    got = align.hold(r, grid, [1, 2, 3], 2.0, width=width).orderBy("t").collect()
    first, last = rows[0][2], rows[-1][2]
    assert [g.tick for g in got] == list(range(math.ceil(first * 10), math.floor((last + 2.0) * 10) + 1))
    for g in got:
        for a in (1, 2, 3):
            past = [x for x in rows if x[4] == a and x[2] <= g.t]
            want = past[-1][5] if past and g.t - past[-1][2] <= 2.0 else None
            assert g[f"d{a}"] == want


@pytest.mark.parametrize("width", [0.7, 60.0])
def test_hold_on_arrivals_is_inclusive(spark, width):
    rows = [(0, 1, 0.0, 0, 1, 10.0), (0, 1, 2.0, 1, 2, 20.0), (0, 1, 2.5, 2, 2, 21.0)]
    r = spark.createDataFrame(rows, "run_id long, tag_id long, t double, arrival long, anchor_id int, distance_cm double")
    got = align.hold_events(align.event_ticks(r, [1, 2], width=width), [1, 2], 2.0, width=width).orderBy("t").collect()
    assert [(g.d1, g.d2, g.f1, g.f2) for g in got] == [
        (10.0, None, 10.0, None), (10.0, 20.0, None, 20.0), (None, 21.0, None, 21.0)
    ]


def test_repeats_within_a_stamp_keep_the_last_arrival(spark):
    rows = [(0, 1, 1.0, 5, 1, 10.0), (0, 1, 1.0, 7, 1, 30.0), (0, 1, 1.0, 6, 1, 20.0)]
    r = spark.createDataFrame(rows, "run_id long, tag_id long, t double, arrival long, anchor_id int, distance_cm double")
    assert align.event_ticks(r, [1]).first().d1 == 30.0
    assert align.latest_per_anchor(r).first().distance_cm == 30.0


def test_packets_and_runs(spark):
    rows = [(0, 1, 1.0, 1, 1, 10.0), (0, 1, 1.0, 2, 2, 20.0), (0, 1, 2.0, 3, 2, 21.0)]
    r = spark.createDataFrame(rows, "run_id long, tag_id long, t double, arrival long, anchor_id int, distance_cm double")
    got = align.packets(align.event_ticks(r, [1, 2]), [1, 2]).orderBy("t").collect()
    assert got[0].raw == {1: 10.0, 2: 20.0} and got[0].valid and got[0].status.endswith("ancres recues: 1, 2")
    assert got[1].raw == {2: 21.0} and not got[1].valid
    marks = spark.createDataFrame([(1, float(i), i in (2, 5)) for i in range(8)], "tag_id long, t double, reset boolean")
    runs = align.with_run(scan.with_chunk(marks, "t", 3.0), ["tag_id"], ["t"], F.col("reset")).orderBy("t").collect()
    assert [x.run_id for x in runs] == [0, 0, 1, 1, 1, 2, 2, 2]


@pytest.mark.parametrize("chunk_s", [0.5, 3600.0])
def test_session_spans_cross_chunks(spark, chunk_s):
    stamps = [0, 400, 1900, 3401, 3402, 9000, 10500, 12000]
    df = spark.createDataFrame([(1, s) for s in stamps], "tag_id long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    out = quality.session_spans(df, "ts", 1500, chunk_s=chunk_s)
    got = out.select(F.unix_millis("start").alias("a"), F.unix_millis("end").alias("b"), "n").orderBy("a").collect()
    # a gap of exactly the limit does not end a span
    assert [tuple(r) for r in got] == [(0, 3400, 3), (3401, 4902, 2), (9000, 13500, 3)]
