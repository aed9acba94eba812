"""Motion, heatmap, accuracy, zones and quality on small tables with known results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tagtrack import constants as K
from tagtrack.functions import geometry as G
from tagtrack.operators import accuracy, heatmap, motion, quality, scan, zones

KEYS = ["run_id", "tag_id"]
POS = "run_id long, tag_id long, t double, dt double, x double, y double, jump double"


def pos(spark, rows, width=60.0):
    return scan.with_chunk(spark.createDataFrame([(0, 1, *r) for r in rows], POS), "t", width)


@pytest.mark.parametrize("width", [0.1, 60.0])
def test_card(spark, width):
    rows = [
        (0.1, 0.1, 0.0, 0.0, 0.0), (0.2, 0.1, 30.0, 40.0, 12.0), (0.3, 0.1, 30.0, 40.0, 13.0), (0.4, 0.0, 60.0, 80.0, None),
        (0.5, 0.1, 60.0, 80.0, 20.0), (0.6, 0.1, None, None, 99.0), (0.7, 0.1, 60.0, 90.0, 0.0),
    ]
    c = motion.player_card(pos(spark, rows, width), jump="jump").first()
    # the step without duration adds nothing; the tick without a position is not a sample
    assert (c.samples, c.time_s, c.jump_count, c.max_jump_cm) == (6, 0.7, 2, 20.0)
    assert c.distance_m == pytest.approx(0.6)
    assert c.max_speed_kmh == pytest.approx(500 * 0.036)
    assert c.avg_speed_kmh == pytest.approx(60 / 0.7 * 0.036)
    assert c.speed_sum_cm_s == pytest.approx(500 + 0 + 0 + 100)
    flat = motion.player_card(pos(spark, rows, width)).first()
    assert flat.jump_count is None and flat.max_jump_cm is None
    peaks = motion.running_peaks(pos(spark, rows, width), jump="jump").orderBy("t").collect()
    assert [p.max_jump_so_far for p in peaks] == [0.0, 12.0, 13.0, 13.0, 20.0, 20.0]


def test_trail_over_chunks(spark):
    rows = [(i / 10, 0.1, float(i), 0.0, None) for i in range(500)]
    for width in (0.7, 60.0):
        got = motion.trail(pos(spark, rows, width), 220).orderBy("rank").collect()
        assert [g.x for g in got] == [float(i) for i in range(499, 279, -1)]


def test_heat(spark):
    edge = [(-150.0, 150.0), (2650.0, 1650.0), (2650.1, 900.0), (1250.0, 900.0), (1250.0, 900.0)]
    rows = [(float(i), 1.0, x, y, None) for i, (x, y) in enumerate(edge)]
    grid = heatmap.heat(pos(spark, rows))
    cells = {(r.row, r.col): r.hits for r in grid.collect()}
    assert cells == {(0, 0): 1, (59, 111): 1, (30, 56): 2}
    s = heatmap.heat_summary(grid).first()
    assert (s.version, s.max_hits) == (4, 2)
    dense = {(r.row, r.col): r.value for r in heatmap.smooth_heat(grid, dense=True).collect()}
    assert len(dense) == K.HEAT_ROWS * K.HEAT_COLS
    for row, col in [(0, 0), (0, 1), (30, 56), (31, 58), (59, 111), (10, 10), (58, 109)]:
        total = weight = 0.0
        for dy in range(-3, 4):
            for dx in range(-3, 4):
                if 0 <= row + dy < 60 and 0 <= col + dx < 112:
                    w = 1 / (1 + dx * dx + dy * dy)
                    weight += w
                    total += w * cells.get((row + dy, col + dx), 0)
        assert dense[(row, col)] == pytest.approx(total / weight)
    assert heatmap.heat(pos(spark, rows), until=3.0).agg(F.sum("hits")).first()[0] == 3


def test_constant_grid_stays_constant(spark):
    cells = [(0, 1, r, c, 4) for r in range(60) for c in range(112)]
    grid = spark.createDataFrame(cells, "run_id long, tag_id long, row int, col int, hits long")
    lo, hi = heatmap.smooth_heat(grid).agg(F.min("value"), F.max("value")).first()
    assert (lo, hi) == (pytest.approx(4.0), pytest.approx(4.0))


def test_colours(spark):
    df = spark.createDataFrame([(0.0, 10.0), (5.0, 10.0), (10.0, 10.0), (7.5, 10.0), (1.0, 0.0)], "v double, m double")
    got = [tuple(r.c) for r in df.select(G.heat_rgba(F.col("v"), F.col("m")).alias("c")).collect()]
    assert got == [(40, 225, 30.0, 56), (255, 170, 30.0, 111), (255, 0, 0.0, 166), (255, 85, 15.0, 138), (40, 225, 30.0, 56)]


def test_missing_stays_missing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    v = F.col("v")
    row = df.select(
        G.clamp(v, 0.0, 1.0).alias("a"), G.ground_distance(v).alias("b"), G.jump_height(v).alias("c"),
        G.precision_percent(v, 90.0).alias("d"), G.court_zone(v, v).alias("e"),
    ).first()
    assert list(row) == [None] * 5


def test_filter_terms(spark):
    df = spark.createDataFrame([(1 / 60,), (0.0,), (0.05,)], "dt double")
    got = df.select(G.alpha_for_dt(0.12, F.col("dt")).alias("a"), G.filter_delay(0.12, F.col("dt")).alias("d")).collect()
    assert got[0].a == pytest.approx(0.12) and got[1].a == 0.12 and got[2].a == pytest.approx(1 - 0.88**3)
    assert got[0].d == pytest.approx(-1 / 60 / math.log(0.88)) and got[1].d == 0.0
    assert df.select(G.filter_delay(0.0, F.col("dt")).alias("d")).first().d == 0.0


def test_zones(spark):
    spots = {
        (7.5, 900.0): "restricted", (300.0, 900.0): "paint", (480.0, 900.0): "free_throw", (1250.0, 900.0): "centre_circle",
        (600.0, 1000.0): "two_point", (0.0, 200.0): "three_point", (1000.0, 300.0): "three_point", (-151.0, 900.0): "out",
        (2492.5, 900.0): "restricted", (0.0, 300.0): "two_point",
    }
    df = spark.createDataFrame([(x, y) for x, y in spots], "x double, y double")
    got = {(r.x, r.y): r.zone for r in zones.with_zone(df).collect()}
    assert got == spots


def history(n=200, seed=2):
    rnd = random.Random(seed)
    t, out = 0.0, []
    for i in range(n):
        t += rnd.choice([0.02, 0.05, 0.4])
        out.append((round(t, 3), 100 * math.sin(i / 9), 100 * math.cos(i / 7), float(i % 11)))
    return out


@pytest.mark.parametrize("width", [0.5, 60.0])
def test_truth_at_and_best_delay(spark, width):
    hist, rnd = history(), random.Random(4)
    truth = spark.createDataFrame([(0, 1, *h) for h in hist], "run_id long, tag_id long, t double, x double, y double, z double")
    aims = [(0, 1, h[0], h[0] - rnd.choice([0.0, 0.013, 0.3, 1.7, 40.0])) for h in hist]
    targets = spark.createDataFrame(aims, "run_id long, tag_id long, t double, at double")
    got = {r.t: (r.at_x, r.at_y, r.at_z) for r in accuracy.truth_at(targets, truth, "at", history=30, width=width).collect()}
    assert len(got) == len(hist)
    for k, (_, _, now, at) in enumerate(aims):
        known = hist[max(0, k - 29) : k + 1]
        later = [j for j in range(len(known) - 1) if known[j][0] <= at <= known[j + 1][0]]
        if later:
            a, b = known[later[0]], known[later[0] + 1]
            u = (at - a[0]) / (b[0] - a[0])
            want = tuple(p + (q - p) * u for p, q in zip(a[1:], b[1:]))
        else:
            want = min(known, key=lambda h: abs(h[0] - at))[1:]
        assert got[now] == pytest.approx(want, abs=1e-9)
    est = [None if i % 13 == 5 else (h[1] + rnd.uniform(-40, 40), h[2] + rnd.uniform(-40, 40), h[3]) for i, h in enumerate(hist)]
    rows = [(0, 1, h[0], *(e or (None,) * 3), *h[1:]) for h, e in zip(hist, est)]
    cols = "run_id long, tag_id long, t double, x double, y double, z double, true_x double, true_y double, true_z double"
    out = {r.t: r for r in accuracy.best_delay(spark.createDataFrame(rows, cols), history=20, width=width).collect()}
    for k, (h, e) in enumerate(zip(hist, est)):
        best = None
        for s in reversed(hist[max(0, k - 19) : k + 1]):
            if e is None or k < 1 or h[0] - s[0] > 1.2:
                continue
            err = math.dist(s[1:], e)
            if best is None or err < best[1]:
                best = (h[0] - s[0], err)
        r = out[h[0]]
        assert (r.measured_delay, r.delay_err) == (pytest.approx(best) if best else (None, None))


def test_quality(spark):
    tel = spark.createDataFrame(
        [("a", 5, "2024-01-01 00:00:00.1"), ("a", 9, "2024-01-01 00:00:00.9"), ("a", 1, "2024-01-01 00:00:01.5"),
         ("b", 9, "2024-01-01 00:00:00.1"), ("b", 2, "2024-01-01 00:00:00.2")], "session string, cb long, ts string",
    ).withColumn("ingest_ts", F.col("ts").cast("timestamp"))
    rows = quality.response_rate(tel, keys=["session"]).collect()
    rate = {(r.session, r.window_start.second): (r.rate, r.restarts) for r in rows}
    assert rate == {("a", 0): (0.4, 0), ("a", 1): (0.1, 1), ("b", 0): (0.2, 1)}
    stale = {r.session: (r.age_ms, r.stale) for r in quality.stale_anchors(tel, F.lit("2024-01-01 00:00:03").cast("timestamp")).collect()}
    assert stale == {"a": (1500.0, False), "b": (2800.0, True)}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100])
def test_interval_of(spark, n):
    times = [i * 0.5 for i in range(n)]
    rows = spark.range(-3, 250).select((F.col("id") / 4).alias("t")).withColumn("i", heatmap.interval_of(F.col("t"), times))
    for r in rows.collect():
        assert r.i == sum(x < r.t for x in times)


def test_heat_snapshots(spark):
    rnd = random.Random(11)
    rows = [(tag, rnd.uniform(0, 30), rnd.choice([10.0, 700.0, 9000.0, 1300.0]), rnd.choice([400.0, 800.0])) for tag in (1, 2) for _ in range(300)]
    rows += [(1, 5.0, 10.0, 400.0)] * 4 + [(3, 29.0, 10.0, 400.0), (4, 3.0, 9000.0, 400.0), (5, None, 10.0, 400.0), (6, 1.0, None, 400.0)]
    df = spark.createDataFrame([(0, *r) for r in rows], "run_id long, tag_id long, t double, x double, y double")
    times = [20.0, 5.0, -1.0, 5.0, None, 25.5, float("nan")]
    got = heatmap.heat_snapshots(df, times)
    assert got.columns == ["run_id", "tag_id", "snapshot_id", "heat_version", "row", "col", "hits"]
    seen = {}
    for r in got.collect():
        seen.setdefault((r.tag_id, r.snapshot_id), []).append((r.row, r.col, r.hits, r.heat_version))
    for i, at in enumerate(times):
        if at is None or at != at:
            assert not [k for k in seen if k[1] == i]
            continue
        grid = heatmap.heat(df, until=at).collect()
        for tag in range(1, 7):
            cells = sorted((r.row, r.col, r.hits) for r in grid if r.tag_id == tag)
            version = sum(c[2] for c in cells)
            assert sorted(seen.pop((tag, i), [])) == [(*c, version) for c in cells]
    assert not seen
    assert heatmap.heat_snapshots(df, []).count() == heatmap.heat_snapshots(df.limit(0), times).count() == 0
    plan = heatmap.heat_snapshots(df, [float(i) for i in range(100)])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 2


def test_truth_between_stamps_remembers_what_the_tick_has_seen(spark):
    kind = "run_id long, tag_id long, t double"
    truth = spark.createDataFrame([(0, 1, float(i), 10.0 * i, 0.0, 0.0) for i in range(9)], kind + ", x double, y double, z double")
    aims = [(5.0, 2.5), (5.5, 2.5), (5.5, 4.25), (5.5, 5.25), (0.0, -3.0), (0.5, 0.25), (-1.0, -1.0), (100.0, 7.5), (100.0, 50.0)]
    targets = spark.createDataFrame([(0, 1, *a) for a in aims], kind + ", at double")
    got = {(r.t, r.at): r.at_x for r in accuracy.truth_at(targets, truth, "at", history=2, width=2.0).collect()}
    assert got == {(5.0, 2.5): 40.0, (5.5, 2.5): 40.0, (5.5, 4.25): 42.5, (5.5, 5.25): 50.0, (0.0, -3.0): 0.0, (0.5, 0.25): 0.0,
                   (-1.0, -1.0): None, (100.0, 7.5): 75.0, (100.0, 50.0): 80.0}


def test_memory_over_parts_of_the_truth(spark):
    """Truth at 1 kHz over several parts: the oldest remembered sample and the next one across their borders."""
    n, history = 10_000, 600
    truth = spark.range(n).selectExpr("0L AS run_id", "1L AS tag_id", "id / 1000D AS t", "cast(id AS double) AS x", "0D AS y", "0D AS z")
    got = {round(r.t * 1000): r for r in accuracy.remembered(truth, history=history, width=1.0).collect()}
    assert len(got) == n
    for i, r in got.items():
        assert r.oldest.x == max(0, i - history + 1) and (r.next.x if r.next else None) == (i + 1 if i + 1 < n else None)


def test_best_delay_in_small_batches(spark):
    """The window passes batch borders, keys and lent rows; against the sum over all pairs."""
    rnd, rows = random.Random(8), []
    for tag in (1, 2, 3):
        t = rnd.uniform(0, 2)
        for i in range(400):
            t += rnd.choice([0.001, 0.02, 0.3])
            x = rnd.uniform(0, 50) if i % 7 else None
            rows.append((0, tag, round(t, 4), x, x, x, *([float(i), 1.0, 2.0] if i % 5 else [None] * 3), {"k": i}))
    kind = "run_id long, tag_id long, t double, x double, y double, z double, true_x double, true_y double, true_z double, m map<string,int>"
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {(r.tag_id, r.t): r for r in accuracy.best_delay(spark.createDataFrame(rows, kind), history=25, width=3.0).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == len(rows)
    for tag in (1, 2, 3):
        mine = [r for r in rows if r[1] == tag]
        for k, r in enumerate(mine):
            known = [s for s in mine[: k + 1] if s[6] is not None][-25:]
            best = min(((math.dist(s[6:9], r[3:6]), -s[2], r[2] - s[2]) for s in known if r[2] - s[2] <= 1.2), default=None) if r[3] is not None else None
            want = (pytest.approx(best[2]), pytest.approx(best[0])) if best and sum(s[6] is not None for s in mine[: k + 1]) >= 2 else (None, None)
            found = got[tag, r[2]]
            assert (found.measured_delay, found.delay_err) == want and found.m == r[9]
