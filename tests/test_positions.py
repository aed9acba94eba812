"""Solvers and positioning jobs against independent scalar code."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagtrack import constants as K
from tagtrack.operators import align, scan, solve2d, solve3d
from tagtrack.plans import locate
from tagtrack.plans.barrier import shared_checkpoint
from tagtrack.sources import settings as S

FLAT = {a: xy for a, xy in K.LAYOUTS_2D[4][1].items()}
RANGES = "run_id long, tag_id long, t double, arrival long, anchor_id int, distance_cm double"


def planar(layout, dist):
    """Least squares on the linearised circle equations with numpy."""
    ids = sorted(layout)
    if len(ids) < 3 or any(dist.get(a) is None for a in ids):
        return None
    x0, y0 = layout[ids[0]]
    a = np.array([[2 * (layout[i][0] - x0), 2 * (layout[i][1] - y0)] for i in ids[1:]])
    b = np.array(
        [dist[ids[0]] ** 2 - dist[i] ** 2 - x0**2 + layout[i][0] ** 2 - y0**2 + layout[i][1] ** 2 for i in ids[1:]]
    )
    return np.linalg.lstsq(a, b, rcond=None)[0]


@pytest.mark.parametrize("n", [3, 4, 5, 6])
def test_exact_ranges_give_the_exact_point(spark, n):
    layout = K.LAYOUTS_2D[n][1]
    pts = [(300.0, 400.0), (1250.0, 900.0), (2600.0, 160.0)]
    rows = [(i, *[math.dist(p, layout[a]) for a in sorted(layout)]) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"d{a} double" for a in sorted(layout)))
    x, y = solve2d.position(layout)
    for r in df.select("i", x.alias("x"), y.alias("y")).collect():
        assert (r.x, r.y) == pytest.approx(pts[r.i], abs=1e-6)


def test_translation_moves_the_estimate():
    moved = {a: (x + 500, y - 300) for a, (x, y) in FLAT.items()}
    d = {1: 1800.0, 2: 1900.0, 3: 1700.0, 4: 1650.0}

    def at(layout):
        w, c = solve2d.layout_weights(layout)
        return [c[k] + sum(w[a][k] * d[a] ** 2 for a in d) for k in (0, 1)]

    p, q = at(FLAT), at(moved)
    assert (q[0] - p[0], q[1] - p[1]) == pytest.approx((500, -300), abs=1e-6)


def test_no_unique_solution():
    assert solve2d.layout_weights({1: (0, 0), 2: (1, 1), 3: (2, 2)}) is None
    assert solve2d.layout_weights({1: (0, 0), 2: (1, 1)}) is None


def test_weight_table_equals_the_driver_weights(spark):
    got = {(r.layout_id, r.anchor_id): r for r in solve2d.weight_table(S.anchor_table(spark, "2d")).collect()}
    assert {k[0] for k in got} == {3, 4, 5, 6}
    for n in (3, 4, 5, 6):
        w, c = solve2d.layout_weights(K.LAYOUTS_2D[n][1])
        for a, (wx, wy) in w.items():
            r = got[(n, a)]
            assert (r.wx, r.wy, r.cx, r.cy) == pytest.approx((wx, wy, *c), rel=1e-9)


def test_circles(spark):
    layout = {1: (0.0, 0.0), 2: (10.0, 0.0)}
    rows = [(0, 6.0, 8.0), (1, 5.0, 5.0), (2, 1.0, 2.0), (3, 20.0, 3.0), (4, None, 4.0)]
    df = spark.createDataFrame(rows, "i int, d1 double, d2 double")
    got = {r.i: [tuple(p) for p in r.p] for r in df.select("i", solve2d.pair_points(layout).alias("p")).collect()}
    assert got[0][0] == pytest.approx((3.6, 4.8)) and got[0][1] == pytest.approx((3.6, -4.8))
    assert got[1][0] == pytest.approx((5, 0)) and got[1][1] == pytest.approx((5, 0))
    assert got[2] == [] and got[3] == [] and got[4] == []


def walk(n=120, seed=11, slant=False, drop=0.1):
    rnd = random.Random(seed)
    rows, truth, t, arrival = [], [], 0.0, 0
    for i in range(n):
        t = round(t + (0.05 if rnd.random() > 0.03 else 3.0), 6)
        p = (1250 + 600 * math.sin(i / 30), 900 + 400 * math.cos(i / 25), 95.0 + (50.0 if i % 40 < 5 else 0.0))
        truth.append((0, 1, t, *p))
        for a, spot in K.LAYOUTS_3D[4][1].items():
            if rnd.random() < drop:
                continue
            d = math.dist(p, spot) if slant else math.dist(p[:2], spot[:2])
            rows.append((0, 1, t, arrival, a, d + rnd.uniform(-20, 20)))
            arrival += 1
    return rows, truth


@pytest.mark.parametrize("mode", ["event", "frame"])
def test_locate_2d_equals_a_tick_loop(spark, mode):
    rows, truth = walk()
    r = spark.createDataFrame(rows, RANGES)
    tr = spark.createDataFrame(truth, "run_id long, tag_id long, t double, x double, y double, z double")
    got = locate.locate_2d(r, FLAT, truth=tr if mode == "event" else None, mode=mode, hz=20.0).orderBy("t").collect()
    if mode == "event":
        clock = sorted({x[2] for x in rows})
    else:
        lo, hi = rows[0][2], rows[-1][2]
        clock = [k / 20 for k in range(math.ceil(lo * 20), math.floor((hi + 2.0) * 20) + 1)]
    assert [g.t for g in got] == clock
    ema, pos, last_t, errs = {}, None, None, []
    real = {x[2]: x[3:5] for x in truth}
    for g in got:
        fresh, new = {}, {}
        for a in FLAT:
            past = [x for x in rows if x[4] == a and x[2] <= g.t]
            if past and g.t - past[-1][2] <= 2.0:
                fresh[a] = past[-1][5]
                if mode == "frame" or past[-1][2] == g.t:
                    new[a] = past[-1][5]
        dt = 1 / 20 if mode == "frame" else (g.t - last_t if last_t is not None else 0.0)
        last_t = g.t
        ad, ap = (al if dt <= 0 else 1 - (1 - al) ** (dt * 60) for al in (0.12, 0.10))
        for a, v in new.items():
            ema[a] = v if a not in ema else ad * v + (1 - ad) * ema[a]
        raw, fine = planar(FLAT, fresh), planar(FLAT, ema)
        if fine is not None:
            pos = fine if pos is None else ap * fine + (1 - ap) * pos
        for want, have in ((raw, (g.x_raw, g.y_raw)), (pos, (g.x, g.y))):
            if want is None:
                assert have == (None, None)
            else:
                assert have == pytest.approx(tuple(want), abs=1e-6)
        assert g.valid == (len(fresh) == 4)
        if mode == "event":
            if raw is not None and pos is not None:
                errs.append(math.dist(real[g.t], pos))
                assert g.smooth_err == pytest.approx(errs[-1], abs=1e-6)
                assert g.avg_smooth_err == pytest.approx(sum(errs) / len(errs), abs=1e-6)
                assert g.max_smooth_err == pytest.approx(max(errs), abs=1e-6)
            else:
                assert g.smooth_err is None


def test_two_anchor_layout_gives_points(spark):
    rows, _ = walk(20, drop=0.0)
    pair = {1: FLAT[1], 3: FLAT[3]}
    got = locate.locate_2d(spark.createDataFrame(rows, RANGES), pair).collect()
    assert all(len(g.raw_points) in (0, 2) for g in got) and "x" not in got[0].asDict()


def newton(anchors, dist, seed, iterations=18, damping=35.0):
    """Scalar damped Gauss-Newton in numpy, one tick."""
    p, best, best_err = np.array(seed, float), np.array(seed, float), None
    if any(d is None for d in dist) or len(anchors) < 4:
        return None
    for _ in range(iterations):
        diff = p - anchors
        reach = np.sqrt(np.maximum((diff**2).sum(1), 1e-9))
        jac, res = diff / np.maximum(reach, 1e-6)[:, None], reach - np.array(dist)
        step = np.linalg.solve(jac.T @ jac + damping * np.eye(3), -jac.T @ res)
        p = np.clip(p + step, [-450, -350, 0], [2950, 2150, 580])
        err = np.abs(res).mean()
        if best_err is None or err < best_err:
            best, best_err = p.copy(), err
        if np.linalg.norm(step) < 0.01:
            break
    return best


def test_newton_batch_equals_scalar():
    rnd = np.random.default_rng(1)
    anchors = np.array(list(K.LAYOUTS_3D[5][1].values()))
    pts = rnd.uniform([0, 0, 0], [2500, 1800, 300], (50, 3))
    dist = np.linalg.norm(pts[:, None] - anchors[None], axis=2) + rnd.normal(0, 15, (50, 5))
    seed = pts + rnd.normal(0, 60, (50, 3))
    dist[3, 2] = np.nan
    got = solve3d.gauss_newton(anchors, dist, seed)
    assert np.isnan(got[3]).all()
    for i in range(50):
        if i != 3:
            assert got[i] == pytest.approx(newton(anchors, list(dist[i]), seed[i]), abs=1e-7)
    converged = solve3d.gauss_newton(anchors, np.linalg.norm(pts[:, None] - anchors[None], axis=2), seed, 400, 0.01)
    assert np.abs(converged[:, :2] - pts[:, :2]).max() < 1.0


@pytest.mark.parametrize("pieces", [{}, {"piece_ticks": 16, "warm_ticks": 8}, {"piece_ticks": 50, "warm_ticks": 0}])
def test_track_equals_a_tick_loop(spark, pieces):
    rows, _ = walk(90, slant=True)
    layout = K.LAYOUTS_3D[4][1]
    anchors = np.array([layout[a] for a in sorted(layout)])
    got = locate.locate_3d(spark.createDataFrame(rows, RANGES), layout, **pieces).orderBy("t").collect()
    at = {}
    for x in rows:
        at.setdefault(x[2], {})[x[4]] = x[5]
    assert [g.t for g in got] == sorted(at)
    ema, pos = {}, None
    for g in got:
        new = at[g.t]
        for a, v in new.items():
            ema[a] = v if a not in ema else 0.12 * v + 0.88 * ema[a]
        guess = (K.CENTER_X, K.CENTER_Y, K.TAG_BASE_Z) if pos is None else pos
        raw = newton(anchors, [new.get(a) for a in sorted(layout)], guess)
        fine = newton(anchors, [ema.get(a) for a in sorted(layout)], guess)
        if fine is not None:
            pos = fine if pos is None else 0.08 * fine + 0.92 * pos
        for want, have in ((raw, (g.x_raw, g.y_raw, g.z_raw)), (pos, (g.x, g.y, g.z))):
            if want is None:
                assert have == (None, None, None)
            else:
                assert have == pytest.approx(tuple(want), abs=1e-5)


def test_redone_pieces_alone_are_written(spark):
    """Pieces with too short a warm-up are solved again, and only they; slow factors need several generations."""
    rows, _ = walk(120, slant=True)
    layout, df, sizes = K.LAYOUTS_3D[4][1], spark.createDataFrame(rows, RANGES), []

    def counted(t):
        t = shared_checkpoint(t)
        sizes.append(t.count())
        return t

    slow = {"alpha_dist": 0.05, "alpha_pos": 0.05}
    whole = {r.t: (r.x, r.y, r.z) for r in locate.locate_3d(df, layout, slow).collect()}
    cut = locate.locate_3d(df, layout, slow, barrier=counted, piece_ticks=20, warm_ticks=5).collect()
    assert len(cut) == len(whole)
    for r in cut:
        assert (r.x, r.y, r.z) == pytest.approx(whole[r.t], abs=1e-4) if None not in whole[r.t] else r.x is None
    # ticks and the first generation, then for every round its wrong seams, the redone rows and the starts of the pieces
    first, wrong, redone = sizes[1], sizes[2::3], sizes[3::3]
    assert redone and all(n <= 20 * seams for n, seams in zip(redone, wrong)) and max(redone) < first and wrong[-1] == 0


def test_sweep_of_3d_settings_equals_separate_runs(spark):
    rows, _ = walk(70, slant=True)
    layout, df = K.LAYOUTS_3D[4][1], spark.createDataFrame(rows, RANGES)
    stamps = sorted({r[2] for r in rows})
    truth = spark.createDataFrame([(0, 1, t, 500 + 40 * t, 600 + 30 * t, 95.0) for t in stamps], "run_id long, tag_id long, t double, x double, y double, z double")
    truth = truth.join(df.select("run_id", "tag_id").distinct().withColumnsRenamed({"run_id": "r", "tag_id": "g"})).select(
        F.col("r").alias("run_id"), F.col("g").alias("tag_id"), "t", "x", "y", "z"
    )
    settings = [{}, {"alpha_dist": 0.6, "alpha_pos": 0.3}, {"alpha_pos": 0.9, "precision_tolerance_cm": 700.0}]
    got = {r.setting: r for r in locate.alpha_sweep_3d(df, layout, truth, settings, piece_ticks=16, warm_ticks=4).collect()}
    assert sorted(got) == [0, 1, 2]
    for i, use in enumerate(settings):
        one = locate.locate_3d(df, layout, use, truth=truth).where("err3d IS NOT NULL")
        names = ["err3d", "errxy", "errz", "traj_err_3d", "delay_total_s", "precision"]
        want = one.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in names]).first()
        assert got[i].n == want.n > 0
        for c in names:
            assert got[i][f"avg_{c}"] == pytest.approx(want[c], abs=1e-6), c


def test_ground_mode_keeps_the_slant_ranges(spark):
    rows, _ = walk(30, slant=True, drop=0.0)
    got = locate.locate_3d_to_2d(spark.createDataFrame(rows, RANGES), FLAT).orderBy("t").collect()
    first = {x[4]: x[5] for x in rows[:4]}
    assert got[0].raw_3d == first
    flat = {a: math.sqrt(max(0.0, d * d - 505.0**2)) for a, d in first.items()}
    assert (got[0].x_raw, got[0].y_raw) == pytest.approx(tuple(planar(FLAT, flat)), abs=1e-6)
