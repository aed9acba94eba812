"""The positioning jobs: ranges in, one row per tick out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtrack import constants as K
from tagtrack.functions import geometry as G
from tagtrack.operators import accuracy, align, scan, smooth, solve2d, solve3d
from tagtrack.plans.barrier import shared_checkpoint

Barrier = Callable[[DataFrame], DataFrame]
KEYS = align.KEYS


def align_ranges(
    ranges: DataFrame,
    anchor_ids: Sequence[int],
    mode: str,
    width: float,
    max_age_s: float = K.MAX_AGE_S,
    hz: float = K.TICK_HZ,
) -> DataFrame:
    """Tick rows with held distances ``d<n>`` and the values to smooth ``f<n>``.

    ``frame``: a regular clock on which a held value is applied at every tick
    until it is too old.  ``event``: one tick per arrival stamp; a held value
    takes part in the solution but only new arrivals feed the filter.
    """
    if mode == "event":
        stamps = align.event_ticks(ranges, anchor_ids, width=width)
        return align.hold_events(stamps, anchor_ids, max_age_s, width=width)
    if mode != "frame":
        raise ValueError(f"unknown mode {mode!r}")
    clock = align.tick_grid(ranges, hz, max_age_s, width=width)
    held = align.hold(ranges, clock, anchor_ids, max_age_s, width=width)
    return held.select("*", *[F.col(align.dist_col(a)).alias(f"f{a}") for a in anchor_ids])


def locate_2d(
    ranges: DataFrame,
    layout: solve2d.Layout,
    settings: Mapping[str, float] | None = None,
    truth: DataFrame | None = None,
    mode: str = "event",
    max_age_s: float = K.MAX_AGE_S,
    hz: float = K.TICK_HZ,
    project: Callable[[Column], Column] | None = None,
    barrier: Barrier = shared_checkpoint,
) -> DataFrame:
    """Align, smooth, solve, smooth again and, with ``truth``, score.

    Columns: keys, chunk, t, dt, d<n>, s<n>, valid, x_raw, y_raw, x, y; with two
    anchors raw_points and smooth_points instead of positions; with truth the
    errors, precisions and their running averages and maxima.  ``project`` maps
    measured to floor ranges; the measured ones are kept as ``m<n>``.
    """
    use = {**K.default_settings("2d"), **(settings or {})}
    ids = sorted(layout)
    width = smooth.chunk_width(use["alpha_dist"], use["alpha_pos"])
    ticks = align_ranges(ranges, ids, mode, width, max_age_s, hz)
    kept = []
    if project is not None:
        kept = [f"m{a}" for a in ids]
        ticks = ticks.withColumns(
            {f"m{a}": F.col(align.dist_col(a)) for a in ids}
            | {c: project(F.col(c)) for a in ids for c in (align.dist_col(a), f"f{a}")}
        )
    dt = "dt" if mode == "frame" else None
    ema = smooth.smooth(
        ticks, KEYS, {f"f{a}": align.smooth_col(a) for a in ids}, use["alpha_dist"], dt=dt
    )
    base = [*KEYS, scan.CHUNK, "t", "dt", *[align.dist_col(a) for a in ids], *[align.smooth_col(a) for a in ids], *kept]
    x_raw, y_raw = solve2d.position(layout)
    xs, ys = solve2d.position(layout, align.smooth_col)
    solved = ema.select(
        *base,
        align.complete(ids).alias("valid"),
        x_raw.alias("x_raw"),
        y_raw.alias("y_raw"),
        xs.alias("_xs"),
        ys.alias("_ys"),
    )
    if len(ids) < 3:
        pairs = solved.select(
            *base,
            "valid",
            solve2d.pair_points(layout).alias("raw_points"),
            solve2d.pair_points(layout, align.smooth_col).alias("smooth_points"),
        )
        return pairs
    # the second filter reads its input twice; materialise it once instead
    solved = barrier(solved)
    placed = smooth.smooth(solved, KEYS, {"_xs": "x", "_ys": "y"}, use["alpha_pos"]).drop("_xs", "_ys")
    if truth is None:
        return placed
    scored = accuracy.errors_2d(accuracy.with_truth(placed, truth), use["precision_tolerance_cm"])
    return accuracy.running_errors_2d(barrier(scored))


def project_ranges(slant: DataFrame, settings: Mapping[str, float] | None = None) -> DataFrame:
    """Slant ranges to floor ranges; the measured value stays as ``slant_cm``."""
    use = {**K.default_settings("3d_to_2d"), **(settings or {})}
    flat = G.ground_distance(F.col("distance_cm"), use["anchor_height_cm"], use["tag_assumed_height_cm"])
    return slant.withColumn("slant_cm", F.col("distance_cm")).withColumn("distance_cm", flat)


def locate_3d_to_2d(
    slant: DataFrame,
    layout: solve2d.Layout,
    settings: Mapping[str, float] | None = None,
    truth: DataFrame | None = None,
    mode: str = "event",
    barrier: Barrier = shared_checkpoint,
) -> DataFrame:
    """Project each slant range to the floor, then locate in the plane.

    Adds ``raw_3d``, the map of the tick's measured slant ranges.
    """
    use = {**K.default_settings("3d_to_2d"), **(settings or {})}
    ids = sorted(layout)

    def project(slant_cm: Column) -> Column:
        return G.ground_distance(slant_cm, use["anchor_height_cm"], use["tag_assumed_height_cm"])

    out = locate_2d(slant, layout, use, truth, mode, project=project, barrier=barrier)
    return out.withColumn("raw_3d", align.distance_map(ids, lambda a: f"m{a}")).drop(*[f"m{a}" for a in ids])


def locate_3d(
    ranges: DataFrame,
    layout: solve3d.Layout3,
    settings: Mapping[str, float] | None = None,
    truth: DataFrame | None = None,
    mode: str = "stamp",
    max_age_s: float = K.MAX_AGE_S,
    hz: float = K.TICK_HZ,
    barrier: Barrier = shared_checkpoint,
    **pieces: float,
) -> DataFrame:
    """Sequential 3D track and, with ``truth``, its instant and delayed errors.

    Smoothing factors are constant per tick.  ``stamp``: one tick per stamp with the
    ranges of that stamp alone.  ``event`` and ``frame``: as in :func:`locate_2d`, a
    range is held until it is too old, on the arrivals or on a regular clock.
    """
    use = {**K.default_settings("3d"), **(settings or {})}
    ids = sorted(layout)
    if mode == "stamp":
        ticks = align.with_dt(align.event_ticks(ranges, ids))
    else:
        ticks = align_ranges(ranges, ids, mode, scan.CHUNK_S, max_age_s, hz)
        if mode == "event":
            ticks = align.with_dt(ticks)
        ticks = ticks.select(*KEYS, scan.CHUNK, "t", "dt", *[align.dist_col(a) for a in ids])
    indexed = solve3d.with_track_index(barrier(ticks))
    track = solve3d.locate_track(indexed, layout, use["alpha_dist"], use["alpha_pos"], barrier=barrier, **pieces)
    dt = F.coalesce(F.col("dt"), F.lit(0.0))
    track = track.select(
        "*",
        G.filter_delay(use["alpha_dist"], dt).alias("delay_dist_s"),
        G.filter_delay(use["alpha_pos"], dt).alias("delay_pos_s"),
        align.complete(ids).alias("valid"),
    ).withColumn("delay_total_s", F.col("delay_dist_s") + F.col("delay_pos_s"))
    track = scan.with_chunk(track)
    if truth is None:
        return track
    return score_3d(track, truth, use["precision_tolerance_cm"], barrier)


def score_3d(track: DataFrame, truth: DataFrame, tolerance: float, barrier: Barrier = shared_checkpoint) -> DataFrame:
    """Delayed truth, measured delay, errors and running figures of a 3D track."""
    aimed = track.withColumn("_at", F.col("t") - F.col("delay_total_s"))
    past = accuracy.truth_at(aimed, truth, "_at").drop("_at")
    seen = barrier(accuracy.with_truth(past, truth))
    timed = accuracy.best_delay(seen)
    scored = barrier(scan.with_chunk(accuracy.errors_3d(timed, tolerance)))
    return accuracy.running_errors_3d(scored)


def alpha_sweep(
    ranges: DataFrame, layout: solve2d.Layout, truth: DataFrame, alphas: Sequence[float], tolerances: Sequence[float],
    offsets: Mapping[str, Mapping[int, tuple[float, float]]] | None = None,
) -> DataFrame:
    """Error of the smoothed solution over a grid of settings.

    The ticks are aligned and joined with the truth once, in chunks that suit every
    factor; each factor adds its smoothed columns to the same rows, tolerances and
    anchor offsets add errors.  No tick is copied per setting before the errors are.
    """
    ids = sorted(layout)
    shifts = {"none": {}, **(offsets or {})}
    rows = align.event_ticks(ranges, ids, width=smooth.chunk_width(*alphas))
    for k, alpha in enumerate(alphas):
        names = {align.dist_col(a): f"s{k}_{a}" for a in ids}
        rows = smooth.smooth(rows, KEYS, names, alpha, dt="dt" if k else None)
    rows = accuracy.with_truth(rows, truth)
    errs = []
    for k, alpha in enumerate(alphas):
        for name, moved in shifts.items():
            spot = {
                a: (layout[a][0] + moved.get(a, (0.0, 0.0))[0], layout[a][1] + moved.get(a, (0.0, 0.0))[1]) for a in ids
            }
            x, y = solve2d.position(spot, lambda a, k=k: f"s{k}_{a}")
            err = G.distance_2d(F.col("true_x"), F.col("true_y"), x, y)
            errs += [
                F.struct(
                    F.lit(alpha).alias("alpha"),
                    F.lit(float(tol)).alias("tolerance_cm"),
                    F.lit(name).alias("anchor_shift"),
                    err.alias("err"),
                    G.precision_percent(err, float(tol)).alias("precision"),
                )
                for tol in tolerances
            ]
    every = rows.select(F.explode(F.array(*errs)).alias("_e")).select("_e.*")
    return every.where(F.col("err").isNotNull()).groupBy("alpha", "tolerance_cm", "anchor_shift").agg(
        F.count(F.lit(1)).alias("n"), F.avg("err").alias("avg_err"), F.avg("precision").alias("avg_precision")
    )


def alpha_sweep_3d(
    ranges: DataFrame,
    layout: solve3d.Layout3,
    truth: DataFrame,
    settings: Sequence[Mapping[str, float]],
    barrier: Barrier = shared_checkpoint,
    **pieces: float,
) -> DataFrame:
    """Errors of the 3D track under each of ``settings`` (alpha_dist, alpha_pos, precision_tolerance_cm).

    Ticks are aligned once; a setting is a further key of the solver, whose lanes hold
    all settings of a track side by side. The list is driver-sized; rows grow with it. Per setting: the settings,
    n scored ticks, average errors against the truth of the tick and against that
    of the filters' delay, and average precision.
    """
    use = [{**K.default_settings("3d"), **s} for s in settings]
    if not use:
        raise ValueError("no settings")
    ids, name = sorted(layout), solve3d.SETTING
    ticks = barrier(solve3d.with_track_index(align.with_dt(align.event_ticks(ranges, ids))))
    each = ticks.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(len(use) - 1))))
    by = {k: [float(s[k]) for s in use] for k in ("alpha_dist", "alpha_pos", "precision_tolerance_cm")}
    track = solve3d.locate_track(each, layout, by["alpha_dist"], by["alpha_pos"], [*KEYS, name], barrier=barrier, **pieces)

    def of(k: str) -> Column:
        return F.get(F.array(*[F.lit(v) for v in by[k]]), F.col(name))

    dt = F.coalesce(F.col("dt"), F.lit(0.0))
    delay = G.filter_delay(of("alpha_dist"), dt) + G.filter_delay(of("alpha_pos"), dt)
    aimed = track.withColumn("delay_total_s", delay).withColumn("_at", F.col("t") - F.col("delay_total_s"))
    rows = accuracy.with_truth(accuracy.truth_at(aimed, truth, "_at"), truth)
    rows = rows.where("true_x IS NOT NULL AND x_raw IS NOT NULL AND x IS NOT NULL")
    est, true = [F.col(c) for c in ("x", "y", "z")], [F.col(f"true_{c}") for c in ("x", "y", "z")]
    past = [F.coalesce(F.col(f"at_{c}"), F.col(f"true_{c}")) for c in ("x", "y", "z")]
    err = G.distance_3d(*true, *est)
    out = rows.groupBy(name).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(err).alias("avg_err3d"),
        F.avg(G.distance_2d(*true[:2], *est[:2])).alias("avg_errxy"),
        F.avg(F.abs(true[2] - est[2])).alias("avg_errz"),
        F.avg(G.distance_3d(*past, *est)).alias("avg_traj_err_3d"),
        F.avg("delay_total_s").alias("avg_delay_total_s"),
        F.avg(G.precision_percent(err, of("precision_tolerance_cm"))).alias("avg_precision"),
    )
    return out.select(name, *[of(k).alias(k) for k in by], *[c for c in out.columns if c != name])
