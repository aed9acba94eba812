"""Spatial position from ranges: damped Gauss-Newton, per tick or along a track.

Per tick the problem is independent and solved for a whole Arrow batch at once.
Along a track each solve starts from the smoothed estimate of the tick before,
a non-linear recurrence.  It forgets its start, so tracks are cut into pieces
that warm up on the end of the piece before; every seam is then compared with
the true state there, and pieces that disagree are solved again from that
state.  Tracks of one task advance together, one numpy step per tick.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtrack import constants as K
from tagtrack.functions.geometry import ground_distance
from tagtrack.operators import align, scan, solve2d
from tagtrack.plans.barrier import shared_checkpoint

Layout3 = Mapping[int, tuple[float, float, float]]
#: a smoothing factor, or one for each value of the key column SETTING
Alpha = float | Sequence[float]
SETTING = "setting"
START = (K.CENTER_X, K.CENTER_Y, K.TAG_BASE_Z)
PIECE_TICKS = 2048
WARM_TICKS = 512
# rows held by a task while it advances its tracks together
LANES, LANE_ROWS = 1024, 400_000
WARM, REAL, SEED = 0, 1, 2


def gauss_newton(
    anchors: np.ndarray,
    dist: np.ndarray,
    seed: np.ndarray,
    iterations: int = K.SOLVER_ITERATIONS,
    damping: float = K.SOLVER_DAMPING,
) -> np.ndarray:
    """Solve all rows of ``dist`` (rows x anchors) from ``seed`` (rows x 3).

    A row with a missing range, or fewer than four anchors, gives NaN.  The kept
    point is the one reached by the step whose starting error was smallest.
    """
    low = np.array([K.WORLD_X[0], K.WORLD_Y[0], K.WORLD_Z[0]])
    high = np.array([K.WORLD_X[1], K.WORLD_Y[1], K.WORLD_Z[1]])
    point = seed.astype(float)
    best = point.copy()
    best_err = np.full(len(point), np.inf)
    solvable = ~np.isnan(dist).any(axis=1)
    if len(anchors) < 4:
        solvable[:] = False
    live = np.flatnonzero(solvable)
    live_point, live_dist = point[live], dist[live]
    for _ in range(iterations):
        if live.size == 0:
            break
        # one array per axis and anchor: plain products, no small matrices
        n00, n01, n02, n11, n12, n22 = (np.zeros(live.size) for _ in range(6))
        r0, r1, r2, off = (np.zeros(live.size) for _ in range(4))
        for k, anchor in enumerate(anchors):
            dx, dy, dz = (live_point[:, i] - anchor[i] for i in range(3))
            reach = np.sqrt(np.maximum(dx * dx + dy * dy + dz * dz, 1e-9))
            resid, length = reach - live_dist[:, k], np.maximum(reach, 1e-6)
            jx, jy, jz = dx / length, dy / length, dz / length
            n00 += jx * jx
            n01 += jx * jy
            n02 += jx * jz
            n11 += jy * jy
            n12 += jy * jz
            n22 += jz * jz
            r0 += jx * resid
            r1 += jy * resid
            r2 += jz * resid
            off += np.abs(resid)
        for diagonal in (n00, n11, n22):
            diagonal += damping
        # the adjugate of a symmetric matrix
        a00, a01, a02 = n11 * n22 - n12 * n12, n12 * n02 - n01 * n22, n01 * n12 - n11 * n02
        a11, a12, a22 = n22 * n00 - n02 * n02, n02 * n01 - n12 * n00, n00 * n11 - n01 * n01
        det = n00 * a00 + n01 * a01 + n02 * a02
        ok = np.abs(det) >= K.SINGULAR
        bottom = np.where(ok, det, 1.0)
        step = np.column_stack(
            [-(a00 * r0 + a01 * r1 + a02 * r2) / bottom, -(a01 * r0 + a11 * r1 + a12 * r2) / bottom, -(a02 * r0 + a12 * r1 + a22 * r2) / bottom]
        )
        moved = np.clip(live_point + step, low, high)
        err = off / len(anchors)
        better = ok & (err < best_err[live])
        best[live[better]] = moved[better]
        best_err[live[better]] = err[better]
        on = ok & (np.sqrt((step * step).sum(axis=1)) >= K.SOLVER_STOP_CM)
        live, live_point, live_dist = live[on], moved[on], live_dist[on]
    best[~solvable] = np.nan
    return best


def _matrix(layout: Layout3) -> tuple[list[int], np.ndarray]:
    ids = sorted(layout)
    return ids, np.array([layout[a] for a in ids], dtype=float)


def locate_points(
    ticks: DataFrame,
    layout: Layout3,
    iterations: int = K.SOLVER_ITERATIONS,
    damping: float = K.SOLVER_DAMPING,
) -> DataFrame:
    """Stateless mode: each tick starts from its own planar solution at tag height.

    Adds x, y, z (NULL when an active range is missing).  This is a different
    estimator from the track mode and is not expected to equal it.
    """
    ids, anchors = _matrix(layout)
    flat = {a: xyz[:2] for a, xyz in layout.items()}
    height = layout[ids[0]][2]
    ground = ticks.select(
        "*", *[ground_distance(F.col(align.dist_col(a)), height).alias(f"_g{a}") for a in ids]
    )
    gx, gy = solve2d.position(flat, lambda a: f"_g{a}")
    seeded = ground.select(*ticks.columns, gx.alias("_x0"), gy.alias("_y0"))
    dist = [align.dist_col(a) for a in ids]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ticks.schema.fields)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seed = np.column_stack([pdf["_x0"], pdf["_y0"], np.full(len(pdf), K.TAG_BASE_Z)])
            xyz = gauss_newton(anchors, pdf[dist].to_numpy(dtype=float), seed, iterations, damping)
            out = pdf.drop(columns=["_x0", "_y0"])
            out["x"], out["y"], out["z"] = xyz[:, 0], xyz[:, 1], xyz[:, 2]
            yield out

    solved = seeded.mapInPandas(solve, f"{schema}, x double, y double, z double")
    return solved.select(
        *ticks.columns, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("x", "y", "z")]
    )


def _advance(
    batch: list[pd.DataFrame], sizes: np.ndarray, ids: Sequence[int], anchors: np.ndarray, alpha_dist: Alpha, alpha_pos: Alpha
) -> pd.DataFrame:
    """Run the recurrence over several tracks at once; returns their rows with state.

    ``sizes`` are the rows of each track, one after the other in the frames of the batch.
    """
    n, lanes = len(ids), len(sizes)
    rows = pd.concat(batch, ignore_index=True)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # the longest lane first: at every step the lanes that go on are the first ones
    longest = np.argsort(-sizes, kind="stable")
    start, going = start[longest], np.searchsorted(-sizes[longest], -np.arange(int(sizes.max())), side="left")
    dist = rows[[f"d{a}" for a in ids]].to_numpy(dtype=float)
    kind = rows["kind"].to_numpy()
    given = rows[[f"s{a}" for a in ids] + ["x", "y", "z"]].to_numpy(dtype=float)
    smoothed = np.full((lanes, n), np.nan)
    state = np.full((lanes, 3), np.nan)
    raw_out = np.full((len(rows), 3), np.nan)
    out = np.full((len(rows), n + 3), np.nan)
    by_dist, by_pos = (
        np.full((lanes, 1), a) if np.ndim(a) == 0 else np.asarray(a, float)[rows[SETTING].to_numpy()[start]][:, None]
        for a in (alpha_dist, alpha_pos)
    )
    for j, m in enumerate(going.tolist()):
        at = start[:m] + j
        lane: slice | np.ndarray = slice(0, m)
        seeding = kind[at] == SEED
        if seeding.any():
            seeds = np.flatnonzero(seeding)
            smoothed[seeds] = given[at[seeding], :n]
            state[seeds] = given[at[seeding], n:]
            lane, at = np.flatnonzero(~seeding), at[~seeding]
            if at.size == 0:
                continue
        new, old = dist[at], smoothed[lane]
        mixed = np.where(np.isnan(old), new, by_dist[lane] * new + (1.0 - by_dist[lane]) * old)
        smoothed[lane] = np.where(np.isnan(new), old, mixed)
        guess = np.where(np.isnan(state[lane]), START, state[lane])
        both = gauss_newton(
            anchors, np.vstack([new, smoothed[lane]]), np.vstack([guess, guess])
        )
        raw, est = both[: at.size], both[at.size :]
        old = state[lane]
        mixed = np.where(np.isnan(old), est, by_pos[lane] * est + (1.0 - by_pos[lane]) * old)
        state[lane] = np.where(np.isnan(est), old, mixed)
        raw_out[at] = raw
        out[at, :n] = smoothed[lane]
        out[at, n:] = state[lane]
    for i, a in enumerate(ids):
        rows[f"s{a}"] = out[:, i]
    for i, c in enumerate(("x", "y", "z")):
        rows[c] = out[:, n + i]
        rows[f"{c}_raw"] = raw_out[:, i]
    last = np.zeros(len(rows), dtype=bool)
    warm_end = np.flatnonzero((kind[:-1] == WARM) & (kind[1:] == REAL)) if len(rows) > 1 else []
    last[warm_end] = True
    return rows[(kind == REAL) | last]


def _track_task(ids: Sequence[int], anchors: np.ndarray, alpha_dist: Alpha, alpha_pos: Alpha, keys: Sequence[str]):
    group = [*keys, "piece"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows arrive sorted by (key, piece, idx); a piece may span batches
        tail: list[pd.DataFrame] = []
        waiting: list[pd.DataFrame] = []
        sizes: list[int] = []
        held = open_rows = 0
        last: tuple | None = None
        for pdf in batches:
            if not len(pdf):
                continue
            first = np.zeros(len(pdf), bool)
            for c in group:
                v = pdf[c].to_numpy()
                first[1:] |= v[1:] != v[:-1]
            first[0] = last is None or last != tuple(pdf[c].iloc[0] for c in group)
            last = tuple(pdf[c].iloc[-1] for c in group)
            cut = np.flatnonzero(first).tolist()
            if not cut:  # all of it goes on with the open piece
                tail.append(pdf)
                open_rows += len(pdf)
                continue
            if open_rows + cut[0]:
                sizes.append(open_rows + cut[0])
            sizes += [b - a for a, b in zip(cut, cut[1:])]
            waiting += [*tail, pdf.iloc[: cut[-1]]]
            held += open_rows + cut[-1]
            tail, open_rows = [pdf.iloc[cut[-1] :]], len(pdf) - cut[-1]
            if len(sizes) >= LANES or held >= LANE_ROWS:
                yield _advance(waiting, np.array(sizes), ids, anchors, alpha_dist, alpha_pos)
                waiting, sizes, held = [], [], 0
        if open_rows:
            waiting += tail
            sizes.append(open_rows)
        if sizes:
            yield _advance(waiting, np.array(sizes), ids, anchors, alpha_dist, alpha_pos)

    return run


def solver(
    layout: Layout3, alpha_dist: Alpha, alpha_pos: Alpha, keys: Sequence[str], types: Mapping[str, str]
) -> tuple[list[str], list[str], list[str], Callable[[DataFrame], DataFrame]]:
    """Names of the distances, of the state and of all columns of the rows that the returned function advances.

    Rows of a (key, piece) are one lane, in the order of ``idx``; a row of kind SEED gives the state before the next one.
    """
    keys = list(keys)
    ids, anchors = _matrix(layout)
    dist, smoothed = [f"d{a}" for a in ids], [f"s{a}" for a in ids]
    state = [*smoothed, "x", "y", "z"]
    cols = [*keys, "piece", "idx", "t", "dt", "kind", *dist, *state]
    schema = ", ".join(
        [f"`{k}` {types[k]}" for k in keys]
        + ["piece long", "idx long", "t double", "dt double", "kind int"]
        + [f"{c} double" for c in [*dist, *state, "x_raw", "y_raw", "z_raw"]]
    )
    task = _track_task(ids, anchors, alpha_dist, alpha_pos, keys)

    def solve(rows: DataFrame) -> DataFrame:
        placed = rows.select(*cols).repartition(*keys, "piece").sortWithinPartitions(*keys, "piece", "idx", "kind")
        done = placed.mapInPandas(task, schema)
        return done.select(
            *[c for c in done.columns if c not in (*state, "x_raw", "y_raw", "z_raw")],
            *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in [*state, "x_raw", "y_raw", "z_raw"]],
        )

    return dist, state, cols, solve


def locate_track(
    ticks: DataFrame,
    layout: Layout3,
    alpha_dist: Alpha,
    alpha_pos: Alpha,
    keys: Sequence[str] = align.KEYS,
    piece_ticks: int = PIECE_TICKS,
    warm_ticks: int = WARM_TICKS,
    tolerance_cm: float = 1e-6,
    barrier: Callable[[DataFrame], DataFrame] = shared_checkpoint,
) -> DataFrame:
    """Sequential mode over tick rows with ``idx`` (1-based position in the track).

    Constant smoothing factors, as the recurrence is defined per tick; lists of factors
    are indexed by the key column ``setting``.  Adds the
    smoothed distances ``s<n>``, the raw solution and the smoothed position.

    Every piece starts from a warm-up on the end of the one before.  Where that start differs from the true
    end, the piece is solved again from the end and written by itself as a further generation; only
    seams after such pieces can be wrong then.  The last generation of a piece is its result.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in ticks.schema.fields}
    dist, state, cols, solve = solver(layout, alpha_dist, alpha_pos, keys, types)
    warm_ticks = min(warm_ticks, piece_ticks)
    piece = [*keys, "piece"]
    nothing = [F.lit(None).cast("double").alias(c) for c in state]
    at = F.col("idx") - 1
    own = F.floor(at / F.lit(piece_ticks)).cast("long")
    base = ticks.select(*keys, own.alias("_own"), F.col("idx").cast("long"), "t", "dt", *dist)
    lends = F.pmod(at, F.lit(piece_ticks)) >= piece_ticks - warm_ticks
    pieces = base.select(
        "*", F.explode(F.when(lends, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))).alias("piece")
    )
    kind = F.when(F.col("piece") == F.col("_own"), F.lit(REAL)).otherwise(F.lit(WARM))
    feed = pieces.select(*piece, "idx", "t", "dt", kind.alias("kind"), *dist, *nothing)

    def renamed(to: str, of: str = "") -> list[Column]:
        return [F.col(of + c).alias(to + c) for c in state]

    first = barrier(solve(feed))
    follows = first.where((F.col("kind") == REAL) & (F.pmod(F.col("idx") - 1, F.lit(piece_ticks)) == 0)).select(*piece)
    # one row per piece and generation from here on, but for the redone pieces themselves
    starts = first.where(F.col("kind") != REAL).select(*piece, F.lit(0).alias("_gen"), *renamed("b_"))
    done, redone = first.where(F.col("kind") == REAL).withColumn("_gen", F.lit(0)), first.where(F.col("kind") == REAL)
    apart = F.lit(False)
    for c in state:
        start, end = F.col(f"b_{c}"), F.col(f"e_{c}")
        apart = apart | F.coalesce(F.abs(start - end) > tolerance_cm, F.lit(False)) | (start.isNull() != end.isNull())
    rounds = 0
    while True:
        ends = redone.where(F.col("idx") % piece_ticks == 0).select(
            *keys, (F.col("piece") + 1).alias("piece"), "idx", "t", "dt", *renamed("e_")
        )
        seams = follows.join(ends, piece).join(starts, piece, "left")
        wrong = barrier(seams.where(apart).select(*piece, "idx", "t", "dt", *[f"e_{c}" for c in state]))
        if wrong.isEmpty():
            break
        rounds += 1
        seed = wrong.select(
            *piece, "idx", "t", "dt", F.lit(SEED).alias("kind"),
            *[F.lit(None).cast("double").alias(c) for c in dist], *renamed("", "e_"),
        )
        again = feed.where(F.col("kind") == REAL).join(wrong.select(*piece), piece, "left_semi")
        redone = barrier(solve(again.select(*cols).unionByName(seed)).where(F.col("kind") == REAL))
        done = done.unionByName(redone.withColumn("_gen", F.lit(rounds)))
        # a redone piece starts from the state it was compared with
        settled = wrong.select(*piece, F.lit(rounds).alias("_gen"), *renamed("b_", "e_"))
        starts = barrier(starts.join(wrong.select(*piece), piece, "left_anti").unionByName(settled))
    if rounds:
        last = starts.select(*piece, F.col("_gen").alias("_last"))
        done = done.join(last, piece, "left").where(F.col("_gen") == F.coalesce("_last", F.lit(0))).drop("_last")
    return done.drop("kind", "piece", "_gen")


def with_track_index(ticks: DataFrame, keys: Sequence[str] = align.KEYS, order: str = "t") -> DataFrame:
    return scan.with_index(ticks, keys, [order], "idx")
