"""Estimates against a known trajectory."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tagtrack import constants as K
from tagtrack.functions import geometry as G
from tagtrack.operators import align, scan


def with_truth(estimates: DataFrame, truth: DataFrame, keys: Sequence[str] = align.KEYS) -> DataFrame:
    """Attach the true position of the same tick as true_x, true_y[, true_z].

    The same tick is the same microsecond: equal times may be different doubles.
    Truth with stamps of its own is interpolated by :func:`with_truth_between`.
    """
    axes = [c for c in ("x", "y", "z") if c in truth.columns]
    micros = F.round(F.col("t") * F.lit(1e6)).cast("long").alias("_us")
    named = truth.select(*keys, micros, *[F.col(c).alias(f"true_{c}") for c in axes])
    return estimates.select("*", micros).join(named, [*keys, "_us"], "left").drop("_us")


def with_truth_between(estimates: DataFrame, truth: DataFrame, keys: Sequence[str] = align.KEYS) -> DataFrame:
    """True positions at the ticks from truth samples at other times, interpolated; NULL outside the samples."""
    keys = list(keys)
    known = truth_brackets(scan.with_chunk(truth), keys)
    sample = ("t", "x", "y", "z", "next_t", "next_x", "next_y", "next_z")
    side0 = known.select(*keys, scan.CHUNK, F.col("t").alias("_when"), F.lit(0).alias("_side"), F.struct(*sample).alias("_b"))
    extra = [c for c in estimates.columns if c not in (*keys, scan.CHUNK)]
    side1 = estimates.select(*keys, scan.chunk_of(F.col("t"), scan.CHUNK_S).alias(scan.CHUNK), F.col("t").alias("_when"), F.lit(1).alias("_side"), *extra)
    both = side0.unionByName(side1, allowMissingColumns=True)
    inside = F.last("_b", ignorenulls=True).over(scan.chunk_window(keys, ["_when", "_side"]))
    parts = both.groupBy(*keys, scan.CHUNK).agg(F.max_by("_b", F.when(F.col("_side") == 0, F.col("_when"))).alias("_end"))
    carry = parts.select(*keys, scan.CHUNK, F.last("_end", ignorenulls=True).over(scan.earlier_chunks(keys)).alias("_before"))
    rows = both.withColumn("_b", inside).where("_side = 1").join(carry, [*keys, scan.CHUNK])
    b = F.coalesce("_b", "_before")
    u = (F.col("t") - b["t"]) / (b["next_t"] - b["t"])
    here = F.col("t") == b["t"]
    true = [F.when(here, b[c]).otherwise(G.lerp(b[c], b[f"next_{c}"], u)).alias(f"true_{c}") for c in ("x", "y", "z")]
    kept = [scan.CHUNK] if scan.CHUNK in estimates.columns else []
    return rows.select(*keys, *kept, *extra, *true)


def errors_2d(rows: DataFrame, tolerance: float) -> DataFrame:
    """Raw and smoothed error and precision; NULL unless truth and both estimates exist."""
    both = F.col("x_raw").isNotNull() & F.col("x").isNotNull()
    raw = F.when(both, G.distance_2d(F.col("true_x"), F.col("true_y"), F.col("x_raw"), F.col("y_raw")))
    smooth = F.when(both, G.distance_2d(F.col("true_x"), F.col("true_y"), F.col("x"), F.col("y")))
    out = rows.withColumn("raw_err", raw).withColumn("smooth_err", smooth)
    return out.withColumn("raw_precision", G.precision_percent(F.col("raw_err"), tolerance)).withColumn(
        "smooth_precision", G.precision_percent(F.col("smooth_err"), tolerance)
    )


_AVERAGED_2D = ("raw_err", "smooth_err", "raw_precision", "smooth_precision")
_AVERAGED_3D = (
    "err3d",
    "errxy",
    "errz",
    "precision",
    "delay_total_s",
    "measured_delay",
    "traj_err_3d",
    "traj_err_xy",
    "traj_err_z",
    "traj_precision",
)


def running_errors(
    rows: DataFrame, averaged: Sequence[str], peaks: Sequence[str], keys: Sequence[str] = align.KEYS
) -> DataFrame:
    """Running averages (``avg_*``) and maxima (``max_*``) over the scored ticks.

    Ticks without a score leave the figures alone and show NULL themselves.
    """
    scored = F.col(averaged[0]).isNotNull()
    measures: dict[str, tuple[str, Column]] = {"_n": ("count", F.when(scored, F.lit(1)))}
    for c in averaged:
        measures[f"_sum_{c}"] = ("sum", F.when(scored, F.col(c)))
    for c in peaks:
        measures[f"_max_{c}"] = ("max", F.when(scored, F.col(c)))
    run = scan.running(rows, keys, ["t"], measures)
    avgs = [F.when(scored, F.col(f"_sum_{c}") / F.col("_n")).alias(f"avg_{c}") for c in averaged]
    tops = [F.when(scored, F.col(f"_max_{c}")).alias(f"max_{c}") for c in peaks]
    return run.select(*rows.columns, *avgs, *tops)


def running_errors_2d(rows: DataFrame, keys: Sequence[str] = align.KEYS) -> DataFrame:
    return running_errors(rows, _AVERAGED_2D, ("raw_err", "smooth_err"), keys)


def final_errors_2d(rows: DataFrame, keys: Sequence[str] = align.KEYS) -> DataFrame:
    """The last state of the running figures as one combinable aggregate."""
    scored = rows.where(F.col("raw_err").isNotNull())
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"avg_{c}") for c in _AVERAGED_2D],
        F.max("raw_err").alias("max_raw_err"),
        F.max("smooth_err").alias("max_smooth_err"),
    )


def truth_brackets(truth: DataFrame, keys: Sequence[str] = align.KEYS) -> DataFrame:
    """Truth samples with their successor, for interpolation between the two."""
    return scan.with_next(truth.withColumn("_t", F.col("t")), keys, "t", ["_t", "x", "y", "z"]).withColumnRenamed(
        "next__t", "next_t"
    )


_SPOT = ("t", "x", "y", "z")


def remembered(truth: DataFrame, keys: Sequence[str] = align.KEYS, history: int = K.TRUTH_HISTORY, width: float = scan.CHUNK_S) -> DataFrame:
    """Truth samples (keys, t, x, y, z) with ``next``, the sample after, and ``oldest``, the oldest of the last ``history``.

    Samples are cut into parts by their number, not by time, so a part has the same size at
    any rate; its last ``history`` - 1 samples are lent to the part after it and its first one
    to the part before, and both neighbours are plain lag and lead inside a part.
    """
    keys = list(keys)
    size = max(4096, 8 * history)
    indexed = scan.with_index(scan.with_chunk(truth.select(*keys, *_SPOT), "t", width), keys, ["t"], "_idx")
    part, place = F.expr(f"(_idx - 1) div {size}"), F.expr(f"(_idx - 1) % {size}")
    after = F.when(place > size - history, part + 1)
    before = F.when((place == 0) & (part > 0), part - 1)
    lent = indexed.select("*", part.alias("_own"), F.explode(F.array_compact(F.array(part, after, before))).alias("_part"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_idx")
    spot = F.struct(*_SPOT)
    first = F.first(spot).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = lent.select(
        *keys, *_SPOT, "_own", "_part",
        F.lead(spot).over(inside).alias("next"),
        F.coalesce(F.lag(spot, history - 1).over(inside), first).alias("oldest"),
    )
    return rows.where("_own = _part").drop("_own", "_part")


def as_of(targets: DataFrame, samples: DataFrame, at: str, name: str, keys: Sequence[str] = align.KEYS, width: float = scan.CHUNK_S) -> DataFrame:
    """``targets`` with ``name``: the columns of the last sample (by t) not after ``at``, NULL where there is none.

    Both sides are put into chunks of time and ordered together; the first targets of a chunk take the
    last sample of an earlier one, carried over by a row per chunk.
    """
    keys = list(keys)
    own = [c for c in targets.columns if c not in (*keys, scan.CHUNK)]
    chunk = lambda t: scan.chunk_of(F.col(t), width).alias(scan.CHUNK)
    held = F.struct(*[c for c in samples.columns if c not in keys])
    side0 = samples.select(*keys, chunk("t"), F.col("t").alias("_when"), F.lit(0).alias("_side"), held.alias("_b"))
    side1 = targets.select(*keys, chunk(at), F.col(at).alias("_when"), F.lit(1).alias("_side"), *own)
    both = side0.unionByName(side1, allowMissingColumns=True)
    inside = F.last("_b", ignorenulls=True).over(scan.chunk_window(keys, ["_when", "_side"]))
    # one row per chunk; chunks that hold targets only are in it as well
    parts = both.groupBy(*keys, scan.CHUNK).agg(F.max_by("_b", F.when(F.col("_side") == 0, F.col("_when"))).alias("_end"))
    carry = parts.select(*keys, scan.CHUNK, F.last("_end", ignorenulls=True).over(scan.earlier_chunks(keys)).alias("_before"))
    found = both.withColumn("_b", inside).where("_side = 1").join(carry, [*keys, scan.CHUNK], "left")
    return found.select(*keys, *own, F.coalesce("_b", "_before").alias(name))


def truth_at(
    targets: DataFrame,
    truth: DataFrame,
    at: str,
    keys: Sequence[str] = align.KEYS,
    history: int = K.TRUTH_HISTORY,
    width: float = scan.CHUNK_S,
) -> DataFrame:
    """True position at time ``at`` of each target row, from the last ``history`` samples.

    ``targets`` has keys, t and ``at`` <= t; ``truth`` has keys, t, x, y, z at increasing t.
    What a target remembers are the last ``history`` samples not after its t, which need
    not be a sample's own stamp.  Between two remembered samples the position is
    interpolated; before the oldest one it is that sample, after the newest one the
    newest, and without any it is NULL.  Adds at_x, at_y, at_z.
    """
    keys = list(keys)
    extra = [c for c in targets.columns if c not in (*keys, scan.CHUNK)]
    known = remembered(truth, keys, history, width)
    newest = as_of(targets, known.select(*keys, "t", "oldest"), "t", "_now", keys, width)
    rows = as_of(newest, known.select(*keys, *_SPOT, "next"), at, "_b", keys, width)
    # a column a step: in one expression every axis and branch would work all of it out again
    b, at_s = F.col("_b"), F.col(at)
    rows = rows.withColumn("_after", F.when(b["next"]["t"] <= F.col("t"), b["next"])).withColumn("_old", F.col("_now.oldest"))
    after, old, u = F.col("_after"), F.col("_old"), F.col("_u")
    rows = rows.withColumn("_span", after["t"] - b["t"])
    rows = rows.withColumn("_u", F.when(F.col("_span") > 0, (at_s - b["t"]) / F.when(F.col("_span") > 0, F.col("_span"))))
    rows = rows.withColumn("_before", b.isNull() | (at_s < old["t"]))
    picked = [
        F.when(F.col("_before"), old[c]).when(u.isNull(), b[c]).otherwise(G.lerp(b[c], after[c], u)).alias(f"at_{c}")
        for c in ("x", "y", "z")
    ]
    return rows.select(*keys, *extra, *picked)


def best_delay(
    rows: DataFrame,
    keys: Sequence[str] = align.KEYS,
    window_s: float = K.DELAY_WINDOW_S,
    history: int = K.TRUTH_HISTORY,
    width: float = scan.CHUNK_S,
) -> DataFrame:
    """How far back on the true path the estimate lies.

    ``rows`` has keys, t, the estimate x, y, z and the truth true_x, true_y,
    true_z of the tick.  Of the samples at most ``window_s`` old the closest to
    the estimate wins, the newest on a tie.  Rows are sorted inside chunks and pass in
    batches, of which only the last ``window_s`` seconds are held; the end of a
    chunk is lent to the next one so that no window is cut off.
    Ticks without truth are no samples.  Adds measured_delay and delay_err, NULL
    without an estimate or with fewer than two samples so far.
    """
    keys, columns = list(keys), rows.columns
    true = F.col("true_x").isNotNull()
    held = scan.running(scan.with_chunk(rows, "t", width), keys, ["t"], {"_idx": ("count", F.when(true, F.lit(1)))})
    reach = F.sequence(F.col("_own"), scan.chunk_of(F.col("t") + F.lit(window_s), width))
    lent = held.withColumn("_own", F.col(scan.CHUNK)).withColumn("_part", F.explode(reach))
    dealt = lent.repartition(*keys, "_part").sortWithinPartitions(*keys, "_part", "t")
    schema = StructType([*rows.schema.fields, StructField("measured_delay", DoubleType()), StructField("delay_err", DoubleType())])
    chunked = F.col(scan.CHUNK).alias("_own") if scan.CHUNK in columns else F.col("_own")
    names = [F.col(c) for c in columns if c != scan.CHUNK]
    given = dealt.select(*names, chunked, "_part", F.coalesce("_idx", F.lit(0)).alias("_idx"))
    return given.mapInArrow(_delays(keys, columns, window_s, history), schema)


def _delays(keys: list[str], columns: list[str], window_s: float, history: int):
    """Task of :func:`best_delay`: sorted batches in, each part's own rows out with their delay."""
    measured = ("t", "x", "y", "z", "true_x", "true_y", "true_z", "_idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, last = np.empty((len(measured), 0)), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            group = [batch.column(c) for c in (*keys, "_part")]
            starts = np.zeros(n, bool)
            for c in group:
                starts[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            if last is None or last != [c[0].as_py() for c in group]:
                starts[0], tail = True, tail[:, :0]
            last, m = [c[n - 1].as_py() for c in group], tail.shape[1]
            now = [pc.cast(batch.column(c), pa.float64()).to_numpy(zero_copy_only=False) for c in measured]
            values = np.concatenate([tail, np.stack(now)], axis=1)
            delay, err = _closest(values, m, starts, window_s, history)
            own = pc.equal(batch.column("_part"), batch.column("_own"))
            out = [batch.column("_own" if c == scan.CHUNK else c) for c in columns]
            found = [pa.array(v, pa.float64(), mask=np.isnan(v)) for v in (delay, err)]
            yield pa.RecordBatch.from_arrays([*out, *found], [*columns, "measured_delay", "delay_err"]).filter(own)
            begin = m + int(np.flatnonzero(starts)[-1]) if starts.any() else 0
            tail = values[:, max(begin, int(np.searchsorted(values[0, begin:], values[0, -1] - window_s) + begin) - 1) :]

    return run


def _closest(values: np.ndarray, m: int, starts: np.ndarray, window_s: float, history: int) -> tuple[np.ndarray, np.ndarray]:
    """Delay and distance of the closest sample of every row from the ``m``-th on; NaN where there is none.

    All rows step back together, one sample at a time; a row leaves when its samples are too old.
    """
    t, estimate, truth, count = values[0], values[1:4], values[4:7], values[7]
    n = values.shape[1] - m
    first = np.maximum.accumulate(np.where(starts, np.arange(m, m + n), 0))
    delay, err = np.full(n, np.nan), np.full(n, np.inf)
    i = np.flatnonzero(~np.isnan(values[1, m:]) & (count[m:] >= 2)) + m
    back = 0
    while len(i):
        j = i - back
        i = i[(j >= first[i - m]) & (t[i] - t[np.maximum(j, 0)] <= window_s) & (count[i] - count[np.maximum(j, 0)] < history)]
        j = i - back
        away = np.sqrt(((truth[:, j] - estimate[:, i]) ** 2).sum(axis=0))
        closer = away < err[i - m]
        err[i[closer] - m], delay[i[closer] - m] = away[closer], t[i[closer]] - t[j[closer]]
        back += 1
    err[np.isinf(err)] = np.nan
    return delay, err


def errors_3d(rows: DataFrame, tolerance: float) -> DataFrame:
    """Instant and trajectory errors of a 3D track.

    Needs the estimate x, y, z, the raw x_raw, the truth true_*, the delayed
    truth at_* and measured_delay.
    """
    scored = F.col("true_x").isNotNull() & F.col("x_raw").isNotNull() & F.col("x").isNotNull()
    est = [F.col(c) for c in ("x", "y", "z")]
    true = [F.col(f"true_{c}") for c in ("x", "y", "z")]
    past = [F.coalesce(F.col(f"at_{c}"), F.col(f"true_{c}")) for c in ("x", "y", "z")]

    def when(c: Column) -> Column:
        return F.when(scored, c)

    out = rows.select(
        "*",
        when(G.distance_3d(*true, *est)).alias("err3d"),
        when(G.distance_2d(*true[:2], *est[:2])).alias("errxy"),
        when(F.abs(true[2] - est[2])).alias("errz"),
        when(G.distance_3d(*past, *est)).alias("traj_err_3d"),
        when(G.distance_2d(*past[:2], *est[:2])).alias("traj_err_xy"),
        when(F.abs(past[2] - est[2])).alias("traj_err_z"),
    )
    out = out.withColumn("measured_delay", when(F.coalesce("measured_delay", F.lit(0.0))))
    return out.withColumn("precision", G.precision_percent(F.col("err3d"), tolerance)).withColumn(
        "traj_precision", G.precision_percent(F.col("traj_err_3d"), tolerance)
    )


def path_ratio(err: Column, traj_err: Column) -> Column:
    """Average error over average trajectory error; NULL when the latter is 0."""
    return F.when(traj_err != 0, err / F.when(traj_err != 0, traj_err))


def running_errors_3d(rows: DataFrame, keys: Sequence[str] = align.KEYS) -> DataFrame:
    out = running_errors(rows, _AVERAGED_3D, ("measured_delay",), keys)
    return out.withColumn("path_ratio", path_ratio(F.col("avg_err3d"), F.col("avg_traj_err_3d")))


def final_errors_3d(rows: DataFrame, keys: Sequence[str] = align.KEYS) -> DataFrame:
    scored = rows.where(F.col("err3d").isNotNull())
    out = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"avg_{c}") for c in _AVERAGED_3D],
        F.max("measured_delay").alias("max_measured_delay"),
    )
    return out.withColumn("path_ratio", path_ratio(F.col("avg_err3d"), F.col("avg_traj_err_3d")))
