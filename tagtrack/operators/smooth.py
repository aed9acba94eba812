"""Exponential smoothing without a loop.

With decay rate r = -60 ln(1 - alpha) the recurrence
``s = a x + (1 - a) s'``, ``1 - a = exp(-r dt)``, is linear in ``s'``.  Inside a
chunk it unrolls to a weighted running sum; a chunk as a whole is one map
``s -> exp(-decay) s + b``, so the state after a chunk is a sum over the few
earlier chunks that have not decayed to nothing.  A tick without a value
neither changes nor decays the state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtrack import constants as K
from tagtrack.functions.geometry import decay_rate
from tagtrack.operators import scan

# exp() stays finite while rate * chunk width is below this
MAX_EXPONENT = 500.0
# exp(-800) is 0: a longer gap forgets everything in any case
FORGET = 800.0
# exp(-40) is below the rounding of a double
NEGLIGIBLE = 40
OPEN = -1.0


def chunk_width(*alphas: float, widest: float = scan.CHUNK_S) -> float:
    """Widest chunk (s) for which the running weights of every factor stay finite."""
    rates = [decay_rate(a) for a in alphas]
    return min([widest] + [MAX_EXPONENT / r for r in rates if r > 0])


def smooth(
    df: DataFrame,
    keys: Sequence[str],
    columns: dict[str, str],
    alpha: float,
    dt: str | None = "dt",
    order: str = "t",
    chunk: str = scan.CHUNK,
) -> DataFrame:
    """Add a smoothed column per entry of ``columns`` (source -> new name).

    ``dt`` names the tick duration in seconds; with None it is the time since
    the previous tick and is added as column ``dt`` in the same pass.  A tick
    without a positive duration uses the unmodified factor, which is one
    reference tick.  Ticks of a key must be distinct, and chunks no wider than
    :func:`chunk_width`.
    """
    if not alpha > 0:
        raise ValueError("a factor of 0 never forgets: the state of a key would grow without bound")
    keys = list(keys)
    rate = decay_rate(alpha)
    w = scan.chunk_window(keys, [order], chunk)
    sources = list(columns)

    def decay(seconds: Column) -> Column:
        tick = F.when(seconds > 0, seconds).otherwise(F.lit(1.0 / K.TICK_HZ))
        return F.least(F.lit(rate) * tick, F.lit(FORGET))

    if dt is None:
        # the first tick of a chunk learns its duration from the summaries
        since = F.col(order) - F.lag(order).over(Window.partitionBy(*keys, chunk).orderBy(order))
        rows = df.withColumn("_dt", since).withColumn(
            "_step", F.when(F.col("_dt").isNull(), F.lit(OPEN)).otherwise(decay(F.col("_dt")))
        )
    else:
        rows = df.withColumn("_step", decay(F.col(dt)))

    # per source: first value x, its own decay f, decay c so far, weighted sum b
    first_pass, second_pass = [], []
    for i, src in enumerate(sources):
        step = F.when(F.col(src).isNotNull(), F.col("_step"))
        first_pass += [
            F.sum(F.greatest(step, F.lit(0.0))).over(w).alias(f"_c{i}"),
            F.first(step, ignorenulls=True).over(w).alias(f"_f{i}"),
            F.first(src, ignorenulls=True).over(w).alias(f"_x{i}"),
            F.count(src).over(w).alias(f"_n{i}"),
        ]
        inside = F.col(f"_c{i}") - F.greatest(F.col(f"_f{i}"), F.lit(0.0))
        gain = F.lit(1.0) - F.exp(-F.col("_step"))
        later = F.when(F.col(f"_n{i}") > 1, gain * F.col(src) * F.exp(inside))
        second_pass.append(F.coalesce(F.sum(later).over(w), F.lit(0.0)).alias(f"_b{i}"))
    rows = rows.select("*", *first_pass).select("*", *second_pass)

    def from_state(f: Column, i: int, before: Column) -> Column:
        """Smoothed value from the state before the chunk; ``f`` is the first decay."""
        inside = F.col(f"_c{i}") - F.greatest(F.col(f"_f{i}"), F.lit(0.0))
        head = (F.lit(1.0) - F.exp(-f)) * F.col(f"_x{i}") + F.exp(-f) * before
        return F.exp(-inside) * (F.col(f"_b{i}") + head)

    fields = ("c", "f", "x", "b")
    parts = rows.groupBy(*keys, chunk).agg(
        F.min(order).alias("_t0"),
        F.max(order).alias("_t1"),
        *[F.max_by(f"_{k}{i}", order).alias(f"_{k}{i}") for i in range(len(sources)) for k in fields],
    )
    by_key = Window.partitionBy(*keys).orderBy(chunk)
    parts = parts.withColumn("_pt", F.lag("_t1").over(by_key))
    # one summary row per source, so that every source decays on its own clock
    entry = [
        F.struct(F.lit(i).alias("i"), *[F.col(f"_{k}{i}").alias(k) for k in fields]) for i in range(len(sources))
    ]
    long = parts.select(*keys, chunk, "_t0", "_pt", F.explode(F.array(*entry)).alias("_e"))
    f = F.when(F.col("_e.f") < 0, decay(F.col("_t0") - F.col("_pt"))).otherwise(F.col("_e.f"))
    long = long.select(
        *keys, chunk, "_pt", "_e.i", F.col("_e.x").alias("_x0"), F.col("_e.b").alias("_b0"), f.alias("_f0"),
        (F.col("_e.c") - F.greatest(F.col("_e.f"), F.lit(0.0))).alias("_l0"),
    )
    track = Window.partitionBy(*keys, "i").orderBy(chunk)
    so_far = track.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_first = F.count("_x0").over(so_far) == 1
    a = F.exp(-F.col("_f0"))
    # starting from the first value makes that value pass through unchanged
    b = F.exp(-F.col("_l0")) * (
        F.col("_b0") + (F.lit(1.0) - a) * F.col("_x0") + F.when(is_first, a * F.col("_x0")).otherwise(F.lit(0.0))
    )
    # least() skips NULL, so a chunk without values is excluded by hand
    spent = F.when(F.col("_f0").isNotNull(), F.least(F.col("_f0") + F.col("_l0"), F.lit(FORGET)))
    long = long.select(
        "*",
        F.coalesce(F.sum(spent).over(so_far), F.lit(0.0)).alias("_age"),
        b.alias("_gain"),
    )
    recent = Window.partitionBy(*keys, "i").orderBy("_age").rangeBetween(-NEGLIGIBLE, 0)
    heard = F.collect_list(F.when(F.col("_gain").isNotNull(), F.struct("_age", "_gain"))).over(recent)
    state = F.aggregate(
        F.col("_heard"), F.lit(0.0), lambda s, e: s + e["_gain"] * F.exp(e["_age"] - F.col("_age"))
    )
    long = long.withColumn("_heard", heard).withColumn("_s", F.when(F.col("_gain").isNotNull(), state))
    before = F.last("_s", ignorenulls=True).over(track.rowsBetween(Window.unboundedPreceding, -1))
    long = long.select(*keys, chunk, "i", "_pt", "_f0", before.alias("_s0"))
    carry = long.groupBy(*keys, chunk).agg(
        F.first("_pt").alias("_pt"),
        *[F.max(F.when(F.col("i") == i, F.col(k))).alias(f"{k}_{i}") for i in range(len(sources)) for k in ("_f0", "_s0")],
    )

    out = rows.join(carry, [*keys, chunk])
    done = []
    for i, (src, new) in enumerate(columns.items()):
        old = F.col(f"_s0_{i}")
        here = from_state(F.col(f"_f0_{i}"), i, F.coalesce(old, F.col(f"_x{i}")))
        done.append(F.coalesce(here, old).alias(new))
    if dt is None:
        done.append(F.coalesce(F.col("_dt"), F.col(order) - F.col("_pt")).alias("dt"))
    return out.select(*df.columns, *done)
