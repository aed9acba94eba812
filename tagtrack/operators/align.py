"""Long range rows to one row per tick with one distance column per anchor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtrack import constants as K
from tagtrack.operators import scan

KEYS = ("run_id", "tag_id")


def dist_col(anchor_id: int) -> str:
    return f"d{anchor_id}"


def smooth_col(anchor_id: int) -> str:
    return f"s{anchor_id}"


def latest_per_anchor(ranges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Newest range of each anchor, of equal stamps the last arrival; ``max_by`` keeps the combine on the map side."""
    return ranges.groupBy(*keys, "anchor_id").agg(
        F.max("t").alias("t"),
        F.max_by("distance_cm", F.struct("t", "arrival")).alias("distance_cm"),
        F.count(F.lit(1)).alias("n"),
    )


def event_ticks(ranges: DataFrame, anchor_ids: Sequence[int], keys: Sequence[str] = KEYS, width: float = scan.CHUNK_S):
    """One row per distinct stamp, one distance column per anchor.

    Repeats of an anchor within a stamp reduce to the last arrival on the map
    side.
    """
    last = [
        F.max_by(
            F.when(F.col("anchor_id") == a, F.col("distance_cm")), F.when(F.col("anchor_id") == a, F.col("arrival"))
        ).alias(dist_col(a))
        for a in sorted(anchor_ids)
    ]
    ticks = ranges.where(F.col("anchor_id").isin(*anchor_ids)).groupBy(*keys, "t").agg(*last)
    return scan.with_chunk(ticks, "t", width)


def with_dt(ticks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add ``dt``, the time since the previous tick of the key (NULL on the first)."""
    prev = scan.with_previous(ticks.withColumn("_t", F.col("t")), keys, "t", ["_t"], "prev")
    return prev.withColumn("dt", F.col("t") - F.col("prev_t")).drop("_t", "prev_t")


def tick_grid(
    ranges: DataFrame, hz: float = K.TICK_HZ, hold_s: float = 0.0, keys: Sequence[str] = KEYS, width: float = scan.CHUNK_S
) -> DataFrame:
    """A regular clock per key from its first range to ``hold_s`` past its last.

    Only the bounds of a key are aggregated; ticks are generated chunk by chunk
    after the chunks have been spread over the cluster.  The number of partitions
    is given, or the small rows before the ticks would be merged into one task.
    """
    span = ranges.groupBy(*keys).agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    per_chunk = int(width * hz)
    first = F.ceil(F.col("_a") * F.lit(hz)).cast("long")
    last = F.floor((F.col("_b") + F.lit(hold_s)) * F.lit(hz)).cast("long")
    blocks = (
        span.select(*keys, first.alias("_i"), last.alias("_j"))
        .where("_i <= _j")
        .withColumn("_k", F.explode(F.expr(f"sequence(_i div {per_chunk}, _j div {per_chunk})")))
        .repartition(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_k")
    )
    low = F.greatest(F.col("_i"), F.col("_k") * per_chunk)
    high = F.least(F.col("_j"), F.col("_k") * per_chunk + (per_chunk - 1))
    ticks = blocks.select(*keys, F.explode(F.sequence(low, high)).alias("tick"))
    return ticks.select(*keys, "tick", (F.col("tick") / F.lit(float(hz))).alias("t"), F.lit(1.0 / hz).alias("dt"))


def hold(
    ranges: DataFrame,
    ticks: DataFrame,
    anchor_ids: Sequence[int],
    max_age_s: float = K.MAX_AGE_S,
    keys: Sequence[str] = KEYS,
    width: float = scan.CHUNK_S,
) -> DataFrame:
    """For each tick and anchor, the last arrival no older than ``max_age_s`` (inclusive).

    An as-of join as union plus window.  A range reaches at most ``max_age_s``
    ahead, so it is copied into the chunks it can reach and no state has to
    cross a chunk border.  Adds ``d<n>`` and its age ``age<n>`` per anchor.
    """
    keys = list(keys)
    extra = [c for c in ticks.columns if c not in (*keys, "t", scan.CHUNK)]
    reach = F.sequence(
        scan.chunk_of(F.col("t"), width), scan.chunk_of(F.col("t") + F.lit(float(max_age_s)), width)
    )
    arrivals = ranges.where(F.col("anchor_id").isin(*anchor_ids)).select(
        *keys, "t", F.explode(reach).alias(scan.CHUNK), F.lit(0).alias("_side"), "arrival", "anchor_id", "distance_cm"
    )
    clock = scan.with_chunk(ticks, "t", width).select(*keys, scan.CHUNK, "t", F.lit(1).alias("_side"), *extra)
    both = arrivals.unionByName(clock, allowMissingColumns=True)
    w = scan.chunk_window(keys, ["t", "_side", "arrival"])
    seen = [
        F.last(F.when(F.col("anchor_id") == a, F.struct("t", "distance_cm")), ignorenulls=True).over(w).alias(f"_h{a}")
        for a in sorted(anchor_ids)
    ]
    out = both.select("*", *seen).where("_side = 1")
    fresh = []
    for a in sorted(anchor_ids):
        age = F.col("t") - F.col(f"_h{a}.t")
        ok = age <= F.lit(float(max_age_s))
        fresh += [
            F.when(ok, F.col(f"_h{a}.distance_cm")).alias(dist_col(a)),
            F.when(ok, age).alias(f"age{a}"),
        ]
    return out.select(*keys, scan.CHUNK, "t", *extra, *fresh)


def hold_events(
    ticks: DataFrame,
    anchor_ids: Sequence[int],
    max_age_s: float = K.MAX_AGE_S,
    keys: Sequence[str] = KEYS,
    width: float = scan.CHUNK_S,
) -> DataFrame:
    """The same hold where the arrival stamps themselves are the ticks.

    Takes the rows of :func:`event_ticks`; arrivals and clock are one table, so
    there is no union: the end of a chunk is lent to the chunks it can reach.
    Adds ``f<n>``, the value that arrived on this tick, and makes ``d<n>`` the
    held one.
    """
    keys = list(keys)
    reach = F.sequence(F.col(scan.CHUNK), scan.chunk_of(F.col("t") + F.lit(float(max_age_s)), width))
    lent = ticks.withColumn("_own", F.col(scan.CHUNK)).withColumn(scan.CHUNK, F.explode(reach))
    w = scan.chunk_window(keys, ["t"])
    seen = [
        F.last(F.when(F.col(dist_col(a)).isNotNull(), F.struct("t", dist_col(a))), ignorenulls=True).over(w).alias(f"_h{a}")
        for a in sorted(anchor_ids)
    ]
    out = lent.select("*", *seen).where(F.col("_own") == F.col(scan.CHUNK))
    cols = []
    for a in sorted(anchor_ids):
        fresh = F.col("t") - F.col(f"_h{a}.t") <= F.lit(float(max_age_s))
        cols += [
            F.when(fresh, F.col(f"_h{a}.{dist_col(a)}")).alias(dist_col(a)),
            F.col(dist_col(a)).alias(f"f{a}"),
        ]
    return out.select(*keys, scan.CHUNK, "t", *cols)


def complete(anchor_ids: Sequence[int], col=dist_col) -> Column:
    """TRUE when every active anchor has a distance on this tick."""
    ok = F.lit(True)
    for a in anchor_ids:
        ok = ok & F.col(col(a)).isNotNull()
    return ok


def distance_map(anchor_ids: Sequence[int], col=dist_col) -> Column:
    pairs = F.array(*[F.struct(F.lit(a).alias("key"), F.col(col(a)).alias("value")) for a in sorted(anchor_ids)])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def status_text(anchor_ids: Sequence[int], ip: str = "0.0.0.0", port: int = K.UDP_PORT) -> Column:
    """Which active anchors are fresh on this tick."""
    seen = F.concat_ws(
        ", ", *[F.when(F.col(dist_col(a)).isNotNull(), F.lit(str(a))) for a in sorted(anchor_ids)]
    )
    head = f"udp {ip}:{port} - "
    # fixed values: status wording
    return F.when(seen == "", F.lit(head + "aucune distance recente")).otherwise(
        F.concat(F.lit(head + "ancres recues: "), seen)
    )


def packets(ticks: DataFrame, anchor_ids: Sequence[int], source: str = "udp", keys: Sequence[str] = KEYS) -> DataFrame:
    """Tick rows in packet form: distance map, completeness flag, source and status."""
    return ticks.select(
        *keys,
        "t",
        distance_map(anchor_ids).alias("raw"),
        complete(anchor_ids).alias("valid"),
        F.lit(source).alias("source"),
        status_text(anchor_ids).alias("status"),
    )


def complete_ticks(ranges: DataFrame, anchor_ids: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """Relational division on the long table: anchors seen per stamp and completeness."""
    # a set of at most the active anchors, which combines on the map side
    seen = F.size(F.collect_set("anchor_id"))
    return (
        ranges.where(F.col("anchor_id").isin(*anchor_ids))
        .groupBy(*keys, "t")
        .agg(seen.alias("n_anchors"))
        .withColumn("complete", F.col("n_anchors") == len(set(anchor_ids)))
    )


def with_run(df: DataFrame, keys: Sequence[str], order: Sequence[str], is_reset: Column) -> DataFrame:
    """Derive ``run_id`` from reset marks: the number of resets seen so far."""
    mark = F.when(is_reset, F.lit(1)).otherwise(F.lit(0))
    return scan.running(df, keys, order, {"run_id": ("sum", mark)})
