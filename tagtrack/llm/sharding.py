"""Sharding by a two-pass external shuffle.

Pass one scatters the rows uniformly over buckets that fit a task's memory, by a
seeded hash of the row and, for equal rows, of the number of the copy. Pass two
brings every bucket into a fixed order and deals it by a Fisher-Yates shuffle whose
draws are hashes of (seed, bucket, step), so the deal depends on nothing but rows
and seed: not on partitions, and not on which task runs again. The buckets in
order give one random order of all rows, cut into shards of equal row counts. A
shard is a run of that order, so a bucket reaches one or two shards and is
written as it stands, without a third exchange.

Law ``rows``: shard sizes differ by one row at most. The bucket counts are the
only other state, a row per bucket. The work of a deal grows with the square of
the bucket, which is why buckets are small.

With ``order`` the rows have an order already that the shards must keep at large, such
as that of mixed sources: shards are runs of that order, and the rows of a shard
are scattered over the shard's own buckets, so all that it holds stays there.

Defined results: NULLs in any column hash like values; an empty table gives no
rows; equal rows take different slots, of as many buckets as other rows, and are
interchangeable among themselves; with fewer rows than shards some shards are
empty; columns named shard or slot in the input are replaced, all others come along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtrack.llm.common import starts_of

BUCKET_ROWS = 2_048
BUCKET_BYTES = 16 << 20


def sharded(
    docs: DataFrame,
    n_shards: int,
    seed: int = 17,
    row_bytes: Column | None = None,
    bucket_rows: int = BUCKET_ROWS,
    bucket_bytes: int = BUCKET_BYTES,
    order: str | None = None,
) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in the shard).

    A bucket has ``bucket_rows`` rows on average at most and, where ``row_bytes`` gives
    a row's size, ``bucket_bytes`` bytes: what one task can hold. ``order`` names a column
    that numbers the rows without gaps from 0; it is not in the result.
    """
    docs = docs.drop("shard", "slot")
    size = F.lit(0) if row_bytes is None else row_bytes
    total, volume = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    every, n_buckets = max(total, 1), max(1, math.ceil(total / bucket_rows), math.ceil(volume / bucket_bytes))
    shard = f"cast(((at + 1) * {n_shards}L - 1) div {every}L as int)"
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != order]).alias("row")
    if order is None:
        # equal rows meet as one row with their number before any of them moves
        rows = docs.select(row).groupBy("row").agg(F.count(F.lit(1)).alias("n"))
        rows = rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("at"))
        bucket = F.pmod(F.xxhash64(F.lit(seed), "row", "at"), F.lit(n_buckets))
    else:
        rows = docs.select(row, F.col(f"`{order}`").cast("long").alias("at"))
        per = math.ceil(n_buckets / n_shards)
        bucket = F.expr(shard) * F.lit(per).cast("long") + F.pmod(F.xxhash64(F.lit(seed), "at"), F.lit(per))
    rows = rows.withColumn("bucket", bucket)
    starts = starts_of(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket")
    hands = rows.groupBy("bucket").agg(F.collect_list(F.struct("at", "row")).alias("rows"))
    hands = hands.select("bucket", F.array_sort("rows").alias("rows"))
    hands = hands.select("bucket", "rows", _deal(F.col("bucket"), F.size("rows"), seed).alias("deal"))
    dealt = hands.join(starts, "bucket").select("start", F.posexplode(F.transform("deal", lambda i: F.get("rows", i))).alias("pos", "r"))
    placed = dealt.select("r.row", (F.col("start") + F.col("pos")).alias("at")).withColumn("shard", F.expr(shard))
    slot = F.expr(f"at - (shard * {every}L) div {n_shards}L")
    return placed.select("row.*", "shard", slot.alias("slot"))


def _deal(bucket: Column, n: Column, seed: int) -> Column:
    """0 to ``n`` - 1 by an inside-out Fisher-Yates shuffle: step i takes the place of an earlier one, which moves to the end."""

    def step(acc: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(F.lit(seed), bucket, i), (i + 1).cast("long")).cast("int")
        after = F.slice(acc, j + 2, F.greatest(i - j - 1, F.lit(0)))
        moved = F.concat(F.slice(acc, F.lit(1), j), F.array(i), after, F.array(F.get(acc, j)))
        return F.when(j == i, F.concat(acc, F.array(i))).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.array().cast("array<int>"), step)


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard; a bucket's part of a shard is one file in slot order. Shards are kept, so they are packed well."""
    placed.write.option("compression", "zstd").partitionBy("shard").parquet(path)
