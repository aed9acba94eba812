"""Mixing sources to target weights by Pfair scheduling.

Every source's rows, in a seeded random order, form blocks. With weight w, block k
(from 1) is released at slot floor((k-1)/w) and due at slot ceil(k/w); of the
released blocks the one due first takes a slot. Weights are the target weights
themselves, as whole parts of ``period`` (1e-12 each), and all blocks there are get
their slots on the driver (eight bytes a block). After any number of slots a source
that still has rows has had its target share within less than one block.

No row is dropped or repeated. A source that runs out leaves its later slots empty;
the others keep their relative rates. ``position`` numbers the rows in slot order.

One source may hold most rows: it is ranked in buckets of about ``bucket_rows``
rows, with the bucket counts added up, never in one task.

Defined results: a NULL source is a source; a source that has no positive
target weight gets the smallest of the given ones; equal rows take different
positions and are interchangeable; columns named block, slot or position in the
input are replaced, others kept; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagtrack.llm.common import free_name, starts_of

BLOCK_ROWS, PERIOD, BUCKET_ROWS, MAX_SOURCES, TEMPER = 16, 10**12, 2_000, 10_000, 0.7


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole shares of ``period`` nearest to the weights (largest remainders first), at least one each."""
    total = sum(map(Fraction, weights.values()))
    exact = {s: Fraction(w) * period / total for s, w in weights.items()}
    out = {s: math.floor(x) for s, x in exact.items()}
    rest = period - sum(out.values())
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[:rest]:
        out[s] += 1
    for s in [s for s, n in out.items() if n == 0]:
        out[max(out, key=lambda x: (out[x], x))] -= 1
        out[s] = 1
    return out


def schedule(share: dict[str, int], blocks: dict[str, int] | None = None) -> dict[str, array]:
    """Slots of each source's blocks (without ``blocks`` those of one period): earliest due block first among the released."""
    period = sum(share.values())
    blocks = share if blocks is None else blocks
    waiting = [(0, s, 1) for s in sorted(share) if blocks[s]]  # (release, source, block)
    heapq.heapify(waiting)
    due: list[tuple[int, str, int]] = []
    slots = {s: array("q") for s in share}
    slot = 0
    while waiting or due:
        if not due:  # slots of sources that have run out
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(due, (-(-k * period // share[s]), s, k))
        _, s, k = heapq.heappop(due)
        slots[s].append(slot)
        if k < blocks[s]:
            heapq.heappush(waiting, (k * period // share[s], s, k + 1))
        slot += 1
    return slots


def tempered(counts: dict[str, int], power: float = TEMPER) -> dict[str, float]:
    """Target weights between the natural ones (1) and equal ones (0)."""
    return {s: n**power for s, n in counts.items()}


def mixed(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    source: str = "source",
    block_rows: int = BLOCK_ROWS,
    period: int = PERIOD,
    seed: int = 29,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``docs`` with block (from 0 in its source), slot and position.

    ``weights`` are per source; without them the row counts to the power ``TEMPER`` are used.
    """
    docs = docs.drop("block", "slot", "position")
    own = docs.columns
    key, h, bucket, rank = (free_name(docs, x) for x in ("_key", "_h", "_bucket", "_rank"))
    named = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("-"))
    counts = {r[0]: r[1] for r in docs.groupBy(named).count().limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if weights is None:
        target = tempered(counts)
    else:
        given = {"-" if s is None else f"={s}": w for s, w in weights.items() if w > 0}
        least = min(given.values(), default=1.0)
        target = {s: given.get(s, least) for s in counts}
    share = shares(target, max(period, len(target))) if target else {}
    plan = schedule(share, {s: -(-counts[s] // block_rows) for s in counts})
    table = [(s, i, -(-counts[s] // bucket_rows)) for i, s in enumerate(counts)]
    number, buckets = free_name(docs, "_source"), free_name(docs, "_buckets")
    sources = docs.sparkSession.createDataFrame(table, f"{key} string, {number} long, {buckets} long")
    row = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in own])
    # the table of sources is bounded by MAX_SOURCES
    rows = docs.withColumn(key, named).withColumn(h, row).join(F.broadcast(sources), key)
    rows = rows.withColumn(bucket, F.pmod(F.col(h), F.col(buckets)))
    sizes = rows.groupBy(key, bucket).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    first = free_name(docs, "_first")
    sizes = sizes.select(key, bucket, "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    inside = Window.partitionBy(key, bucket).orderBy(h)
    ranked = rows.withColumn(rank, F.row_number().over(inside) - 1)
    start, places, place = (free_name(docs, x) for x in ("_start", "_places", "_place"))
    blocks = _blocks(docs.sparkSession, [(counts[s], plan[s]) for s in counts], block_rows)
    placed = blocks.join(starts_of(blocks, "slot"), "slot").select(F.col("source").alias(number), "block", "slot", F.col("start").alias(start))
    # a bucket's blocks go to it as one list: the rows are dealt by bucket already and do not move again
    spans = sizes.join(F.broadcast(sources), key).withColumn("block", F.explode(F.sequence(F.expr(f"{first} div {block_rows}L"), F.expr(f"({first} + n - 1) div {block_rows}L"))))
    spans = spans.join(placed, [number, "block"]).groupBy(key, bucket, first)
    spans = spans.agg(F.array_sort(F.collect_list(F.struct("block", "slot", start))).alias(places))
    out = ranked.join(spans, [key, bucket]).withColumn(rank, F.col(rank) + F.col(first))
    out = out.withColumn(place, F.get(places, F.expr(f"cast({rank} div {block_rows}L - {first} div {block_rows}L as int)")))
    position = F.col(f"{place}.{start}") + F.expr(f"{rank} % {block_rows}L")
    return out.select(*[F.col(f"`{c}`") for c in own], f"{place}.block", f"{place}.slot", position.alias("position"))


def _blocks(spark: SparkSession, plan: list[tuple[int, array]], block_rows: int) -> DataFrame:
    """source (its place in ``plan``), block, slot and rows ``n`` of every block, from each source's rows and slots."""
    columns: dict[str, list[np.ndarray]] = {"source": [], "block": [], "slot": [], "n": []}
    for i, (rows, slots) in enumerate(plan):
        block = np.arange(len(slots), dtype=np.int64)
        values = (np.full(len(slots), i, np.int64), block, np.frombuffer(slots, np.int64), np.minimum(block_rows, rows - block * block_rows))
        for name, value in zip(columns, values, strict=True):
            columns[name].append(value)
    none = [np.empty(0, np.int64)]
    return spark.createDataFrame(pa.table({name: np.concatenate(none + parts) for name, parts in columns.items()}))


def in_order(docs: DataFrame, **options) -> DataFrame:
    """All rows of ``docs`` and only its columns, sorted into mixing order (files in name order, rows in file order)."""
    rows = mixed(docs, **options)
    return rows.orderBy("position").select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("block", "slot", "position")])


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The written result of ``in_order``, read again, with ``name``: each row's place in it (gapless from 0)."""
    file, row = free_name(docs, "_file"), free_name(docs, "_row")
    rows = docs.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))
    first, table = 0, []
    for f, n in sorted(rows.groupBy(file).count().collect()):  # a row per file, as in Spark's own list of the files
        table.append((f, first))
        first += n
    start = free_name(docs, "_start")
    starts = docs.sparkSession.createDataFrame(table, f"{file} string, {start} long")
    return rows.join(F.broadcast(starts), file).withColumn(name, F.col(start) + F.col(row)).drop(file, row, start)
