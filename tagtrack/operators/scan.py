"""Ordered operators over keys of any size.

A tag may own a third of all rows, so no row-level window is partitioned by the
tag alone.  Time is cut into chunks; a window runs inside (key, chunk), each
chunk is summarised to one row, and a second window over those summaries says
what came before each chunk.  A key has one summary per chunk width of
recording (a minute by default: 1,440 for a day), however many rows it has.

Rows move once, by (key, chunk); later steps that keep this clustering reuse
the exchange.  Key columns and the order column must not be NULL: a row without
a tag or a time has no place in an ordered result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "chunk"
CHUNK_S = 60.0


def never_null(chunk: Column) -> Column:
    """Declare a chunk number as present.

    A nullable join key makes the optimizer filter one use of a table and not
    the other, and then the exchange below them can no longer be shared.
    """
    return F.coalesce(chunk.cast("long"), F.lit(0).cast("long"))


def chunk_of(t: Column, width: float) -> Column:
    return never_null(F.floor(t / F.lit(float(width))))


def with_chunk(df: DataFrame, t: str = "t", width: float = CHUNK_S) -> DataFrame:
    return df.withColumn(CHUNK, chunk_of(F.col(t), width))


def chunk_window(keys: Sequence[str], order: Sequence[str], chunk: str = CHUNK):
    """Frame from the start of the chunk to the current row."""
    return (
        Window.partitionBy(*keys, chunk)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def earlier_chunks(keys: Sequence[str], chunk: str = CHUNK):
    """Frame over the summaries of all earlier chunks of the key."""
    return Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)


def _neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Sequence[str],
    prefix: str,
    chunk: str,
    forward: bool,
) -> DataFrame:
    keys, columns = list(keys), list(columns)
    edge, shift = (F.min_by, F.lead) if forward else (F.max_by, F.lag)
    inside = Window.partitionBy(*keys, chunk).orderBy(order)
    across = Window.partitionBy(*keys).orderBy(chunk)
    # `seen` tells a NULL value of the neighbour from a missing neighbour
    rows = df.select(
        "*",
        *[shift(c).over(inside).alias(f"_in_{c}") for c in columns],
        shift(F.lit(True)).over(inside).alias("_seen"),
    )
    parts = df.groupBy(*keys, chunk).agg(*[edge(c, order).alias(f"_e_{c}") for c in columns])
    carry = parts.select(*keys, chunk, *[shift(f"_e_{c}").over(across).alias(f"_x_{c}") for c in columns])
    picked = [
        F.when(F.col("_seen"), F.col(f"_in_{c}")).otherwise(F.col(f"_x_{c}")).alias(prefix + c) for c in columns
    ]
    return rows.join(carry, [*keys, chunk]).select(*df.columns, *picked)


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Sequence[str],
    prefix: str = "prev_",
    chunk: str = CHUNK,
) -> DataFrame:
    """Add ``prev_*``: the given columns of the preceding row of the key."""
    return _neighbour(df, keys, order, columns, prefix, chunk, forward=False)


def with_next(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Sequence[str],
    prefix: str = "next_",
    chunk: str = CHUNK,
) -> DataFrame:
    """Add ``next_*``: the given columns of the following row of the key."""
    return _neighbour(df, keys, order, columns, prefix, chunk, forward=True)


def _add(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


# kind -> (aggregate of rows, aggregate of summaries, combination of both)
_KINDS = {
    "sum": (F.sum, F.sum, _add),
    "count": (F.count, F.sum, _add),
    "max": (F.max, F.max, F.greatest),
    "min": (F.min, F.min, F.least),
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: dict[str, tuple[str, Column]],
    chunk: str = CHUNK,
) -> DataFrame:
    """Running aggregates from the first row of the key to the current one.

    ``measures`` maps an output name to (kind, column); kinds are sum, count,
    max and min.  The summaries are plain aggregates, so they combine on the
    map side before anything is shuffled.
    """
    keys = list(keys)
    w, before = chunk_window(keys, order, chunk), earlier_chunks(keys, chunk)
    kinds = {n: _KINDS[k] for n, (k, _) in measures.items()}
    inputs = df.select("*", *[c.alias(f"_m_{n}") for n, (_, c) in measures.items()])
    rows = inputs.select("*", *[kinds[n][0](f"_m_{n}").over(w).alias(f"_w_{n}") for n in measures])
    parts = inputs.groupBy(*keys, chunk).agg(*[kinds[n][0](f"_m_{n}").alias(f"_p_{n}") for n in measures])
    carry = parts.select(*keys, chunk, *[kinds[n][1](f"_p_{n}").over(before).alias(f"_c_{n}") for n in measures])
    done = [kinds[n][2](F.col(f"_c_{n}"), F.col(f"_w_{n}")).alias(n) for n in measures]
    return rows.join(carry, [*keys, chunk]).select(*df.columns, *done)


def with_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "seq", chunk: str = CHUNK
) -> DataFrame:
    """Add the 1-based position of each row within its key."""
    return running(df, keys, order, {name: ("count", F.lit(1))}, chunk)
