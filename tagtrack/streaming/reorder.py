"""Rows of a key in order of their stamps, over a stream that brings them late and mixed up.

A reorder buffer in state: rows of a key are held until a row of the same key is ``wait_s`` newer, and
then handed in order of (stamp, arrival) to a *rule* that keeps what it needs of the
rows before.  What comes after its place has been passed is not dropped: it comes out
marked ``late`` and takes no part.  As a key's own stamps decide, the result does not depend on
where the stream is cut into batches, and equals the batch job for rows that are at
most ``wait_s`` late.  A key that has fallen silent is released by an event-time timer
once the stream's watermark, ``forget`` behind, has passed its last stamp.

Keys are dealt over ``LANES`` lanes, and a lane is one key of the state store: a call and its
exchanges with the store cost milliseconds, which many keys with few rows share. A batch
reads and writes the state of all keys of the lanes that it touches.

A key is held by one task; ``maxFilesPerTrigger`` or offsets bound what a batch brings of it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tagtrack import constants as K
from tagtrack.session import ROCKSDB

ORDER = ["order_us", "order_arrival"]


#: state store keys that keys are dealt over; part of a running stream's state, so it stays as it is
LANES = 1024


def lane_of(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(LANES))


class Rule(Protocol):
    """What happens to the rows of a key in order: ``reads`` are the columns it looks at, ``state`` is the schema of what it keeps, ``adds`` of the columns it gives."""

    reads: tuple[str, ...]
    state: str
    adds: str

    def start(self) -> tuple: ...

    def apply(self, state: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple | None]]:
        """The state after the rows (of the columns read), and for each row what it adds, or None where the row does not go on."""


class InOrder(StatefulProcessor):
    def __init__(self, columns: Sequence[str], keys: Sequence[str], schema: str, key_schema: str, wait_us: int, rule: Rule) -> None:
        self.columns, self.schema, self.key_schema, self.wait_us, self.rule = list(columns), schema, key_schema, wait_us, rule
        # a missing value turns a batch's integers into floats, which the state would not take
        self.whole = [f.strip().split()[-1] in ("tinyint", "smallint", "int", "bigint", "long") for f in schema.split(",")]
        self.added = [f.split()[0] for f in rule.adds.split(", ")] if rule.adds else []
        self.key = [self.columns.index(k) for k in keys]
        self.us, self.arrival = (self.columns.index(c) for c in ORDER)
        self.read = [self.columns.index(c) for c in rule.reads]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # of a lane: held rows of all its keys, a row per key with its clock, and in the same order one with what the rule keeps
        self.held = handle.getListState("held", self.schema)
        self.clocks = handle.getListState("clocks", f"{self.key_schema}, top long, passed_us long, passed_arrival long")
        self.kept = handle.getListState("kept", self.rule.state)
        self.timer = handle.getValueState("timer", "timer_ms long")

    def _loaded(self) -> tuple[dict, dict, int | None]:
        """key -> [clock, kept], key -> held rows in order, and the lane's timer."""
        boards: dict[tuple, list] = {}
        held: dict[tuple, list[tuple]] = {}
        n = len(self.key)
        if self.clocks.exists():
            for c, k in zip(self.clocks.get(), self.kept.get(), strict=True):
                boards[tuple(c)[:n]] = [tuple(c)[n:], tuple(k)]
        if self.held.exists():
            for r in map(tuple, self.held.get()):
                held.setdefault(tuple(r[i] for i in self.key), []).append(r)
        return boards, held, self.timer.get()[0] if self.timer.exists() else None

    def _stored(self, boards: dict, held: dict, timer: int | None) -> None:
        """The lane's state; its timer is due with the first of its keys that falls silent."""
        self.clocks.put([(*key, *clock) for key, (clock, _) in boards.items()])
        self.kept.put([kept for _, kept in boards.values()])
        if held:
            self.held.put([r for rows in held.values() for r in rows])
        elif self.held.exists():
            self.held.clear()
        due = min((self._due(rows) for rows in held.values()), default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
            self.timer.update((due,))

    def _due(self, rows: list[tuple]) -> int:
        return rows[-1][self.us] // 1000 + 1

    def _released(self, board: list, rows: list[tuple]) -> list[tuple]:
        """Rows of a key that are handed to the rule, as they come out; the board's clock and what the rule keeps move on."""
        (top, _, _), kept = board
        kept, added = self.rule.apply(kept, [tuple(r[i] for i in self.read) for r in rows])
        board[:] = (top, rows[-1][self.us], rows[-1][self.arrival]), kept
        return [(*r, *a, False) for r, a in zip(rows, added, strict=True) if a is not None]

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        # objects: a missing integer must not turn its column into floats
        return pd.DataFrame(rows, columns=[*self.columns, *self.added, "late"], dtype=object)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        boards, held, timer = self._loaded()
        out, fresh = [], set()
        for part in rows:
            part = part.iloc[:, : len(self.columns)].astype(object)  # by place: names may arrive altered
            for r in part.where(part.notna(), None).itertuples(index=False, name=None):
                r = tuple(int(v) if w and v is not None else v for v, w in zip(r, self.whole, strict=True))
                k = tuple(r[i] for i in self.key)
                if k not in boards:
                    boards[k] = [(None, None, None), self.rule.start()]
                (top, passed_us, passed_arrival), kept = boards[k]
                us = r[self.us]
                if passed_us is not None and (us, r[self.arrival]) <= (passed_us, passed_arrival):
                    out.append((*r, *[None] * len(self.added), True))
                else:
                    held.setdefault(k, []).append(r)
                    fresh.add(k)
                    boards[k][0] = us if top is None else max(top, us), passed_us, passed_arrival
        for k in fresh:
            mine = sorted(held.pop(k), key=lambda r: (r[self.us], r[self.arrival]))
            until = boards[k][0][0] - self.wait_us
            n = bisect_right(mine, until, key=lambda r: r[self.us])
            if n:
                out += self._released(boards[k], mine[:n])
            if n < len(mine):
                held[k] = mine[n:]
        self._stored(boards, held, timer)
        yield self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Rows of the lane's keys that the watermark has passed; the timer that called is gone."""
        boards, held, timer = self._loaded()
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        now = max(now, timerValues.getCurrentWatermarkInMs())
        for k in [k for k, rows in held.items() if self._due(rows) <= now]:
            out += self._released(boards[k], held.pop(k))
        self._stored(boards, held, None)
        if not held:
            self.timer.clear()
        yield self._frame(out)

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, keys: Sequence[str], ts: str, rule: Rule, wait_s: float = K.MAX_AGE_S, forget: str = "1 hour") -> DataFrame:
    """The rows that ``rule`` lets through, with its columns, and the late ones; ``late`` tells which.

    ``arrival`` orders equal stamps where there is one.  Rows without a stamp have no place and are left out;
    rows that are later than ``forget`` are dropped by the watermark, and counted in the query's progress.
    """
    plain = [f for f in rows.schema.fields if f.name != ts]
    if any(f.dataType.typeName() not in ("byte", "short", "integer", "long", "float", "double", "string", "boolean") for f in plain):
        raise ValueError("beside the stamp only numbers, texts and booleans are kept")
    names = [f.name for f in plain]
    arrival = F.coalesce(F.col("arrival").cast("long"), F.lit(0)) if "arrival" in names else F.lit(0)
    fed = rows.where(F.col(ts).isNotNull()).withWatermark(ts, forget)
    lane = "lane"
    while lane in rows.columns:
        lane += "_"
    fed = fed.select(*names, F.unix_micros(ts).alias(ORDER[0]), arrival.cast("long").alias(ORDER[1]), ts, lane_of(keys).alias(lane))
    kinds = {f.name: f.dataType.simpleString() for f in plain}
    schema = ", ".join([f"`{c}` {kind}" for c, kind in kinds.items()] + [f"{c} long" for c in ORDER])
    key_schema = ", ".join(f"key_{i} {kinds[k]}" for i, k in enumerate(keys))
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = fed.groupBy(lane).transformWithStateInPandas(
        statefulProcessor=InOrder([*names, *ORDER], keys, schema, key_schema, round(wait_s * 1e6), rule),
        outputStructType=", ".join([schema, *([rule.adds] if rule.adds else []), "late boolean"]),
        outputMode="Append",
        timeMode="EventTime",
    )
    return out.withColumn(ts, F.timestamp_micros(ORDER[0])).drop(*ORDER)
