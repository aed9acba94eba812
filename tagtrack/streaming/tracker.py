"""Stateful positioning of each tag over a stream of ranges.

The streaming counterpart of the event-mode planar job: per (run, tag) it keeps
the latest and smoothed distance of each anchor, the smoothed position and the
player totals.  One state row per tag; rows of a micro-batch are taken in
(t, arrival) order, and the source options bound how many there are.  Tags are
dealt over lanes (:mod:`tagtrack.streaming.reorder`): a call and its exchanges with
the state store cost milliseconds, which the tags of a lane share.  The tags of a lane
advance together over arrays; only the filters and sums go from tick to tick, in order.

The clock never runs back: rows older than the tag's open stamp are counted as
late and leave the track alone.  The last stamp stays open: its rows are kept in
the state, and rows of it that come with a later micro-batch give its tick again,
from the state before it and with a higher ``n_ranges``.  Per (tag, t) the row with
most ranges is the final one, wherever the batches are cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tagtrack import constants as K
from tagtrack.functions.geometry import decay_rate
from tagtrack.operators import solve2d
from tagtrack.session import ROCKSDB
from tagtrack.streaming.reorder import lane_of

#: of a tag, what :func:`_record` describes and the rows of its open stamp, as bytes: a row of the store costs little
STATE = "run_id long, tag_id long, touched_ms long, held binary, open binary"
OUTPUT = (
    "run_id long, tag_id long, t double, x_raw double, y_raw double, x double, y double, samples long, "
    "distance_cm double, speed_sum_cm_s double, max_speed_cm_s double, n_ranges long, late long"
)
FED = ["run_id", "tag_id", "t", "arrival", "anchor_id", "distance_cm"]
NEVER = -math.inf
OPEN = np.dtype([("anchor", "i8"), ("distance", "f8"), ("arrival", "i8")])


def _record(n: int) -> np.dtype:
    """State of a tag of ``n`` anchors before its open stamp; NaN stands for no time."""
    whole = [(f, "i8") for f in ("has_pos", "samples", "late")]
    real = [(f, "f8") for f in ("last_t", "x", "y", "path", "speeds", "top", "open_t")]
    return np.dtype([*whole, *real, *((f, "f8", (n,)) for f in ("value", "seen", "ema"))])


def _summed(parts: Sequence[np.ndarray]) -> np.ndarray:
    """Compensated sums, as Python's ``sum`` gives of floats."""
    total, lost = np.zeros(len(parts[0])), np.zeros(len(parts[0]))
    for v in parts:
        after = total + v
        lost += np.where(np.abs(total) >= np.abs(v), (total - after) + v, (v - after) + total)
        total = after
    return total + lost


def _folded(keep: np.ndarray, add: np.ndarray) -> np.ndarray:
    """y of y = keep * y + add, row by row; where ``keep`` is 0 a tag begins anew."""
    out, y = [], 0.0
    for k, a in zip(keep.tolist(), add.tolist()):
        y = k * y + a if k else a
        out.append(y)
    return np.array(out, float)


def _highest(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The highest value so far, anew at every ``first``."""
    out, y = [], 0.0
    for f, v in zip(first.tolist(), values.tolist()):
        y = v if f or v > y else y
        out.append(y)
    return np.array(out, float)


class TagTracker(StatefulProcessor):
    def __init__(
        self,
        layout: solve2d.Layout,
        alpha_dist: float,
        alpha_pos: float,
        max_age_s: float = K.MAX_AGE_S,
        ttl_ms: int | None = None,
    ) -> None:
        self.ids = sorted(layout)
        self.solved = solve2d.layout_weights(layout)
        self.rates = decay_rate(alpha_dist), decay_rate(alpha_pos)
        self.max_age_s = max_age_s
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("tags", STATE, ttlDurationMs=self.ttl_ms)

    def _position(self, dist: Sequence[np.ndarray], usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x, y of the ticks that are usable, NaN elsewhere."""
        if self.solved is None:
            return np.full(len(usable), np.nan), np.full(len(usable), np.nan)
        weights, const = self.solved
        at = (const[axis] + _summed([weights[a][axis] * d * d for a, d in zip(self.ids, dist)]) for axis in (0, 1))
        return tuple(np.where(usable, v, np.nan) for v in at)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms else 0
        tags = {tuple(s)[:2]: tuple(s)[2:] for s in self.state.get()} if self.state.exists() else {}
        if self.ttl_ms:  # of the lane, the tags that have been silent for long
            tags = {k: s for k, s in tags.items() if s[0] + self.ttl_ms > now}
        part = pd.concat(list(rows), ignore_index=True).iloc[:, : len(FED)]
        part.columns = FED
        run, tag = part["run_id"].to_numpy(np.int64), part["tag_id"].to_numpy(np.int64)
        order = np.lexsort((tag, run))
        run, tag = run[order], tag[order]
        first = np.concatenate([[True], (np.diff(run) != 0) | (np.diff(tag) != 0)])
        group, begins = np.cumsum(first) - 1, np.flatnonzero(first)
        at = list(zip(run[begins].tolist(), tag[begins].tolist()))
        own = part["anchor_id"].isin(self.ids).to_numpy()[order]
        kinds = (("t", float), ("anchor_id", np.int64), ("distance_cm", float), ("arrival", np.int64))
        columns = [part[c].to_numpy(kind)[order][own] for c, kind in kinds]
        held, opened, ticks = self._advanced([tags.get(k) for k in at], group[own], *columns)
        size = held.dtype.itemsize
        whole = held.tobytes()
        for i, k in enumerate(at):
            tags[k] = (now, whole[i * size : (i + 1) * size], opened[i])
        self.state.put([(*k, *s) for k, s in tags.items()])
        of = ticks.pop(0)
        ids = [run[begins][of], tag[begins][of]]
        yield pd.DataFrame(dict(zip([f.split()[0] for f in OUTPUT.split(", ")], [*ids, *ticks])))

    def _advanced(
        self, states: list[tuple | None], group: np.ndarray, t: np.ndarray, anchor: np.ndarray, distance: np.ndarray, arrival: np.ndarray
    ) -> tuple[np.ndarray, list[bytes], list[np.ndarray]]:
        """State and open rows of each tag of a lane after the rows of a batch, and the ticks that these rows give, column by column.

        All tags advance together over one table of ticks, in which a tag's ticks stand in order behind a row that has its state.
        """
        n, kind = len(self.ids), _record(len(self.ids))
        blank = np.zeros(1, kind)
        for f, v in (("last_t", np.nan), ("open_t", np.nan), ("seen", NEVER)):
            blank[f] = v
        fresh = blank.tobytes()
        s = np.frombuffer(b"".join(fresh if x is None else bytes(x[1]) for x in states), kind).copy()
        opened = [b"" if x is None else bytes(x[2]) for x in states]
        late = t < s["open_t"][group]
        s["late"] += np.bincount(group[late], minlength=len(s))
        group, t, anchor, distance, arrival = (v[~late] for v in (group, t, anchor, distance, arrival))
        # the rows of the open stamps once more, before whatever came now
        again = np.frombuffer(b"".join(opened), OPEN)
        of = np.repeat(np.arange(len(s)), [len(b) // OPEN.itemsize for b in opened])
        new = np.concatenate([np.zeros(len(of), bool), np.ones(len(t), bool)])
        group, t = np.concatenate([of, group]), np.concatenate([s["open_t"][of], t])
        rows = np.empty(len(t), OPEN)
        for f, v in zip(OPEN.names, (anchor, distance, arrival)):
            rows[f] = np.concatenate([again[f], v])
        order = np.lexsort((rows["arrival"], t, group))
        group, t, new, rows = group[order], t[order], new[order], rows[order]
        if not len(t):
            return s, opened, [np.empty(0, np.int64), *(np.empty(0) for _ in range(8)), *(np.empty(0, np.int64) for _ in range(2))]

        begins = np.flatnonzero(np.concatenate([[True], (np.diff(group) != 0) | (np.diff(t) != 0)]))
        ends = np.concatenate([begins[1:], [len(t)]])
        tick = np.repeat(np.arange(len(begins)), ends - begins)
        owner, is_new = group[begins], np.logical_or.reduceat(new, begins)
        first = np.concatenate([[True], np.diff(owner) != 0])
        seed = np.flatnonzero(first) + np.arange(first.sum())  # a tag's state, then its ticks
        at = np.arange(len(begins)) + np.cumsum(first)
        total, tags = len(at) + len(seed), owner[first]
        is_seed = np.zeros(total, bool)
        is_seed[seed] = True

        def laid(states: np.ndarray, ticks: np.ndarray | float) -> np.ndarray:
            out = np.empty(total, np.result_type(states, ticks))
            out[seed], out[at] = states[tags], ticks
            return out

        def before(v: np.ndarray) -> np.ndarray:
            return np.concatenate([v[:1], v[:-1]])

        time = laid(s["last_t"], t[begins])
        dt = time - before(time)
        moves = ~is_seed & (dt > 0)
        keep_d, keep_p = (np.exp(-r * np.where(moves, dt, 1.0 / K.TICK_HZ)) for r in self.rates)
        value, seen, ema = [], [], []
        for i, a in enumerate(self.ids):
            mine = rows["anchor"] == a
            told, has = laid(s["value"][:, i], 0.0), is_seed.copy()
            told[at[tick[mine]]] = rows["distance"][mine]  # the last of a stamp stays
            has[at[tick[mine]]] = True
            source = np.maximum.accumulate(np.where(has, np.arange(total), 0))
            value.append(told[source])
            seen.append(np.where(is_seed, laid(s["seen"][:, i], 0.0), time)[source])
            begun = before(seen[i]) != NEVER
            keep = np.where(is_seed, 0.0, np.where(has, np.where(begun, keep_d, 0.0), 1.0))
            add = np.where(is_seed, laid(s["ema"][:, i], 0.0), np.where(has, np.where(begun, (1.0 - keep_d) * told, told), 0.0))
            ema.append(_folded(keep, add))
        known = np.logical_and.reduce([v != NEVER for v in seen]) & (self.solved is not None)
        raw = self._position(value, np.logical_and.reduce([time - v <= self.max_age_s for v in seen]))
        fine = self._position(ema, known)
        placed = laid(s["has_pos"], 0).astype(bool)
        placed[at] = known[at] | s["has_pos"][owner].astype(bool)
        had = before(placed)
        x, y = (
            _folded(
                np.where(is_seed, 0.0, np.where(known, np.where(had, keep_p, 0.0), 1.0)),
                np.where(is_seed, laid(s[f], 0.0), np.where(known, np.where(had, (1.0 - keep_p) * v, v), 0.0)),
            )
            for f, v in zip("xy", fine)
        )
        counted = np.cumsum(np.where(is_seed, 0, placed))
        counted += np.repeat(s["samples"][tags] - counted[seed], np.diff([*seed, total]))
        step = np.where(moves & placed & had, np.hypot(x - before(x), y - before(y)), 0.0)
        speed = step / np.where(moves, dt, 1.0)
        on = np.where(is_seed, 0.0, 1.0)
        path, speeds = (_folded(on, np.where(is_seed, laid(s[f], 0.0), v)) for f, v in (("path", step), ("speeds", speed)))
        top = _highest(is_seed, np.where(is_seed, laid(s["top"], 0.0), speed))

        out = at[is_new]
        here = [np.where(placed, v, np.nan)[out] for v in (x, y)]
        ticks = [owner[is_new], time[out], raw[0][out], raw[1][out], *here, counted[out], path[out], speeds[out], top[out]]
        ticks += [(ends - begins)[is_new], s["late"][owner[is_new]]]
        # the last stamp of a tag stays open: the state before it, and its rows
        last = np.concatenate([np.flatnonzero(first)[1:], [len(at)]]) - 1
        then = at[last] - 1
        for f, v in (("last_t", time), ("x", x), ("y", y), ("has_pos", placed), ("samples", counted), ("path", path), ("speeds", speeds), ("top", top)):
            s[f][tags] = v[then]
        for f, v in (("value", value), ("seen", seen), ("ema", ema)):
            s[f][tags] = np.stack([c[then] for c in v], axis=1)
        s["open_t"][tags] = time[at[last]]
        for g, a, b in zip(tags.tolist(), begins[last].tolist(), ends[last].tolist()):
            opened[g] = rows[a:b].tobytes()
        return s, opened, ticks

    def close(self) -> None:
        pass


def track(
    ranges: DataFrame,
    layout: solve2d.Layout,
    settings: Mapping[str, float] | None = None,
    ttl_ms: int | None = None,
) -> DataFrame:
    """Position and totals after every tick of a stream of ranges; a tick may come again with more ranges."""
    use = {**K.default_settings("2d"), **(settings or {})}
    ranges.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    fed = ranges.select(*FED, lane_of(["run_id", "tag_id"]).alias("lane"))
    return fed.groupBy("lane").transformWithStateInPandas(
        statefulProcessor=TagTracker(layout, use["alpha_dist"], use["alpha_pos"], ttl_ms=ttl_ms),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )


def final_ticks(rows: DataFrame) -> DataFrame:
    """The last word on every tick of a written track."""
    rest = [c for c in rows.columns if c not in ("run_id", "tag_id", "t")]
    return rows.groupBy("run_id", "tag_id", "t").agg(*[F.max_by(c, "n_ranges").alias(c) for c in rest])
