"""Device times over a stream of telemetry: a board's clock is fitted as its lines come in."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from tagtrack import constants as K
from tagtrack.operators import clock
from tagtrack.operators.quality import BOARD
from tagtrack.streaming.reorder import in_order


class BoardClock:
    """The envelope of the running boot, kept as the points of its lower hull, and the last time given.

    A line's time is read off the envelope of the lines so far, so it is at most the least delay so far off; it never
    runs back, neither within a boot nor at a restart.
    """

    reads = "order_us", "ms", "cb"
    state = "boot long, ms long, cb long, y double, n long, sum_x double, hull_x array<double>, hull_y array<double>, last_us long"
    adds = "boot long, device_us long"

    def start(self) -> tuple:
        return 0, None, None, 0.0, 0, 0.0, [], [], None

    def apply(self, state: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple | None]]:
        boot, ms, cb, y, n, sum_x, hull_x, hull_y, last = state
        timed: list[tuple | None] = []
        for us, new_ms, new_cb in rows:
            new_y = us / 1000 - new_ms
            if ms is not None and (new_ms < ms or new_cb < cb) and new_y - y > clock.LATE_MS:
                boot, n, sum_x, hull_x, hull_y = boot + 1, 0, 0.0, [], []
            ms, cb, y, n, sum_x = int(new_ms), int(new_cb), float(new_y), n + 1, sum_x + float(new_ms)
            x, h = np.append(hull_x, ms), np.append(hull_y, y)
            at = clock.lower_hull(x, h)
            hull_x, hull_y = x[at].tolist(), h[at].tolist()
            height, drift = clock.supporting(x[at], h[at], sum_x / n)
            sent = round((ms * (1 + drift) + height) * 1000)
            last = sent if last is None else max(last, sent)
            timed.append((boot, last))
        return (boot, ms, cb, y, n, sum_x, list(hull_x), list(hull_y), last), timed


def device_time(telemetry: DataFrame, ts: str = "ingest_ts", keys: Sequence[str] = BOARD, wait_s: float = K.MAX_AGE_S) -> DataFrame:
    """Complete device lines (ms and cb present) with ``boot`` and ``device_us``; late lines come with ``late`` and without a time."""
    return in_order(telemetry, keys, ts, BoardClock(), wait_s)
