"""Device measurements over a stream of telemetry: the batch rule with a board's last counter as state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tagtrack import constants as K
from tagtrack.operators.quality import BOARD
from tagtrack.streaming.reorder import in_order


class FirstLines:
    """Passes on the lines whose counter differs from the board's line before."""

    reads, state, adds = ("cb",), "seen boolean, cb long", ""

    def start(self) -> tuple:
        return False, None

    def apply(self, state: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple | None]]:
        seen, before = state
        news: list[tuple | None] = []
        for (cb,) in rows:
            news.append(None if seen and cb == before else ())
            seen, before = True, cb
        return (seen, before), news


def first_of_repeats(telemetry: DataFrame, ts: str = "ingest_ts", keys: Sequence[str] = BOARD, wait_s: float = K.MAX_AGE_S) -> DataFrame:
    """First line of every measurement of a board, restarts and standing counters included, as in batch.

    Lines are put in order first; those that are too late for it come with ``late`` set, for a table of their own.
    """
    return in_order(telemetry, keys, ts, FirstLines(), wait_s)
