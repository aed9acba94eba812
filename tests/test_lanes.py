"""Stateful streams deal their keys over lanes: one call holds the rows of many keys."""

import math
import sys
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from tagtrack.plans import queries as Q
from tagtrack.streaming import repeats, tracker
from tagtrack.streaming.reorder import InOrder


class Store:
    """The state of one lane, as the processors use it."""

    def __init__(self):
        self.timers, self.values = set(), {}

    def _state(self, name):
        values = self.values
        return SimpleNamespace(
            exists=lambda: name in values, get=lambda: values[name], put=lambda rows: values.update({name: list(rows)}),
            update=lambda row: values.update({name: row}), clear=lambda: values.pop(name, None),
        )

    def getListState(self, name, schema, ttlDurationMs=None):
        return self._state(name)

    def getValueState(self, name, schema, ttlDurationMs=None):
        return self._state(name)

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


def test_boards_of_a_lane_are_put_in_order_each_for_itself():
    columns = ["tag_id", "cb", "order_us", "order_arrival"]
    job = InOrder(columns, ["tag_id"], "tag_id bigint, cb bigint, order_us long, order_arrival long", "key_0 bigint", 2_000_000, repeats.FirstLines())
    store = Store()
    job.init(store)

    def given(rows):
        return pd.concat(job.handleInputRows((0,), iter([pd.DataFrame(rows, columns=columns)]), None))

    def second(tag, s, cb):
        return tag, cb, s * 1_000_000, 0

    got = given([second(tag, s, s // 2) for tag in (1, 2, 3) for s in (3, 1, 2, 0)] + [second(None, 0, 5)])
    assert sorted(zip(got["tag_id"], got["cb"])) == [(1, 0), (2, 0), (3, 0)] and not got["late"].any()
    got = given([second(2, 9, 4), second(3, 0, 7)])  # one board goes on, one line comes after its place
    assert list(zip(got["tag_id"], got["cb"], got["late"])) == [(3, 7, True), (2, 1, False)]
    assert store.timers == {1}  # the least of the lane: the board without a tag
    silent = SimpleNamespace(getExpiryTimeInMs=lambda: 1), SimpleNamespace(getCurrentWatermarkInMs=lambda: 5000)
    store.timers.clear()
    got = pd.concat(job.handleExpiredTimer((0,), silent[1], silent[0]))
    assert sorted(zip(got["tag_id"].isna(), got["cb"])) == [(False, 1), (False, 1), (True, 5)]
    assert store.timers == {9001} and [r[0] for r in store.values["held"]] == [2]


def test_tags_of_a_lane_are_tracked_each_for_itself_and_forgotten_alone():
    layout = {1: (0.0, 0.0), 2: (2800.0, 0.0), 3: (0.0, 1500.0)}
    rows = [(0, tag, 0.05 * i, 3 * i + a, a, math.dist((500.0 * tag, 600.0), layout[a])) for i in range(4) for tag in (1, 2) for a in layout]
    now = SimpleNamespace(ms=1000)
    clock = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now.ms)
    job = tracker.TagTracker(layout, 0.5, 0.5, ttl_ms=100)
    store = Store()
    job.init(store)

    def given(part):
        return pd.concat(job.handleInputRows((0,), iter([pd.DataFrame(part, columns=tracker.FED)]), clock))

    got = given(rows)
    assert len(got) == 8 and all(abs(r.x - 500.0 * r.tag_id) < 1e-6 and abs(r.y - 600.0) < 1e-6 for r in got.itertuples())
    now.ms = 1090
    given([(0, 2, 0.2, 99, 1, 5.0)])
    now.ms = 1150
    given([(0, 3, 0.2, 99, 1, 5.0)])
    assert [r[1] for r in store.values["tags"]] == [2, 3]  # tag 1 has been silent for longer than its time to live


def test_ticks_of_a_lane_cost_no_calls_of_their_own():
    layout = {1: (0.0, 0.0), 2: (2800.0, 0.0), 3: (0.0, 1500.0)}

    def calls(ticks):
        rows = [(0, tag, 0.05 * i, 3 * i + a, a, math.dist((500.0 * tag, 600.0 + i), layout[a])) for i in range(ticks) for tag in range(4) for a in layout]
        job, store, seen = tracker.TagTracker(layout, 0.5, 0.5), Store(), []
        job.init(store)
        part = pd.DataFrame(rows, columns=tracker.FED)
        sys.setprofile(lambda frame, event, _: seen.append(1) if event == "call" and frame.f_code.co_filename == tracker.__file__ else None)
        try:
            got = pd.concat(job.handleInputRows((0,), iter([part]), None))
        finally:
            sys.setprofile(None)
        assert len(got) == 4 * ticks and (got["samples"].max(), got["n_ranges"].min()) == (ticks, 3)
        return len(seen)

    assert calls(400) == calls(40)


def test_board_lines_beyond_the_last_cut_come_too(spark, tmp_path):
    ev = spark.range(260).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1_704_067_200 + F.col("id") * 60).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 2).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"),
    )
    ev.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = Q.stream_device_clock(spark, str(tmp_path)).collect()
    assert sum(r.lines for r in got) == 260 and all(r.within_delay for r in got)


def test_a_part_of_many_files_is_one_batch(spark):
    rows = spark.range(4000).select("id", (F.col("id") % 3).alias("part")).repartition(7)
    live, parts = Q._staged(rows, F.col("part"), 3, "parts-test")
    seen = Q._drain(live.groupBy("part").count(), "parts-test-out", "update", ["part"], parts)
    assert sorted(map(tuple, seen.select("part", "count").collect())) == [(0, 1334), (1, 1333), (2, 1333)]
