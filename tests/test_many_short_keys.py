"""Work of many short boots and tracks is shared by a task, not paid for by each."""

import numpy as np
import pandas as pd

from tagtrack import constants as K
from tagtrack.operators import clock, solve3d


def test_boots_are_fitted_many_at_a_time(spark, capsys):
    lines = [
        (0, tag, "s", "a", boot, (10**9 + boot * 10**7 + ms + (ms * 7 + tag) % 900) * 1000, ms)
        for tag in range(40) for boot in range(3) for ms in range(3000, 300_000, 41_000)
    ]
    df = spark.createDataFrame(lines, "run_id long, tag_id long, session string, src string, boot long, us long, ms long")
    out = clock.boot_lines(df)
    out.explain()
    assert "FlatMapGroupsInPandas" not in capsys.readouterr().out
    got = {(r.tag_id, r.boot): (r.height, r.drift, r.floor_us) for r in out.collect()}
    assert len(got) == 120
    for (tag, boot), (height, drift, floor) in got.items():
        own = pd.DataFrame([(ms, us / 1000 - ms) for _, t, _, _, b, us, ms in lines if (t, b) == (tag, boot)], columns=["x", "y"])
        low = own.loc[own.groupby(own["x"] // clock.POINT_MS)["y"].idxmin()]
        assert (height, drift) == clock.envelope(low["x"], low["y"])
        assert (floor is None) == (boot == 0)


def _track(n, seed):
    layout = K.LAYOUTS_3D[4][1]
    rng = np.random.default_rng(seed)
    p = np.cumsum(rng.normal(0, 5, (n, 3)), axis=0) + (900, 700, 100)
    dist = {f"d{a}": np.sqrt(((p - layout[a]) ** 2).sum(axis=1)) for a in layout}
    rows = pd.DataFrame({"run_id": 0, "tag_id": seed, "piece": 0, "idx": np.arange(n) + 1, "t": 0.05 * np.arange(n), "dt": 0.05, "kind": solve3d.REAL, **dist})
    return rows.assign(**{c: np.nan for c in [*(f"s{a}" for a in sorted(layout)), "x", "y", "z"]})


def test_a_task_advances_tracks_across_batches_together(monkeypatch):
    layout = K.LAYOUTS_3D[4][1]
    ids, anchors = sorted(layout), np.array([layout[a] for a in sorted(layout)], float)
    tracks = [_track(n, k) for k, n in enumerate([1, 30, 7, 64, 2, 19])]
    every = pd.concat(tracks, ignore_index=True)
    lanes, advance = [], solve3d._advance
    monkeypatch.setattr(solve3d, "_advance", lambda batch, sizes, *rest: lanes.append(sizes.tolist()) or advance(batch, sizes, *rest))
    task = solve3d._track_task(ids, anchors, 0.4, 0.3, ["run_id", "tag_id"])
    alone = pd.concat([pd.concat(task(iter([t]))) for t in tracks], ignore_index=True)
    lanes.clear()
    for width in (1, 10, 31, 500):
        got = pd.concat(task(every.iloc[i : i + width] for i in range(0, len(every), width)), ignore_index=True)
        pd.testing.assert_frame_equal(got, alone)
    assert lanes == [[1, 30, 7, 64, 2, 19]] * 4
