"""3D tracks and cards over streams against the batch job, wherever the stream is cut."""

import random

import pytest
from pyspark.sql import functions as F

from tagtrack import constants as K
from tagtrack.functions import geometry as G
from tagtrack.operators import motion
from tagtrack.plans import locate
from tagtrack.streaming.track3d import RANGES, Tracks

LAYOUT = K.LAYOUTS_3D[4][1]


def ranges(tags=3, ticks=60):
    rng = random.Random(3)
    rows = []
    for k in range(ticks):
        for tag in range(tags):
            x, y = 600 + 30 * k + 100 * tag, 700 + 9 * k
            z = 95 + (60 if (k + tag) % 20 in (10, 11, 12) else 0) + rng.gauss(0, 2)
            for a, (ax, ay, az) in LAYOUT.items():
                if rng.random() > 0.03:
                    d = ((x - ax) ** 2 + (y - ay) ** 2 + (z - az) ** 2) ** 0.5 + rng.gauss(0, 3)
                    rows.append((0, tag, 0.05 * k, len(rows), a, d))
    return rows


def want(spark, rows):
    track = locate.locate_3d(spark.createDataFrame(rows, RANGES), LAYOUT, {"alpha_pos": 0.6, "alpha_dist": 0.7})
    card = motion.player_card(track.withColumn("jump", G.jump_height(F.col("z"))), jump="jump")
    return track, card


def table(df, keys, columns):
    out = {}
    for r in df.collect():
        assert tuple(r[k] for k in keys) not in out
        out[tuple(r[k] for k in keys)] = tuple(r[c] for c in columns)
    return out


def close(got, expected):
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, abs=1e-5) if None not in v else [x is None for x in got[k]] == [x is None for x in v], k


CARD = ["samples", "time_s", "distance_m", "avg_speed_kmh", "max_speed_kmh", "speed_sum_cm_s", "jump_count", "max_jump_cm"]


@pytest.mark.parametrize("cuts", [[], [301, 303, 411], [5, 130]])
def test_any_cut_gives_the_batch_result(spark, tmp_path, cuts):
    rows = ranges()
    tracks = Tracks(spark, LAYOUT, str(tmp_path / "out"), {"alpha_pos": 0.6, "alpha_dist": 0.7})
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        spark.createDataFrame(rows[a:b], RANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(RANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    tracks.start(live, str(tmp_path / "progress")).awaitTermination()
    track, card = tracks.finished()
    batch, figures = want(spark, rows)
    columns = ["x_raw", "y_raw", "z_raw", "x", "y", "z"]
    close(table(track, ["tag_id", "t"], columns), table(batch, ["tag_id", "t"], columns))
    expected = table(figures, ["tag_id"], CARD)
    assert sum(v[6] for v in expected.values()) >= 5
    close(table(card, ["tag_id"], CARD), expected)


def test_cards_after_every_batch_and_a_repeated_batch(spark, tmp_path):
    """The running card is the batch card of all closed ticks; a batch that runs twice counts once."""
    rows = ranges(2, 40)
    tracks = Tracks(spark, LAYOUT, str(tmp_path / "out"), {"alpha_pos": 0.6, "alpha_dist": 0.7})
    cuts = [90, 175, len(rows)]
    for k, (a, b) in enumerate(zip([0, *cuts], cuts)):
        part = spark.createDataFrame(rows[a:b], RANGES)
        tracks.step(part, k)
        if k == 1:
            tracks.step(part, k)
        newest = {tag: max(r[2] for r in rows[:b] if r[1] == tag) for tag in (0, 1)}
        closed = [r for r in rows[:b] if r[2] < newest[r[1]]]
        close(table(tracks.cards(), ["tag_id"], CARD), table(want(spark, closed)[1], ["tag_id"], CARD))


def test_late_ranges_are_kept_apart(spark, tmp_path):
    rows = ranges(1, 30)
    late = rows.pop(20)
    tracks = Tracks(spark, LAYOUT, str(tmp_path / "out"))
    tracks.step(spark.createDataFrame(rows[:60], RANGES), 0)
    tracks.step(spark.createDataFrame([late, *rows[60:]], RANGES), 1)
    got = spark.read.parquet(str(tmp_path / "out/late")).collect()
    assert [(r.t, r.anchor_id) for r in got] == [(late[2], late[4])]
    assert tracks.finished()[0].count() == 30


def test_no_ranges(spark, tmp_path):
    tracks = Tracks(spark, LAYOUT, str(tmp_path / "out"))
    tracks.step(spark.createDataFrame([], RANGES), 0)
    track, card = tracks.finished()
    assert track.count() == 0 and card.count() == 0
