"""Sequential 3D tracks over a stream of ranges, and the player card that runs with them.

The solve of a tick starts from the estimate before it, so a track is a recurrence; many
tracks advance together in numpy lanes (:mod:`tagtrack.operators.solve3d`). A stateful processor sees
one key at a time and could not do that, so the state of all tracks is a table
with a version per micro-batch: a batch joins the version before it, gives every
track that has new ticks a seed row, runs the same lanes as the batch job,
and writes the next version. A batch that is repeated after a failure reads the same version and
overwrites its own output, so results are exactly once.

Folders below ``path``: ``track/batch=k`` the ticks, ``card/batch=k`` the cards of the players that
moved, ``late/batch=k`` ranges that came after their tick, ``state`` and ``open`` the versions.
A track's newest stamp stays open until a newer one comes, since ranges of it may
still arrive: wherever the batches are cut, ticks and cards are those of the batch job. :func:`finished` closes them.

Cards count rising edges: the state holds the last position and whether it was airborne, so a jump
that spans two batches is one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagtrack import constants as K
from tagtrack.functions import geometry as G
from tagtrack.operators import align, motion, scan, solve3d

KEYS = list(align.KEYS)
FIGURES = {  # of the card: type, and how a batch's figure joins the one before
    "samples": ("long", "add"), "time_s": ("double", "max"), "distance_cm": ("double", "add"), "speed_sum_cm_s": ("double", "add"),
    "max_speed_cm_s": ("double", "max"), "jump_count": ("long", "add"), "max_jump_cm": ("double", "max"),
}
RANGES = "run_id long, tag_id long, t double, arrival long, anchor_id long, distance_cm double"


class Tracks:
    """The job over one folder."""

    def __init__(self, spark: SparkSession, layout: solve3d.Layout3, path: str, settings: Mapping[str, float] | None = None) -> None:
        use = {**K.default_settings("3d"), **(settings or {})}
        self.spark, self.path, self.ids = spark, path.rstrip("/"), sorted(layout)
        types = {k: "long" for k in KEYS}
        self.dist, self.state, self.cols, self.solve = solve3d.solver(layout, use["alpha_dist"], use["alpha_pos"], KEYS, types)
        kept = [f"{c} double" for c in self.state] + [f"{c} {kind}" for c, (kind, _) in FIGURES.items()]
        self.schema = ", ".join(["run_id long, tag_id long, t double, ticks long", *kept])

    def version(self, name: str, k: int, schema: str) -> DataFrame:
        if k < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{k}")

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def _forget(self, k: int) -> None:
        """Versions that no repeated batch can ask for any more."""
        if k >= 0:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            for name in ("state", "open", "rows"):
                old = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/{k}")
                old.getFileSystem(conf).delete(old, True)

    def step(self, ranges: DataFrame, k: int) -> None:
        """One micro-batch: from version k - 1 to version k."""
        before = self.version("state", k - 1, self.schema)
        fresh = ranges.where(F.col("anchor_id").isin(*self.ids)).select(
            *[F.col(c).cast("long") for c in KEYS], F.col("t").cast("double"), F.col("arrival").cast("long"),
            F.col("anchor_id").cast("long"), F.col("distance_cm").cast("double"),
        )
        told = fresh.join(before.select(*KEYS, F.col("t").alias("done")), KEYS, "left")
        told = told.withColumn("late", F.coalesce(F.col("t") <= F.col("done"), F.lit(False))).drop("done")
        open_rows = self.version("open", k - 1, RANGES).withColumn("late", F.lit(False))
        rows = self._written(told.unionByName(open_rows), f"rows/{k}")
        self._written(rows.where("late").drop("late"), f"late/batch={k}")
        rows = rows.where("NOT late").drop("late")
        newest = rows.groupBy(*KEYS).agg(F.max("t").alias("newest"))
        both = rows.join(newest, KEYS)
        self._written(both.where("t = newest").drop("newest"), f"open/{k}")
        track = self._written(self._ticks(both.where("t < newest").drop("newest"), before), f"track/batch={k}")
        after = self._written(self._after(track, before), f"state/{k}")
        moved = after.join(track.select(*KEYS).distinct(), KEYS, "left_semi")
        self._written(motion.card(moved.where("samples > 0"), KEYS), f"card/batch={k}")
        self._forget(k - 2)

    def _ticks(self, closed: DataFrame, before: DataFrame) -> DataFrame:
        """The ticks of whole stamps, advanced from the state before them."""
        ticks = align.event_ticks(closed, self.ids)
        rows = ticks.select(*KEYS, "t", F.lit(solve3d.REAL).alias("kind"), *self.dist, *[F.lit(None).cast("double").alias(c) for c in self.state])
        seeds = before.join(ticks.select(*KEYS).distinct(), KEYS, "left_semi").select(
            *KEYS, "t", F.lit(solve3d.SEED).alias("kind"), *[F.lit(None).cast("double").alias(c) for c in self.dist], *self.state
        )
        feed = align.with_dt(scan.with_chunk(rows.unionByName(seeds)))
        feed = solve3d.with_track_index(feed).withColumn("piece", F.lit(0).cast("long")).withColumn("idx", F.col("idx").cast("long"))
        out = self.solve(feed).where(F.col("kind") == solve3d.REAL)
        return out.select(*KEYS, "t", "dt", *self.dist, *self.state, "x_raw", "y_raw", "z_raw")

    def _after(self, track: DataFrame, before: DataFrame) -> DataFrame:
        """The state after a batch: last tick and card figures of the tracks that have moved, the others as they were."""
        placed = track.where(F.col("x").isNotNull()).select(*KEYS, "t", "dt", "x", "y", "z", F.lit(False).alias("seed"))
        seeds = before.where(F.col("x").isNotNull()).join(track.select(*KEYS).distinct(), KEYS, "left_semi")
        seeds = seeds.select(*KEYS, "t", F.lit(None).cast("double").alias("dt"), "x", "y", "z", F.lit(True).alias("seed"))
        rows = scan.with_chunk(placed.unionByName(seeds)).withColumn("jump", G.jump_height(F.col("z")))
        gained = motion.summed(motion.segments(rows, KEYS, "jump").where("NOT seed"), KEYS, "jump")
        last = track.groupBy(*KEYS).agg(
            F.max("t").alias("t"), F.count(F.lit(1)).alias("ticks"), *[F.max_by(F.struct(c), "t")[c].alias(c) for c in self.state]
        )  # in a struct: the last tick's value, also where it is missing
        new = last.join(gained, KEYS, "left").select(*KEYS, *[F.col(c).alias(f"n_{c}") for c in last.columns if c not in KEYS], *[F.col(c).alias(f"n_{c}") for c in FIGURES])
        both = before.join(new, KEYS, "full")
        moved = F.col("n_t").isNotNull()

        def joined(c: str, how: str) -> Column:
            a, b = F.col(c), F.col(f"n_{c}")
            return F.coalesce(a + b if how == "add" else F.greatest(a, b), a, b, F.lit(0))

        return both.select(
            *KEYS, F.coalesce("n_t", "t").alias("t"), (F.coalesce("ticks", F.lit(0)) + F.coalesce("n_ticks", F.lit(0))).alias("ticks"),
            *[F.when(moved, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in self.state],
            *[joined(c, how).cast(kind).alias(c) for c, (kind, how) in FIGURES.items()],
        )

    def start(self, ranges: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Follow a stream of ranges (run_id, tag_id, t, arrival, anchor_id, distance_cm)."""
        writer = ranges.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def last_version(self) -> int:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/card")
        fs = folder.getFileSystem(conf)
        return max((int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(folder)), default=-1) if fs.exists(folder) else -1

    def finished(self) -> tuple[DataFrame, DataFrame]:
        """All ticks and the cards of a stream that has ended: the stamps that are still open count as whole."""
        k = self.last_version()
        before = self.version("state", k, self.schema)
        rest = self._ticks(self.version("open", k, RANGES), before)
        track = rest if k < 0 else self.spark.read.schema(rest.schema).parquet(f"{self.path}/track").select(*rest.columns).unionByName(rest)
        return track, motion.card(self._after(rest, before).where("samples > 0"), KEYS)

    def cards(self) -> DataFrame:
        """The newest card of every player so far."""
        rows = self.spark.read.parquet(f"{self.path}/card")
        figures = [c for c in rows.columns if c not in (*KEYS, "batch")]
        return rows.groupBy(*KEYS).agg(*[F.max_by(F.struct(c), "batch")[c].alias(c) for c in figures])
