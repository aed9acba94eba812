"""Court areas: time spent per zone and distance to the hoops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtrack.functions import geometry as G
from tagtrack.operators import align


def with_zone(positions: DataFrame) -> DataFrame:
    """Add ``zone``; a fixed list of shapes is an expression, not a join."""
    return positions.withColumn("zone", G.court_zone(F.col("x"), F.col("y")))


def zone_time(positions: DataFrame, keys: Sequence[str] = align.KEYS) -> DataFrame:
    """Samples and seconds per zone; ``dt`` is the duration of each tick."""
    return (
        with_zone(positions.where(F.col("x").isNotNull()))
        .groupBy(*keys, "zone")
        .agg(F.count(F.lit(1)).alias("samples"), F.sum("dt").alias("seconds"))
    )


def hoop_distance(positions: DataFrame) -> DataFrame:
    return positions.withColumn("hoop_cm", G.hoop_distance(F.col("x"), F.col("y")))
