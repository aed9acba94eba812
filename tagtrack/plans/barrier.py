"""Cutting lineage between the ordered passes of a long job, and where that is kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a local session gets one scratch folder; a cluster has no
    folder that could stand in, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = tempfile.mkdtemp(prefix="tagtrack-checkpoint-")
    return _scratch[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table or a stream's progress."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the cluster's checkpoint folder and continue from there.

    ``spark.cleaner.referenceTracking.cleanCheckpoints`` removes what nothing refers to any more.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
