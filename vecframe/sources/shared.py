"""What the driver and all executors share: a folder, tables written to it, this package."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, whatever the driver's path is."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder that the session was given for checkpoints.

    Where neither is set a new folder serves a local session only: on a cluster there is none that all executors share."""
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or (own.get() if own.isDefined() else None)
    if not at and sc.master.startswith("local"):
        at = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(at)
    if not at:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return at.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder."""
    sc = df.sparkSession.sparkContext
    at = shared_folder(df.sparkSession)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return df.checkpoint(eager=True)
