"""Checkpoints in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Used only where the session names no folder, as in local tests.
LOCAL = "/tmp/checkpoints/stowline"


def checkpoint(df: DataFrame) -> DataFrame:
    """df under a cut lineage, kept where a lost executor does not matter."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or LOCAL)
    return df.checkpoint()
