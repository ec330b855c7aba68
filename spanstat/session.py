"""Cutting a plan's lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, written to the folder of spark.checkpoint.dir and read from there.

    Where the setting is missing, a local session gets a temporary folder; on a
    cluster that would be each executor's own, so it is an error there.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith(("local[", "local,")) and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="spanstat-"))
    return df.checkpoint()
