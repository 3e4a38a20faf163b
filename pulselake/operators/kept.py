"""Results that several passes read, kept in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in ``spark.checkpoint.dir``: computed once, and a lost executor costs nothing of it. Where the setting
    is missing, a local session gets a folder of its own; on a cluster that is an error."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
