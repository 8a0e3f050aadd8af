"""Results that several later parts of a plan read, computed once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share: the one in spark.checkpoint.dir.

    Only a local session without that setting (tests) gets a temporary folder of
    its own; on a cluster, executors would write to their own disks there.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialized(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors cost nothing that came before."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
