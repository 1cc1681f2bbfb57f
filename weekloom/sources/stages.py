"""Lineage cuts in the folder that all machines of a cluster share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of this machine only where none is set and Spark is plain local."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared is None:
        shared = sc.getCheckpointDir()
    if shared is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="weekloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared)
    return shared


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder once; what follows reads that, also after an executor is lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reachable(spark: SparkSession) -> None:
    """Let Python workers that start from now on import this package from where the driver has it."""
    known = spark.sparkContext.environment
    if _ROOT not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, (_ROOT, known.get("PYTHONPATH"))))
