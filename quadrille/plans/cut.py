"""Cutting the lineage of iterated frames, in the folder the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; without one a temporary folder on one machine, an error on a cluster, where executors would write elsewhere."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or tempfile.mkdtemp(prefix="quadrille-")).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The frame, computed and stored in the shared folder; a folder is set only where none is."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
