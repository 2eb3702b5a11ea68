"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine names none a temporary folder is set; on a cluster
    that is an error, as executors would write elsewhere.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = _fallback.get(spark.sparkContext.applicationId)
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="quadrille-")
            _fallback[spark.sparkContext.applicationId] = folder
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_fallback: dict[str, str] = {}


#: Rows of one batch that goes to a Python worker.
BATCH = 512


class Workspace:
    """Intermediate Parquet tables of one operator call, in the shared folder.

    Writing a table cuts lineage and survives the loss of executors.  The tables stay
    until the program ends, because a result may still read them; ``drop`` removes one
    earlier.  Shuffle files go as soon as the job that made them ends: all that a later
    job reads is in a table.  Python workers get batches of BATCH rows at most, so that
    very long texts are held few at a time.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
        self.root = f"{shared_folder(spark)}/quadrille/{name}-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(table))
        return self.load(table, df.schema)

    def load(self, table: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(table))

    def drop(self, table: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(table) if table else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _end(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone by now
            self.drop()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def unit_interval(*columns: Column | str) -> Column:
    """A number in (0, 1) that depends on the columns' values alone."""
    bits = F.shiftrightunsigned(F.xxhash64(*columns), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
