"""Settings that any session needs to run this package, and the cut of a lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Bytes of the optimizer's size estimate up to which a side is broadcast.
BROADCAST_BYTES = 64 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, unless it is installed there."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs in one process."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        sc.setCheckpointDir(folder)
    return folder


_written: list[tuple[SparkSession, str]] = []


def drop(path: str, spark: SparkSession) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _at_end() -> None:
    for spark, path in _written:
        try:
            drop(path, spark)
        except Exception:  # the session has ended
            return


atexit.register(_at_end)


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that :func:`cut` wrote and nothing reads any more."""
    for path in df.inputFiles()[:1]:
        drop(path.rsplit("/", 1)[0], df.sparkSession)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared folder and read again, so a lost executor costs nothing that was done.

    The folder goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)
