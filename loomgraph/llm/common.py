"""Session settings, reading, and lineage cuts shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomgraph import session

#: Bytes of one Arrow batch sent to Python, so that very long texts don't fill a worker's memory.
ARROW_BATCH_BYTES = "4m"


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes; let workers import this package."""
    session.ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def _delete() -> None:
    for spark, path in _written:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended
            return


atexit.register(_delete)


def materialise(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write to the shared folder and read again. Deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Batches of all columns through ``run``, which keeps them; a column's name may hold a dot."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)
