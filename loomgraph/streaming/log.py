"""The operation log as a stream: change feed, folding into a state table, and events by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import session
from loomgraph.operators import kernel

SCHEMA = "seq bigint, op string, id string, key string, value string"


def read_log(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(SCHEMA)
    return (r.option("maxFilesPerTrigger", files) if files else r).parquet(folder)


def changes_since(log: DataFrame, seq: int) -> DataFrame:
    """The change feed after a cursor; a filter that reaches the scan's row groups."""
    return log.filter(F.col("seq") > seq).orderBy("seq")


def materialise(spark: SparkSession, log_folder: str, state_folder: str, checkpoint: str):
    """Start the query that folds the log into snapshots ``batch=N``; a batch that is run again writes the same snapshot, so each change counts once."""

    def fold(batch: DataFrame, n: int) -> None:
        new = batch.select("seq", "op", "id", "key", "value")
        if n:
            old = spark.read.schema(SCHEMA).parquet(f"{state_folder}/batch={n - 1}")
            new = new.unionByName(old)
        last = new.filter("op = 'set'").groupBy("id", "key").agg(F.max(F.struct("seq", "value")).alias("m")).select(F.col("m.seq").alias("seq"), F.lit("set").alias("op"), "id", "key", F.col("m.value").alias("value"))
        gone = new.filter("op = 'remove'").groupBy("id").agg(F.max("seq").alias("seq")).select("seq", F.lit("remove").alias("op"), "id", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"))
        last.unionByName(gone).write.mode("overwrite").parquet(f"{state_folder}/batch={n}")

    return read_log(spark, log_folder).writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, state_folder: str, batch: int) -> DataFrame:
    return kernel.fold_log(spark.read.schema(SCHEMA).parquet(f"{state_folder}/batch={batch}"))


def window_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total): tumbling windows; on a stream, events later than the watermark are left out."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    return w.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def write_log(df: DataFrame, folder: str) -> None:
    session.ship(df.sparkSession)
    df.write.mode("append").parquet(folder)
