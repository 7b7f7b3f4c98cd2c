"""The queue's event log as a stream: the latest state of each job, kept as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parcella.operators.jobs import latest_states


def events(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """A folder of Parquet event files (job_id, ts, event_id, state) as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_states(stream: DataFrame) -> DataFrame:
    """Per job the latest event so far; state is kept per job, not per event."""
    return latest_states(stream)


def activity(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Transitions per state and window of event time; events later than the watermark don't count. ts without a zone is UTC."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "state").agg(F.count("*").alias("events"))


def publish(states: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes the table of states after every batch beside the last one, under its batch's number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = states.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()
