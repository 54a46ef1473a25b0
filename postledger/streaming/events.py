"""Append-only events, parted by day; an event is kept once, however often its batch is run."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "event_id long, name string, user_id long, ts timestamp, day date"


def read(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(EVENT).parquet(path)
    except AnalysisException:  # nothing has been appended yet
        return spark.createDataFrame([], EVENT)


def append(events: DataFrame, path: str) -> None:
    """Append the events (event_id, name, user_id, ts) that are not there yet. Of what is there, only the days of the batch are read."""
    spark = events.sparkSession
    fresh = events.select(F.col("event_id").cast("long"), "name", F.col("user_id").cast("long"), "ts", F.to_date("ts").alias("day")).dropDuplicates(["event_id"])
    first, last = fresh.agg(F.min("day"), F.max("day")).first()
    if first is None:
        return
    there = read(spark, path).where(F.col("day").between(first, last)).select("day", "event_id")
    # rows of a day together: a file a day and task, not one a day for every task
    new = fresh.join(there, ["day", "event_id"], "left_anti").repartition("day", F.pmod(F.xxhash64("event_id"), F.lit(8)))
    new.write.mode("append").partitionBy("day").parquet(path)


def start(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The same for a stream; a batch that is run again after a failure appends nothing twice."""
    return events.writeStream.foreachBatch(lambda rows, _: append(rows, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
