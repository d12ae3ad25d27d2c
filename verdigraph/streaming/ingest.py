"""Run records as they arrive: new answers update their groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdigraph.functions.text import normal_form, output_key


def group_stream(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """(grammar, qid, output_key) with size and first run of a file stream of run records; state grows with the number of distinct answers."""
    runs = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    normal = normal_form(F.col("grammar"), F.col("response"))
    return runs.withColumn("output_key", output_key(F.col("grammar"), F.col("qid"), normal)).groupBy("grammar", "qid", "output_key").agg(F.count("*").alias("size"), F.min("run").alias("first_run"))


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by time window and key; rows later than ``late`` are dropped and finished windows leave the state."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def start_append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each update as an append to a log, which ``operators.answers.latest`` compacts by ``batch``; offsets are in ``checkpoint``.

    Each batch has a folder of its own, which it overwrites if a restart runs it again.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
