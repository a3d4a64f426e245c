"""Document streams: the batch operators, which keep no state between rows, on readStream frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.quality import language_gate


def document_stream(spark: SparkSession, folder: str, schema: str = "doc_id LONG, text STRING, ts TIMESTAMP") -> DataFrame:
    """Documents as JSON lines dropped into a folder."""
    return spark.readStream.schema(schema).json(folder)


def gated(stream: DataFrame) -> DataFrame:
    return language_gate(stream)


def once(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each document once, however often it is sent within the delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["doc_id"])


def accepted_per_window(stream: DataFrame, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", window)).agg(F.count(F.lit(1)).alias("documents"))


def run_once(frame: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there now, into a memory table."""
    query = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
