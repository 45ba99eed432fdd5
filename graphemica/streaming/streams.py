"""Streams of text lines.

State is bounded by the alphabet, by its square for confusions, or, in event-time windows, by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.align import positional_confusions
from ..functions.mapper import Mapper
from ..operators.stats import unigram


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path).select(F.col("value").alias("text"))


def running_unigram(stream: DataFrame, text_col: str = "text") -> DataFrame:
    return unigram(stream, text_col=text_col)


def running_confusions(stream: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    return positional_confusions(stream, src, tgt)


def mapped(stream: DataFrame, mapper: Mapper, text_col: str = "text") -> DataFrame:
    return stream.withColumn(text_col, mapper.column(F.col(text_col)))


def windowed_counts(stream: DataFrame, ts: str, *by: str, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, by..., n) by event time; rows later than ``late`` are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def run_updates(stream: DataFrame, checkpoint: str, *keys: str) -> DataFrame:
    """All that has arrived, worked through in "update" mode: state that the watermark has passed is dropped, and each batch's
    changed rows are written beside the checkpoint. The result is the last row of each key."""
    rows = f"{checkpoint}/rows"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/batch={number}")  # a batch that is run again replaces itself

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    found = stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(rows)
    return found.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last")).select(*keys, "last.*").select(*stream.columns)


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """All that has arrived, worked through once.

    Aggregates in "complete" mode, whose size the alphabet bounds, become a table in the driver's memory; rows in "append"
    mode are written beside the checkpoint as Parquet and read from there.
    """
    writer = stream.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True)
    if mode == "complete":
        query: StreamingQuery = writer.format("memory").start()
        query.awaitTermination()
        return stream.sparkSession.table(name)
    query = writer.format("parquet").option("path", f"{checkpoint}/rows").start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{checkpoint}/rows")
