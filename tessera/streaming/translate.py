"""Code streams as Structured Streaming (an extension: finite streams are translated by the batch operator).

Translation keeps no state: a stream-static join with the pack's tables. Bigram counting keeps one row for each pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.translate import translate
from tessera.session import scratch_path


def read_codes(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet files of codes as they arrive."""
    return spark.readStream.schema(schema).parquet(folder)


def translate_stream(codes: DataFrame, packs: DataFrame, symbols: DataFrame, codebook: DataFrame, aliases: DataFrame) -> DataFrame:
    """Glosses of a streaming table (pack_id, code, ...): the batch plan with a streaming left side."""
    return translate(codes, packs, symbols, codebook, aliases)


def deduplicated(codes: DataFrame, at: str = "arrived_at", late: str = "1 day") -> DataFrame:
    """Redelivered events dropped within the watermark."""
    return codes.withWatermark(at, late).dropDuplicatesWithinWatermark(["stream_id", "pos"])


def counts_by_window(codes: DataFrame, at: str = "arrived_at", late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """(begin, code, n): codes by tumbling window of their arrival; late events count until the watermark passes."""
    return codes.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), "code").agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), "code", "n")


def run_available(frame: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything that is available now, written to the shared folder and read back."""


    spark = frame.sparkSession
    path, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    query = frame.writeStream.format("parquet").option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(path)


