"""Frames that arrive in any order within a watermark, paired as soon as both are there; parts that are written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def frame_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)


def paired(frames: DataFrame, keys: list[str], frame: str, gap: int, every: int, time: str, delay: str) -> DataFrame:
    """A stream-stream join of frames with those gap later; frames of one key are within delay of each other, which bounds the state."""
    sources = frames.withWatermark(time, delay).where(F.pmod(F.col(frame), F.lit(every)) == 0).withColumn("__target", F.col(frame) + gap)
    targets = frames.withWatermark(time, delay).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(frame).alias("__frame"), F.col(time).alias("__time"))
    on = F.col("__target") == F.col("__frame")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    on = on & (F.col("__time") >= F.col(time) - F.expr(f"interval {delay}")) & (F.col("__time") <= F.col(time) + F.expr(f"interval {delay}"))
    return sources.join(targets, on).select(*keys, frame, F.col("__frame").alias("target"))


def first_rows(rows: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark: an idempotent upsert by key."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
