"""What the queries read: the driver's tables as episodes, frames and series, and the same as common table expressions of DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.scalar import stride
from framewright.functions.series import window_count

#: Windows have CHUNK samples, SECONDS apart.
CHUNK, SECONDS = 4, 0.1
#: Frame rates by user number mod 4.
RATES = [30.0, 20.0, 10.0, 25.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, episode, nlat, fps, pair_stride: a user's events of one type, at a rate that varies by user."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("dataset"), F.col("user_id").alias("episode")).agg(F.count(F.lit(1)).alias("nlat"))
    fps = F.get(F.array(*[F.lit(r) for r in RATES]), F.pmod(F.col("episode"), F.lit(4)).cast("int"))
    return rows.withColumn("fps", fps).withColumn("pair_stride", F.pmod(F.col("episode"), F.lit(3)) + 1)


EPISODES = """episodes AS (SELECT event_type AS dataset, user_id AS episode, count(*)::BIGINT AS nlat,
    CASE user_id % 4 WHEN 0 THEN 30 WHEN 1 THEN 20 WHEN 2 THEN 10 ELSE 25 END::DOUBLE AS fps, (1 + user_id % 3)::BIGINT AS pair_stride
    FROM events GROUP BY event_type, user_id)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episodes with stride and windows."""
    rows = episodes(spark, sf_dir).withColumn("stride", stride(F.col("fps"), SECONDS, F.col("pair_stride")).cast("long"))
    return rows.withColumn("windows", window_count(F.col("nlat"), CHUNK, F.col("stride")))


WINDOWS = f"""{EPISODES},
strided AS (SELECT *, greatest(1, round_even(fps * {SECONDS}::DOUBLE / greatest(1, pair_stride), 0)::BIGINT) AS stride FROM episodes),
windowed AS (SELECT *, (CASE WHEN nlat < {CHUNK - 1} * stride + 1 THEN 0 ELSE (nlat - ({CHUNK - 1} * stride + 1)) // greatest(1, stride * {CHUNK} // 2) + 1 END)::BIGINT AS windows FROM strided)"""


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, windows: sums by dataset."""
    return windows(spark, sf_dir).groupBy("dataset").agg(F.sum("windows").alias("windows"))


SIZES = f"{WINDOWS}, sizes AS (SELECT dataset, sum(windows)::BIGINT AS windows FROM windowed GROUP BY dataset)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode (the user), frame (from 0, in order of time), value, event_id, event_type."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("frame", (F.row_number().over(order) - 1).cast("long"))
    return rows.select(F.col("user_id").alias("episode"), "frame", "value", "event_id", "event_type")


FRAMES = "frames AS (SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value, event_id, event_type FROM events)"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode, x: a user's values in order of time as one array, as long as the episode is."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("episode")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("s"))
    return rows.select("episode", F.transform("s", lambda e: e["value"]).alias("x"))


SERIES = "series AS (SELECT user_id AS episode, list(value ORDER BY ts, event_id) AS x FROM events GROUP BY user_id)"


def rounded(rows: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to so many places: sums differ between engines in their last bits."""
    return rows.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes])
