"""Joins over frames and time, running totals, and checks of coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(rows: DataFrame, order: str, value: str, into: str, span: int) -> DataFrame:
    """Adds into: the sum of value over rows of smaller order (a long, distinct). Ranges of order span long are summed apart and then
    among each other, so no task holds all rows."""
    cells = rows.withColumn("__cell", F.expr(f"{order} div {span}"))
    sums = cells.groupBy("__cell").agg(F.sum(value).alias("__sum")).withColumn("__top", F.expr("__cell div 4096"))
    tops = sums.groupBy("__top").agg(F.sum("__sum").alias("__tsum"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("__top", F.coalesce(F.sum("__tsum").over(before(Window.orderBy("__top"))), F.lit(0)).alias("__tbefore"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before(Window.partitionBy("__top").orderBy("__cell"))), F.lit(0)))
    sums = sums.join(tops, "__top").select("__cell", (F.col("__before") + F.col("__tbefore")).alias("__offset"))
    inner = F.coalesce(F.sum(value).over(before(Window.partitionBy("__cell").orderBy(order))), F.lit(0))
    return cells.join(sums, "__cell").withColumn(into, F.col("__offset") + inner).drop("__cell", "__offset")


def find_episode(points: DataFrame, spans: DataFrame, at: str, width: int) -> DataFrame:
    """points: at. spans: start, end and more, disjoint [start, end). The span of each point: an equi join on blocks of width,
    each span standing in every block that it touches, then the exact condition."""
    blocks = spans.where("start < end").withColumn("__b", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}"))))
    return points.withColumn("__b", F.expr(f"{at} div {width}")).join(blocks, "__b").where((F.col(at) >= F.col("start")) & (F.col(at) < F.col("end"))).drop("__b")


def frame_pairs(frames: DataFrame, keys: list[str], frame: str, gap: int, every: int) -> DataFrame:
    """(frame, frame + gap) of a series for every every-th frame; frames count from 0 without holes."""
    if every < 1 or gap < 1:
        raise ValueError("gap and stride are at least 1")
    target = F.lead(frame, gap).over(Window.partitionBy(*keys).orderBy(frame))
    return frames.withColumn("target", target).where(F.col("target").isNotNull() & (F.pmod(F.col(frame), F.lit(every)) == 0))


def nearest_frame(target: Column, n: Column, source_fps: Column, target_fps: Column) -> Column:
    """The source frame of a target frame: half-even, within the series."""
    return F.greatest(F.lit(0), F.least(n - 1, F.bround(target * source_fps / target_fps, 0))).cast("int")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """left with right's last value at or before each time, by one sort of both together; null before the first."""
    both = left.withColumn("__r", F.lit(1)).unionByName(right.select(*keys, time, F.col(value).alias("__v")).withColumn("__r", F.lit(0)), allowMissingColumns=True)
    last = F.last("__v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(time, "__r").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(value, last).where("__r = 1").drop("__r", "__v")


def missing_frames(lengths: DataFrame, frames: DataFrame, key: str, length: str, frame: str) -> DataFrame:
    """(key, frame) that a length promises and frames lacks."""
    want = lengths.where(F.col(length) > 0).select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col(length).cast("long") - 1)).alias(frame))
    return want.join(frames.select(key, F.col(frame).cast("long").alias(frame)), [key, frame], "left_anti")


def coverage(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The ids of 0 to n - 1 that stand in rows never, or more than once: key, times."""
    have = rows.groupBy(key).agg(F.count(F.lit(1)).alias("times"))
    want = rows.sparkSession.range(n).select(F.col("id").cast("long").alias(key))
    return want.join(have, key, "left").select(key, F.coalesce("times", F.lit(0)).alias("times")).where("times <> 1")


def conflicts(rows: DataFrame, key: str) -> DataFrame:
    """Keys whose rows aren't all equal, and how many kinds they have."""
    return rows.groupBy(key).agg(F.count_distinct(F.to_json(F.struct(*[c for c in rows.columns if c != key]))).alias("kinds")).where("kinds > 1")


def config_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ or stand on one side only."""
    both = old.select(key, F.col(value).alias("was")).join(new.select(key, F.col(value).alias("now")), key, "full_outer")
    return both.where(~F.col("was").eqNullSafe(F.col("now")))


def encode_names(rows: DataFrame, name: str, position: str, into: str) -> DataFrame:
    """Numbers names by first appearance. Names are few beside rows; they are joined, not collected."""
    first = rows.groupBy(name).agg(F.min(position).alias("__first"))
    codes = first.select(name, (F.row_number().over(Window.orderBy("__first")) - 1).alias(into))
    return rows.join(codes, name)


def standardised_slots(samples: DataFrame, frames: DataFrame, stats: DataFrame, chunk: int, step: int) -> DataFrame:
    """samples: dataset, sample, view, start. frames: dataset, view, frame (from 0 without holes), latent. stats: dataset, mean, std (arrays, as long as latents are).

    A row a sample, slot (its views by name, from 0) and k (below chunk): the view's latent at start + k * step, past its ends the one there, less the mean and by the deviation;
    of a dataset without statistics as it is. A view without frames is an error, as are statistics of another length. A sample's views are few; frames are met by an equi join.
    """
    slot = F.row_number().over(Window.partitionBy("dataset", "sample").orderBy("view")) - 1
    lengths = frames.groupBy("dataset", "view").agg((F.max("frame") + 1).alias("__n"))
    n = F.when(F.col("__n").isNull(), F.raise_error(F.concat(F.lit("no frames of view "), F.col("view").cast("string"))).cast("long")).otherwise(F.col("__n"))
    wanted = samples.withColumn("slot", slot).join(lengths, ["dataset", "view"], "left").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(chunk - 1))))
    wanted = wanted.withColumn("frame", F.greatest(F.lit(0), F.least(F.col("start") + F.col("k") * step, n - 1)).cast("long"))
    found = wanted.join(frames.select("dataset", "view", F.col("frame").cast("long").alias("frame"), "latent"), ["dataset", "view", "frame"], "left").join(stats.select("dataset", "mean", "std"), "dataset", "left")
    fits = (F.size("latent") == F.size("mean")) & (F.size("latent") == F.size("std"))
    scaled = F.zip_with(F.zip_with("latent", "mean", lambda x, m: x - m), "std", lambda x, s: x / s)
    scaled = F.when(F.col("mean").isNull(), F.col("latent")).when(fits, scaled).otherwise(F.raise_error(F.lit("statistics don't fit the latents")).cast("array<double>"))
    return found.select("dataset", "sample", "slot", "view", "k", "frame", scaled.alias("latent"))
