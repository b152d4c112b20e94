"""Exact apportionment, temperature weights and virtual indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.ranges import running


def largest_remainder(rows: DataFrame, exact: str, total: Column, into: str, order: list[str], within: list[str] | None = None) -> DataFrame:
    """Whole numbers that sum to total: each row's floor, and one more for the rows of the largest remainders, ties in order.

    within: groups, each with its own total. A total that the floors pass, or that is more than the rows can make up, is an error. Sums are a row
    a group, and ranks are taken over ranges, so a group may be of any size.
    """
    group = within or []
    rest = F.coalesce(F.floor(exact) - F.col(exact), F.lit(1))  # the largest remainder first, nulls last
    ranked = running(rows.withColumn("__total", total), group, [rest, *map(F.col, order)], "__rank")
    sums = rows.groupBy(*group).agg(F.sum(F.floor(exact)).alias("__floors"), F.count(F.lit(1)).alias("__size"))
    ranked = ranked.join(sums, group) if group else ranked.join(F.broadcast(sums))  # one row without groups
    short = F.col("__total") - F.col("__floors")
    wrong = (short < 0) | (short > F.col("__size"))
    checked = F.when(wrong, F.raise_error(F.lit("the total can't be apportioned")).cast("long")).otherwise((F.floor(exact) + (F.col("__rank") < short).cast("long")).cast("long"))
    return ranked.withColumn(into, checked).drop("__total", "__floors", "__size", "__rank")


def weighted_slots(episodes: DataFrame, weights: DataFrame) -> DataFrame:
    """episodes: dataset, episode, windows. weights: dataset, weight. Adds slots, which sum to the windows of all, plus one for each dataset that weights leave without.

    Datasets get slots by weight, episodes of a dataset by windows, both by largest remainder.
    """
    sums = episodes.groupBy("dataset").agg(F.sum("windows").alias("own")).join(weights, "dataset")
    everything = Window.partitionBy(F.lit(1))
    sums = sums.withColumn("total", F.sum("own").over(everything)).withColumn("share", F.col("weight") / F.sum("weight").over(everything) * F.col("total"))
    sums = largest_remainder(sums, "share", F.col("total"), "target", ["dataset"])
    sums = sums.select("dataset", "own", F.greatest(F.lit(1), "target").alias("target"))
    parts = episodes.join(sums, "dataset").withColumn("exact", F.col("windows") / F.col("own") * F.col("target"))
    return largest_remainder(parts, "exact", F.col("target"), "slots", ["episode"], ["dataset"]).drop("exact", "own", "target")


def virtual_index(rows: DataFrame) -> DataFrame:
    """rows: windows, slots. A row for each slot with the window it stands for, evenly spread."""
    slots = rows.where("slots > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    return slots.withColumn("window", F.expr("k * windows div slots"))


def temperature_weights(windows: DataFrame, alpha: float) -> DataFrame:
    """windows: dataset, windows. weight (windows ** alpha), natural and effective share, upsample, and whether that's over 8."""
    all_ = Window.partitionBy(F.lit(1))
    out = windows.withColumn("weight", F.pow(F.col("windows").cast("double"), F.lit(alpha)))
    out = out.withColumn("natural", F.col("windows") / F.sum("windows").over(all_)).withColumn("effective", F.col("weight") / F.sum("weight").over(all_))
    return out.withColumn("upsample", F.col("effective") / F.col("natural")).withColumn("flagged", F.col("upsample") > 8)


def dataset_picks(sizes: DataFrame) -> DataFrame:
    """sizes: dataset, n, weight. A row a pick: max(1, round(share of all)) evenly spread places of the dataset."""
    all_ = Window.partitionBy(F.lit(1))
    out = sizes.withColumn("t", F.greatest(F.lit(1), F.bround(F.col("weight") / F.sum("weight").over(all_) * F.sum("n").over(all_), 0)).cast("long"))
    return out.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t") - 1))).select("dataset", "k", F.expr("k * n div t").alias("place"))


def budgets(sizes: DataFrame, total: int, temperature: float, multipliers: dict[str, float]) -> DataFrame:
    """sizes: dataset, role, n. weight n ** (1 / temperature) times the role's multiplier, and a budget of at least 1 where it's positive."""
    times = F.coalesce(F.create_map(*[F.lit(x) for kv in multipliers.items() for x in kv])[F.col("role")], F.lit(1.0)) if multipliers else F.lit(1.0)
    out = sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(1.0 / temperature)) * times)
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(1))) * total
    return out.withColumn("budget", F.when(F.col("weight") > 0, F.greatest(F.lit(1), F.bround(share, 0).cast("long"))).otherwise(0).cast("long"))
