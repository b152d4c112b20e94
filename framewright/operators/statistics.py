"""Moments and quantiles of vectors and leaves, and their merges."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.ranges import stored


def moments(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, std (n - 1; 0 for one row), min, max by keys; partial sums are merged by Spark."""
    x = F.col(value).cast("double")
    return rows.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))


#: Ranges that a group's values are counted in, and values of a range that are sorted as they are.
CELLS, FEW = 1024, 4096


def _same(left: DataFrame, right: DataFrame, keys: list[str], prefix: str = "__") -> Column:
    return reduce(and_, [left[k].eqNullSafe(right[f"{prefix}{k}"]) for k in keys], F.lit(True))


def _group(keys: list[str]) -> Column:
    """Keys, of which some may be null, as one text."""
    return F.to_json(F.struct(*keys)) if keys else F.lit("")


def values_at(rows: DataFrame, wanted: DataFrame, times: str | None = None) -> DataFrame:
    """rows: g, x. wanted: g, rank (from 0 in order of x), and lo, hi, count: the group's least and largest x and their number. g, rank, at: the x at these ranks. times: a column that says for how many equal values a row stands (none: one).

    Values are counted in CELLS ranges between lo and hi, and the range that has the rank becomes the next lo and hi, until it has one value or FEW rows, which
    are sorted. Exact for groups of any size; a task holds the counts of ranges, or FEW values. Nulls aren't counted."""
    rows = rows.where("x is not null")
    at = ["g", "lo", "hi"]
    left, found = wanted.withColumn("before", F.lit(0).cast("long")), None
    while True:
        left = stored(left, "quantile-ranges")
        is_one, is_few = F.col("lo") == F.col("hi"), F.col("count") <= FEW
        within = lambda ranges: rows.join(ranges.select(*at).distinct(), "g").where(F.col("x").between(F.col("lo"), F.col("hi")))
        few = left.where(~is_one & is_few)
        values = within(few).groupBy(*at).agg(F.array_sort(F.collect_list("x") if times is None else F.flatten(F.collect_list(F.array_repeat("x", F.col(times).cast("int"))))).alias("xs"))
        ended = left.where(is_one).select("g", "rank", F.col("lo").alias("at"))
        ended = ended.unionByName(few.join(values, at).select("g", "rank", F.get("xs", (F.col("rank") - F.col("before")).cast("int")).alias("at")))
        ended = stored(ended, "quantile-values")
        found = ended if found is None else found.unionByName(ended)
        left = left.where(~is_one & ~is_few)
        if left.isEmpty():
            return found
        cell = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS), F.lit(CELLS - 1))
        counts = within(left).groupBy(*at, cell.alias("cell")).agg((F.count(F.lit(1)) if times is None else F.sum(times)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        ahead = F.sum("n").over(Window.partitionBy(*at).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.withColumn("ahead", F.coalesce(ahead, F.lit(0)))
        rank = F.col("rank") - F.col("before")
        left = left.join(counts, at).where((rank >= F.col("ahead")) & (rank < F.col("ahead") + F.col("n")))
        left = left.select("g", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("n").alias("count"), (F.col("before") + F.col("ahead")).alias("before"))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], whole: DataFrame | None = None, times: str | None = None) -> DataFrame:
    """keys, and a column for each of the named shares: exact quantiles, linear between values. Null keys are groups. whole: keys with n, min and max, where a caller has them; rows stand for times values then."""
    whole = (moments(rows, keys, value) if whole is None else whole).select(*keys, _group(keys).alias("g"), F.col("n").alias("count"), F.col("min").cast("double").alias("lo"), F.col("max").cast("double").alias("hi"))
    place = {name: (F.col("count") - 1) * F.lit(share) for name, share in shares.items()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in place.values()])))
    wanted = whole.where("count > 0").select("g", F.explode(ranks).alias("rank"), "lo", "hi", "count")
    found = values_at(rows.select(_group(keys).alias("g"), F.col(value).cast("double").alias("x"), *([times] if times else [])), wanted, times)
    found = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "at"))).alias("at"))
    at = lambda p, part: F.col("at")[part(p).cast("long")]
    return whole.join(found, "g", "left").select(*keys, *[(at(p, F.floor) + (at(p, F.ceil) - at(p, F.floor)) * (p - F.floor(p))).alias(name) for name, p in place.items()])


def leaf_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """moments, and exact q01 and q99, linear between values, of groups of any size."""
    whole = stored(moments(rows, keys, value), "leaf-moments")
    q = quantiles(rows, keys, value, {"q01": 0.01, "q99": 0.99}, whole).withColumnsRenamed({k: f"__{k}" for k in keys})
    return whole.join(q, _same(whole, q, keys)).drop(*[f"__{k}" for k in keys])


def repeated_leaf_stats(times: DataFrame, keys: list[str], value: str, count: str) -> DataFrame:
    """leaf_stats of values that stand so many times (count) in their group: a narrow table, which is read several times, so it should be a stored one."""
    times = times.select(*keys, F.col(value).cast("double").alias("__x"), F.col(count).alias("__times"))
    x, w = F.col("__x"), F.when(F.col("__x").isNotNull(), F.col("__times")).otherwise(0)
    sums = times.groupBy(*keys).agg(F.sum(w).alias("n"), (F.sum(w * x) / F.nullif(F.sum(w), F.lit(0))).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))
    sums = stored(sums, "leaf-sums")
    means = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("mean").alias("__mean"), F.col("n").alias("__n"))
    gap = x - F.col("__mean")
    spread = times.join(means, _same(times, means, keys)).groupBy(*[f"__{k}" for k in keys], "__n").agg(F.sum(w * gap * gap).alias("__q"))
    std = F.when(F.col("__n") > 1, F.sqrt(F.col("__q") / (F.col("__n") - 1))).otherwise(0.0)
    spread = spread.select(*[f"__{k}" for k in keys], std.alias("std"))
    whole = sums.join(spread, _same(sums, spread, keys)).select(*keys, "n", "mean", "std", "min", "max")
    q = quantiles(times, keys, "__x", {"q01": 0.01, "q99": 0.99}, sums, "__times").withColumnsRenamed({k: f"__{k}" for k in keys})
    return whole.join(q, _same(whole, q, keys)).drop(*[f"__{k}" for k in keys])


#: Rows of a reservoir.
RESERVOIR = 200_000


def reservoir(rows: DataFrame, keys: list[str], value: str, by: list[str], k: int = RESERVOIR) -> DataFrame:
    """keys, key, value: the k rows of each group with the least hash of the columns by, which name a row: a uniform sample that doesn't depend on how rows are
    split, when a task ran again, or in what order reservoirs were merged. Groups of up to k rows are whole. Rows far from the k-th stay where they are."""
    hashed = rows.select(*keys, F.xxhash64(F.lit(17), *by).alias("key"), F.col(value).alias("value"))
    sizes = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in keys]).agg(F.count(F.lit(1)).alias("__n"))
    # the k-th least of n uniform keys is below this share of them but once in 10^23
    share = (F.lit(k) + 10 * F.sqrt(F.lit(float(k))) + 100) / F.col("__n")
    near = hashed.join(sizes, _same(hashed, sizes, keys)).where(F.col("key") / F.lit(2.0**64) + 0.5 <= share)
    return merge_reservoirs(near.select(*keys, "key", "value"), keys, k)


def merge_reservoirs(parts: DataFrame, keys: list[str], k: int = RESERVOIR) -> DataFrame:
    """The reservoir of the rows of several (a union of them): the k least keys of each group."""
    order = Window.partitionBy(*keys).orderBy("key", "value")
    return parts.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).drop("__r")


def chunk_weight(frame: Column, n: Column, chunk: int) -> Column:
    """How often a frame of n stands in the chunks that start at every frame, their tails filled up with the last frame."""
    short = F.least(n, F.lit(chunk - 1))
    return F.least(frame + 1, F.lit(chunk)) + F.when(frame == n - 1, short * chunk - (short * (short + 1) / 2).cast("long")).otherwise(0)


def weighted_moments(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """moments of values that stand for weight rows each, without making these. Squares are summed about the mean, so a mean that is large beside the
    spread costs no digits; whole values are summed exactly."""
    x, w = F.col(value).cast("double"), F.col(weight)
    sums = rows.groupBy(*keys).agg(F.sum(w).alias("n"), (F.sum(w * x) / F.sum(w)).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))
    means = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("mean").alias("__mean"))
    gap = x - F.col("__mean")
    spread = rows.join(means, _same(rows, means, keys)).groupBy(*[f"__{k}" for k in keys]).agg(F.sum(w * gap * gap).alias("__q"))
    out = sums.join(spread, _same(sums, spread, keys)).drop(*[f"__{k}" for k in keys])
    return out.withColumn("std", F.when(F.col("n") > 1, F.sqrt(F.col("__q") / (F.col("n") - 1))).otherwise(0.0)).drop("__q")


def checked_stats(stats: DataFrame, dim: int, width: str = "dim") -> DataFrame:
    """Statistics by dimension that can be used: fewer than two rows, a dimension without spread, or another number of dimensions is an error."""
    n, few, flat = stats.agg(F.count_distinct(width), F.count_if(F.col("n") < 2), F.count_if(~(F.col("std") > 0))).first()
    if n != dim or few or flat:
        raise ValueError(f"{n} dimensions of {dim}, {few} with fewer than two rows, {flat} without spread")
    return stats


def vector_moments(rows: DataFrame, vector: str) -> DataFrame:
    """moments by dimension of an array column."""
    return moments(rows.select(F.posexplode(vector).alias("dim", "x")), ["dim"], "x")


def merge_stats(stats: DataFrame, keys: list[str]) -> DataFrame:
    """stats: n, mean, std, min, max, q01, q99 of parts. Weighted mean, pooled variance with weights n about the common mean, count-weighted quantiles."""
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / n
    second = F.sum(F.col("n") * (F.col("std") * F.col("std") + F.col("mean") * F.col("mean"))) / n
    out = stats.groupBy(*keys).agg(
        n.alias("n"), mean.alias("mean"), second.alias("__second"), F.min("min").alias("min"), F.max("max").alias("max"),
        (F.sum(F.col("n") * F.col("q01")) / n).alias("q01"), (F.sum(F.col("n") * F.col("q99")) / n).alias("q99"),
    )
    return out.withColumn("std", F.sqrt(F.greatest(F.lit(0.0), F.col("__second") - F.col("mean") * F.col("mean")))).drop("__second")


def histogram(rows: DataFrame, keys: list[str], value: str, edges: list[float]) -> DataFrame:
    """Rows by keys and bin: bin k holds values from the k-th edge (0: below the first)."""
    bin_: Column = sum(((F.col(value) >= e).cast("int") for e in edges), F.lit(0))
    return rows.groupBy(*keys, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def weighted_mean(rows: DataFrame, keys: list[str], value: Column, weight: Column, width: int = 1) -> DataFrame:
    return rows.groupBy(*keys).agg((F.sum(value * weight) / (F.sum(weight) * width + 1e-6)).alias("value"))


def smooth_l1(a: Column, b: Column, beta: float = 1.0) -> Column:
    d = F.abs(a - b)
    return F.when(d < beta, d * d / (2 * beta)).otherwise(d - beta / 2)


def ema(values: Column, decay: float) -> Column:
    """Exponential mean of an ordered array, with decay min(decay, (1 + t) / (10 + t))."""
    start = F.struct(F.lit(0).alias("t"), F.lit(None).cast("double").alias("s"))

    def step(acc, x):
        d = F.least(F.lit(decay), (acc["t"] + 1) / (acc["t"] + 10))
        return F.struct((acc["t"] + 1).alias("t"), F.coalesce(d * acc["s"] + (1 - d) * x, x).alias("s"))

    return F.aggregate(values, start, step, lambda a: a["s"])


def one_meta(rows: DataFrame, keys: list[str], meta: list[str]) -> DataFrame:
    """keys with more than one distinct meta: what a strict merge refuses."""
    return rows.groupBy(*keys).agg(F.count_distinct(F.to_json(F.struct(*meta))).alias("kinds")).where("kinds > 1")
