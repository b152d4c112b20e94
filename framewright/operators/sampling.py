"""Deterministic samples, epochs and batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.ranges import running


def spread(*columns: Column, seed: int = 0) -> Column:
    """60 even bits of the columns and a seed, as every engine with md5 has them."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns])), 1, 15), 16, 10).cast("long")


def selected(rate: float, *columns: Column, seed: int = 0) -> Column:
    """True for about rate of all keys, the same ones on every run; a smaller rate's are a subset."""
    return spread(*columns, seed=seed) < F.lit(int(rate * (1 << 60)))


def in_shard(position: Column, n_shards: int, shard: int) -> Column:
    """Round robin by position from 1."""
    return F.pmod(position - 1, F.lit(n_shards)) == shard


def episode_windows(episodes: DataFrame, block: int, seed: int) -> DataFrame:
    """episodes: episode, count. Adds block: episodes of like counts together, in a random order of blocks.

    Episodes are divided by the power of two of their count and a hash; blocks of about block of them need no global sort.
    """
    level = F.floor(F.log2(F.greatest(F.lit(1), F.col("count"))))
    sizes = episodes.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    out = episodes.withColumn("level", level).join(F.broadcast(sizes), "level")
    inner = F.pmod(spread(F.col("episode"), seed=seed), F.ceil(F.col("n") / block))
    return out.withColumn("part", inner).withColumn("block", spread(F.col("level"), inner, seed=seed + 1)).drop("n")


def epoch_order(episodes: DataFrame, block: int, seed: int) -> DataFrame:
    """A row for each sample, with block, turn (its number within the episode) and rank (the episode's in its block): ordered by them,
    a block's episodes take turns, so neighbours are of different episodes and memory holds one block."""
    ranked = episode_windows(episodes, block, seed)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("level", "part").orderBy(spread(F.col("episode"), seed=seed + 2), "episode")))
    return ranked.where("count > 0").select("episode", "block", "rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count").cast("long") - 1)).alias("turn"))


def numbered(rows: DataFrame, group: list[str], key: str, place: str, n: str, seed: int = 0) -> DataFrame:
    """Adds the row's place within its group in a hash order, and the group's size."""
    out = running(rows, group, [spread(F.col(key), seed=seed), F.col(key)], place)
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias(n))
    # without groups one row; else a row a group, and a hot group's rows are a skewed join that Spark divides
    return out.join(sizes, group) if group else out.join(F.broadcast(sizes))


def rank_batches(rows: DataFrame, group: list[str], key: str, size: int, replicas: int, seed: int = 0) -> DataFrame:
    """Full batches of size within each group, in a hash order, as many for each replica: batch, replica. Rows of the rest are left out."""
    out = numbered(rows, group, key, "__at", "__n", seed)
    out = out.withColumn("batch", F.expr(f"__at div {size}")).where(F.col("batch") < F.expr(f"(__n div {size} div {replicas}) * {replicas}"))
    return out.withColumn("replica", F.pmod(F.col("batch"), F.lit(replicas))).drop("__at", "__n")


def locality_window(micro_batch: int, accumulation: int, workers: int, replicas: int, window: int | None = None) -> int:
    """Episodes that take turns in a block: by default a worker's stride between its batches; another number must divide that stride, and be more than
    replicas * (local batch - 1), so that no micro-batch has two samples of an episode."""
    local = micro_batch * accumulation
    whole = local * workers * replicas
    window = whole if window is None else window
    if window < replicas * (local - 1) + 1:
        raise ValueError(f"a window of {window} puts samples of one episode into one micro-batch; at least {replicas * (local - 1) + 1}")
    if whole % window:
        raise ValueError(f"a window of {window} doesn't divide the stride {whole}")
    return window


def locality_rows(episodes: DataFrame, total: int, window: int, seed: int) -> DataFrame | None:
    """episodes: episode, count. A row a sample with block, turn and rank, for an order by them: episodes sorted by count and then at random are cut into windows,
    whose blocks come in a random order; in a block the episodes take turns, and shorter ones fall out. None, so that the caller shuffles freely, where counts
    are negative, don't add up to total, or are of fewer episodes than a window."""
    n, least, have = episodes.agg(F.count(F.lit(1)), F.min("count"), F.sum("count")).first()
    if n < window or least < 0 or have != total:
        return None
    ranked = running(episodes, [], [F.col("count"), spread(F.col("episode"), seed=seed), F.col("episode")], "__at")
    ranked = ranked.select("episode", "count", F.expr(f"__at div {window}").alias("window"), F.pmod("__at", F.lit(window)).alias("rank")).where("count > 0")
    ranked = ranked.withColumn("block", spread(F.col("window"), seed=seed + 1))
    return ranked.select("episode", "block", "window", "rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count").cast("long") - 1)).alias("turn"))


def epoch_batches(samples: DataFrame, n: int, order: list[Column], micro_batch: int, accumulation: int, replicas: int, drop_last: bool) -> DataFrame:
    """samples of an epoch in an order: replica, batch, step (of the batch's micro-batches) and place within it. Without drop_last the last batch is filled with the epoch's
    first samples again; no whole batch and drop_last is an error."""
    size = micro_batch * accumulation * replicas
    batches = n // size if drop_last else -(-n // size)
    if not batches:
        raise ValueError(f"{n} samples make no batch of {size}")
    out = running(samples, [], order, "at")
    again = F.when(F.col("at") < batches * size - n, F.array(F.col("at"), F.col("at") + n)).otherwise(F.array("at"))
    if batches * size > 2 * n:
        again = F.filter(F.transform(F.sequence(F.lit(0), F.lit(batches * size // n)), lambda k: F.col("at") + k * n), lambda x: x < batches * size)
    out = out.withColumn("at", F.explode(again)).where(F.col("at") < batches * size)
    own = F.expr(f"at div {replicas}")
    local = micro_batch * accumulation
    return out.withColumn("replica", F.pmod("at", F.lit(replicas))).withColumn("batch", F.floor(own / local)).withColumn("step", F.floor(F.pmod(own, F.lit(local)) / micro_batch)).withColumn("place", F.pmod(own, F.lit(micro_batch)))


def least_loaded(rows: DataFrame, key: str, length: str, workers: int, lengths: int = 100_000) -> DataFrame:
    """rows: key, length (whole numbers above 0). Adds worker, as if rows came longest first (then by key), each to the worker with the least so far, the first of equals.

    Rows of one length are worked out together: a worker with load x takes its share at x, x + length, x + 2 length and so on, in the order of these. So the driver
    holds a row a length, and the rows themselves are ranked on executors. More distinct lengths than the bound are an error: round them up first.
    """
    loads, shares = np.zeros(workers, np.int64), []
    counts = rows.groupBy(length).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc(length)).limit(lengths + 1).collect()
    if len(counts) > lengths:
        raise ValueError(f"more than {lengths} distinct lengths; round them up first")
    for size, n in counts:
        low, high = int(loads.min()), int(loads.min()) + n * size
        taken = lambda level: np.maximum(0, -(-(level - loads) // size))  # noqa: E731 - rows that workers take below a level
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if taken(middle).sum() <= n else (low, middle - 1)
        own = taken(low)
        at_level = np.flatnonzero(loads + own * size == low)[: n - int(own.sum())]
        own[at_level] += 1
        shares += [(int(size), w, int(loads[w]), int(k)) for w, k in enumerate(own) if k]
        loads += own * size
    spark = rows.sparkSession
    turns = spark.createDataFrame(shares, "size long, worker int, load long, turns long")
    turns = turns.withColumn("at", F.explode(F.expr("transform(sequence(0L, turns - 1), k -> load + k * size)")))
    turns = running(turns, ["size"], [F.col("at"), F.col("worker")], "__turn").select(F.col("size").alias(length), "__turn", "worker")
    return running(rows, [length], [F.col(key)], "__turn").join(turns, [length, "__turn"]).drop("__turn")


def top_by_key(rows: DataFrame, group: list[str], key: str, k: int, seed: int = 0) -> DataFrame:
    """A uniform sample of k rows a group: those of least hash."""
    order = Window.partitionBy(*group).orderBy(spread(F.col(key), seed=seed), key)
    return rows.withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= k).drop("__at")


def substitute(index: Column, attempt: Column, n: Column) -> Column:
    """The sample to read when index failed attempt times."""
    return F.pmod(index + attempt * 9973, n)


def padded_lengths(rows: DataFrame, batch: str, length: str) -> DataFrame:
    """What padding a batch to its longest costs: batch, rows, longest, padding."""
    return rows.groupBy(batch).agg(F.count(F.lit(1)).alias("rows"), F.max(length).alias("longest"), (F.count(F.lit(1)) * F.max(length) - F.sum(length)).alias("padding"))


def padded(rows: DataFrame, batch: str, fills: dict[str, Column], left: bool = True) -> DataFrame:
    """Arrays of a batch's rows padded to the batch's longest: fills says with what each column is (tokens with their pad, labels with -100, slots of views with zeros).

    A row's arrays are of one length, else it's an error; null arrays are empty. Adds mask (true at what was there) and position (from 0 at the first entry that was there; before it -1,
    after the last one on). Tokens are padded on the left, views on the right. A batch's length is one number that is joined to its rows; no task holds a batch.
    """
    first, *others = fills
    own = {c: F.coalesce(F.col(c), F.slice(F.array(fill), 1, 0)) for c, fill in fills.items()}
    rows = rows.withColumns(own)
    same = F.lit(True)
    for c in others:
        same = same & (F.size(c) == F.size(first))
    size = F.when(same, F.size(first)).otherwise(F.raise_error(F.lit("a row's arrays differ in length")).cast("int"))
    rows = rows.withColumn("__size", size)
    longest = rows.groupBy(batch).agg(F.max("__size").alias("__longest")).withColumnRenamed(batch, "__batch")
    rows = rows.join(longest, rows[batch].eqNullSafe(longest["__batch"])).withColumn("__pad", F.col("__longest") - F.col("__size"))
    fill = lambda value, what: F.concat(*[F.array_repeat(what, F.col("__pad")), value][:: 1 if left else -1])
    places = F.transform(F.array_repeat(F.lit(0), F.col("__longest")), lambda _, k: k - (F.col("__pad") if left else 0))
    out = rows.withColumns({c: fill(F.col(c), what) for c, what in fills.items()} | {"mask": fill(F.array_repeat(F.lit(True), F.col("__size")), F.lit(False)), "position": F.transform(places, lambda k: F.greatest(k, F.lit(-1)))})
    return out.drop("__size", "__longest", "__batch", "__pad")


def packed_offsets(rows: DataFrame, batch: str, order: str, length: str) -> DataFrame:
    """Where each sequence begins and ends in its batch's packed row."""
    sums = Window.partitionBy(batch).orderBy(order)
    return rows.withColumn("end", F.sum(length).over(sums.rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col(length))
