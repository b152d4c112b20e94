"""Series made continuous: angles, quaternions and rotation vectors along the frames of each key, without long arrays."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unwrap_angles(rows: DataFrame, keys: list[str], order: str, value: str, period: float = 2 * math.pi) -> DataFrame:
    """value without jumps over half a period: each step's nearest turn is summed up along the order."""
    along, half = Window.partitionBy(*keys).orderBy(order), period / 2
    d = F.col("__d")
    inside = F.pmod(d + half, F.lit(period)) - half
    inside = F.when((inside == -half) & (d > 0), F.lit(half)).otherwise(inside)
    turn = F.when(d.isNull() | (F.abs(d) < half), 0.0).otherwise(inside - d)
    out = rows.withColumn("__d", F.col(value) - F.lag(value).over(along)).withColumn("__turn", turn)
    return out.withColumn(value, F.col(value) + F.sum("__turn").over(along)).drop("__d", "__turn")


def unwrap_quaternions(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Quaternions (arrays of four) with the sign nearer to the one before, which may have been turned itself; at a right angle the sign stays as it is."""
    along = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(value).over(along)
    dot = F.aggregate(F.zip_with(value, "__before", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    out = rows.withColumn("__before", before).withColumn("__dot", F.when(F.col("__before").isNull(), 0.0).otherwise(dot))
    out = out.withColumn("__run", F.sum((F.col("__dot") == 0).cast("int")).over(along))
    turns = F.sum((F.col("__dot") < 0).cast("int")).over(Window.partitionBy(*keys, "__run").orderBy(order))
    out = out.withColumn("__sign", F.when(turns % 2 == 1, -1.0).otherwise(1.0))
    return out.withColumn(value, F.transform(value, lambda x: x * F.col("__sign"))).drop("__before", "__dot", "__run", "__sign")


def unwrap_rotation_vectors(series: DataFrame, value: str, chunk: int) -> DataFrame:
    """value: a chunk's rotation vectors in order, at most chunk of them. Each one, or the same rotation the other way round, whichever is nearer to the one before; one of no length stays.

    A choice depends on the choice before, so a chunk is worked through in its row: chunks are short, and longer ones are an error.
    """
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    far = lambda a, b: norm(F.zip_with(a, b, lambda x, y: x - y))

    def step(done, r):
        n, last = norm(r), F.element_at(done, -1)
        other = F.transform(r, lambda x: -(2 * math.pi - n) * x / n)
        chosen = F.when(n < 1e-8, r).when(far(r, last) > far(other, last), other).otherwise(r)
        return F.concat(done, F.array(chosen))

    vectors = F.when(F.size(value) <= chunk, F.col(value)).otherwise(F.raise_error(F.lit("a chunk is too long")).cast("array<array<double>>"))
    return series.withColumn(value, F.aggregate(F.slice(vectors, F.lit(2), F.greatest(F.lit(0), F.size(value) - 1)), F.slice(vectors, 1, 1), step))
