"""Features of image patches: losses between predicted, target and source features, and principal components as colours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least norm and denominator, how much more a patch in motion counts, and from which motion on it counts most.
EPS, MORE, MOST = 1e-6, 5.0, 0.5
#: Widest vectors of which components are found: the driver holds a square matrix of this width.
WIDEST = 2048


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is 0."""
    norm = lambda v: F.greatest(F.sqrt(dot(v, v)), F.lit(EPS))
    return dot(a, b) / (norm(a) * norm(b))


def motion_weight(motion: Column) -> Column:
    return 1 + F.least(motion, F.lit(MOST)) * (MORE / MOST)


def contrastive(positive: Column, negative: Column, temperature: float) -> Column:
    """Cross entropy of telling the target (positive likeness) from the source (negative likeness). The larger exponent is taken out, so none overflows."""
    gap = (negative - positive) / temperature
    return F.greatest(gap, F.lit(0.0)) + F.log1p(F.exp(-F.abs(gap)))


def _squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def feature_losses(patches: DataFrame, image: list[str], patch: str, temperature: float) -> DataFrame:
    """patches: image keys, patch, predicted, target, source (arrays of one width), motion (from 0). A row an image: patches, likeness (mean cosine of predicted and target), contrast (contrastive), relative
    (squared error over the squared change from source to target): means by motion weight, and relative_moving, the mean over the tenth of the patches (one at least) that change most, the first of equals.

    A patch with a null is an error. Only numbers go through the shuffle, vectors don't."""
    held = [F.col(c).isNotNull() for c in ("predicted", "target", "source", "motion")]
    whole = (F.size("predicted") == F.size("target")) & (F.size("source") == F.size("target"))
    for h in held:
        whole = whole & h
    checked = F.when(F.coalesce(whole, F.lit(False)), F.col("motion").cast("double")).otherwise(F.raise_error(F.lit("a patch lacks a vector or its motion, or has vectors of two widths")).cast("double"))
    change = _squared(F.col("target"), F.col("source"))
    rows = patches.select(
        *image, F.col(patch).alias("__patch"), motion_weight(checked).alias("w"), cosine(F.col("predicted"), F.col("target")).alias("likeness"), cosine(F.col("predicted"), F.col("source")).alias("other"),
        change.alias("change"), (_squared(F.col("predicted"), F.col("target")) / (change + EPS)).alias("relative"),
    ).withColumn("contrast", contrastive(F.col("likeness"), F.col("other"), temperature))
    own = Window.partitionBy(*image)
    rows = rows.withColumn("__place", F.row_number().over(own.orderBy(F.desc("change"), "__patch"))).withColumn("__n", F.count(F.lit(1)).over(own))
    mean = lambda c: F.sum(F.col(c) * F.col("w")) / (F.sum("w") + EPS)
    moving = F.col("__place") <= F.greatest(F.lit(1), F.floor(F.col("__n") / 10))
    return rows.groupBy(*image).agg(F.count(F.lit(1)).alias("patches"), F.avg("likeness").alias("likeness"), mean("contrast").alias("contrast"), mean("relative").alias("relative"), F.avg(F.when(moving, F.col("relative"))).alias("relative_moving"))


def _vectors(batch: pa.RecordBatch, at: int, width: int) -> np.ndarray:
    """[rows, width]; a null vector or number, or another width, is an error."""
    column = batch.column(at)
    flat = column.flatten()
    if column.null_count or flat.null_count or len(flat) != len(column) * width or not np.array_equal(np.diff(column.offsets.to_numpy()), np.full(len(column), width)):
        raise ValueError(f"vectors of {width} numbers are needed")
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def _summed(rows: DataFrame, vector: str, width: int, made) -> np.ndarray:
    """The sum over all rows of made([rows, width]), which gives [k, m]: by task, then by row of that matrix, so that no task holds more than its own matrix or one row of each."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = made(_vectors(batch, 0, width))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    def merge(part: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(v) for v in part["v"].to_pylist()], axis=0)
        return pa.table({"i": part["i"][:1], "v": pa.array([total], pa.list_(pa.float64()))})

    parts = rows.select(vector).mapInArrow(own, "i int, v array<double>").groupBy("i").applyInArrow(merge, "i int, v array<double>")
    return np.array([r.v for r in sorted(parts.collect(), key=lambda r: r.i)])


def covariance(rows: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean [d], covariance [d, d] over n) of vectors of one width of at most WIDEST: two passes, the second about the mean, so that far means cost no digits. No rows, a null or another width is an error."""
    first = rows.select(F.size(vector)).first()
    if first is None or not 0 < first[0] <= WIDEST:
        raise ValueError(f"vectors of 1 to {WIDEST} numbers are needed, not {first and first[0]}")
    width = first[0]
    sums = _summed(rows, vector, width, lambda x: np.append(x.sum(0), len(x))[None])[0]
    n, mean = int(sums[-1]), sums[:-1] / sums[-1]
    return n, mean, _summed(rows, vector, width, lambda x: (x - mean).T @ (x - mean)) / n


def principal_components(rows: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean [d], components [k, d], variances [k]), largest variance first; a component's number of largest size (the first of equals) is positive."""
    _, mean, found = covariance(rows, vector)
    values, vectors = np.linalg.eigh(found)
    parts = vectors.T[::-1][:k]
    top = parts[np.arange(len(parts)), np.abs(np.round(parts, 9)).argmax(1)]
    return mean, parts * np.sign(top)[:, None], values[::-1][:k]


def projected(rows: DataFrame, vector: str, mean: np.ndarray, components: np.ndarray, into: str) -> DataFrame:
    """Adds into: each vector's coordinates along components, from the mean."""
    at = rows.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (_vectors(batch, at, len(mean)) - mean) @ components.T
            column = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(components)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], schema=batch.schema.append(pa.field(into, column.type)))

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(into, ArrayType(DoubleType()))]))


def as_colours(rows: DataFrame, image: list[str], coordinates: str, channels: int = 3) -> DataFrame:
    """Adds rgb: each coordinate between its image's least (0) and most (255), halved where they are one."""
    at = lambda k: F.get(coordinates, F.lit(k))
    ends = rows.groupBy(*image).agg(*[f(at(k)).alias(f"__{name}{k}") for k in range(channels) for name, f in (("low", F.min), ("high", F.max))])
    spread = lambda k: F.col(f"__high{k}") - F.col(f"__low{k}")
    share = lambda k: F.when(spread(k) > 1e-8, (at(k) - F.col(f"__low{k}")) / spread(k)).otherwise(0.5)
    both = rows.alias("r").join(ends.alias("e"), [F.col(f"r.{c}").eqNullSafe(F.col(f"e.{c}")) for c in image])
    return both.select("r.*", F.array(*[F.floor(share(k) * 255).cast("int") for k in range(channels)]).alias("rgb"))
