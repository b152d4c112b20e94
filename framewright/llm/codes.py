"""Compression of vectors to codes: a codebook for each of eight parts, trained on all rows with Elkan's bounds.

A row keeps, for each part, its entry, an upper bound of the distance to it and a lower bound of the distance to every entry. When entries move,
the bounds move with them. An entry is passed over if its lower bound, or half its distance to the row's entry, is strictly above the upper
bound: it can't be as near, so ties are never passed over. All others are compared in integers. Bounds are floats, rounded outwards; the rows'
state is a table in the shared folder for each round, and the sums that move the entries are exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import fresh_path, hot_keys, made, remove_made, spread_join, written
from framewright.llm.vectors import matrix, usable, widest

#: Largest component after scaling for which squared distances of eight components are longs.
LARGEST = 1 << 28
#: Labels whose sums are broadcast; more are joined by shuffling.
LABELS = 10_000
_STATE = "vec_id long, label string, vector binary, code binary, upper binary, lower binary"
_UP, _DOWN = np.float32(1 + 1e-6), np.float32(1 - 1e-6)


def outwards(x: np.ndarray, up: bool) -> np.ndarray:
    """Distances (float64) as float32 that are surely not below, or not above, them."""
    return x.astype(np.float32) * (_UP if up else _DOWN)


def assign(vectors: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """One part of one round: vectors [n, w] and entries [k, w] are integers, moved the entries' movements; code, upper [n] and lower [n, k] are changed in place.
    Returns how many distances were computed."""
    n, k = lower.shape
    upper += outwards(moved, True)[code]
    upper *= _UP
    lower -= outwards(moved, True)
    np.maximum(lower, 0, out=lower)
    lower *= _DOWN
    between = entries[:, None] - entries
    half = outwards(np.sqrt((between * between).sum(2, dtype=np.float64)) / 2, False)

    def near(rows: np.ndarray) -> np.ndarray:
        u = upper[rows, None]
        open_ = (lower[rows] <= u) & (half[code[rows]] <= u)
        open_[np.arange(len(rows)), code[rows]] = False
        return open_

    rows = np.arange(n)
    rows = rows[near(rows).any(1)]
    gap = vectors[rows] - entries[code[rows]]
    own = (gap * gap).sum(1)
    upper[rows], lower[rows, code[rows]] = outwards(np.sqrt(own), True), outwards(np.sqrt(own), False)
    open_ = near(rows)
    at, entry = np.nonzero(open_)
    if len(at):
        gap = vectors[rows[at]] - entries[entry]
        squares = (gap * gap).sum(1)
        lower[rows[at], entry] = outwards(np.sqrt(squares), False)
        distances = np.full((len(rows), k), np.iinfo(np.int64).max)
        distances[at, entry] = squares
        distances[np.arange(len(rows)), code[rows]] = own
        best = distances.argmin(1)  # the first of equals
        code[rows] = best
        upper[rows] = outwards(np.sqrt(distances[np.arange(len(rows)), best]), True)
    return len(rows) + len(at)


def _column(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape).copy()


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def quantized(vectors: DataFrame, factor: int, parts: int) -> tuple[DataFrame, int]:
    """(vec_id, label, vector: whole components floor(factor * x) as 32-bit integers; components of a part)."""
    rows = usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector")), "vector")
    width = -(-widest(rows, "vector") // parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.floor(matrix(batch.column(2), width * parts) * factor)
            if found.size and np.abs(found).max() > LARGEST * np.sqrt(8 / max(8, width)):
                raise OverflowError(f"a component is over {LARGEST} after scaling")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(found.astype(np.int32))], names=["vec_id", "label", "vector"])

    return written(rows.mapInArrow(run, "vec_id long, label string, vector binary"), "codes-vectors"), width


def _round(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """The rows' state after assigning; moved is None in the first round, when they have none. books: [parts, entries, width]."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            vectors = _column(batch.column(2), "<i4", parts, width).astype(np.int64)
            if moved is None:
                code, upper, lower = np.zeros((n, parts), np.uint8), np.full((n, parts), np.inf, np.float32), np.zeros((n, parts, k), np.float32)
            else:
                code, upper, lower = _column(batch.column(3), "u1", parts), _column(batch.column(4), "<f4", parts), _column(batch.column(5), "<f4", parts, k)
            for p in range(parts):
                assign(vectors[:, p], books[p], np.zeros(k) if moved is None else moved[p], code[:, p], upper[:, p], lower[:, p])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _binary(code), _binary(upper), _binary(lower.reshape(n, -1))], names=["vec_id", "label", "vector", "code", "upper", "lower"])

    return rows.mapInArrow(run, _STATE)


def entry_sums(state: DataFrame, parts: int, k: int, width: int) -> np.ndarray:
    """[parts, entries, 1 + width]: how many rows have an entry, and the sums of their parts. A row a task and entry is merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, k, 1 + width), np.int64)
        for batch in batches:
            vectors, code = _column(batch.column(0), "<i4", parts, width).astype(np.int64), _column(batch.column(1), "u1", parts)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                entry, first = np.unique(code[order, p], return_index=True)
                sums[p, entry, 1:] += np.add.reduceat(vectors[order, p], first, axis=0)
                sums[p, :, 0] += np.bincount(code[:, p], minlength=k)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(parts * k + 1, dtype=np.int32) * (1 + width)), pa.array(sums.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts * k, dtype=np.int32)), lists], names=["entry", "sums"])

    found = state.select("vector", "code").mapInArrow(run, "entry int, sums array<long>")
    found = found.groupBy("entry").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(1 + width)]).alias("sums"))
    out = np.zeros((parts * k, 1 + width), np.int64)
    for entry, sums in found.collect():  # parts * k rows
        out[entry] = sums
    return out.reshape(parts, k, 1 + width)


def train(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, factor: int = 4096) -> tuple[DataFrame | None, np.ndarray]:
    """(state: the rows with their codes after the last round; codebooks [parts, entries, width]). None without rows, fewer entries with fewer rows."""
    spark = vectors.sparkSession
    rows, width = quantized(vectors, factor, parts)
    first = [r.vector for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()]
    if not first or not width:
        return (None if not first else rows), np.zeros((parts, len(first), width), np.int64)
    books = np.stack([np.frombuffer(x, "<i4").reshape(parts, width) for x in first], 1).astype(np.int64)
    state, moved = rows, None
    for round_ in range(rounds + 1):
        before = made()
        path = fresh_path(spark, "codes-state")
        _round(state, books, moved).write.parquet(path)
        remove_made(spark, before, before - 1)  # the vectors or the last round's state, which nothing reads any more
        state = spark.read.schema(_STATE).parquet(path)
        if round_ == rounds:
            break
        sums = entry_sums(state, *books.shape)
        n = sums[:, :, :1]
        following = np.where(n > 0, sums[:, :, 1:] // np.maximum(n, 1), books)
        moved = np.sqrt(((following - books) ** 2).sum(2, dtype=np.float64))
        books = following
    return state, books


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, factor: int = 4096) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: a row a row that can be used.

    Repeated rows keep a row each; of repeated ids among the first entries the smaller vector comes first, null ids come last. Null labels are one
    label. Vectors whose length the parts don't divide, or that are shorter than others, count as filled up with zeros; empty ones too. With fewer rows than
    entries there are fewer entries. A component over 2^28 after scaling is an error. Other columns aren't read. An empty table gives an empty result.
    """
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    state, books = train(vectors, parts, entries, rounds, factor)
    if state is None:
        return vectors.sparkSession.createDataFrame([], schema)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    n_parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if width:
                rows, code = _column(batch.column(2), "<i4", n_parts, width).astype(np.int64), _column(batch.column(3), "u1", n_parts)
                gap = rows - books[np.arange(n_parts), code]
                codes, error = [x.tobytes().hex() for x in code], (gap * gap).sum((1, 2))
            else:
                codes, error = ["00" * n_parts] * batch.num_rows, np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    wanted = state if width else state.withColumn("code", F.lit(b""))
    rows = written(wanted.select("vec_id", "label", "vector", "code").mapInArrow(run, "vec_id long, label string, code string, error long"), "codes-rows")
    rows = rows.withColumn("__label", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    sums = written(rows.groupBy("__label").agg(F.sum("error").alias("label_error")), "codes-labels")
    if sums.count() <= LABELS:
        out = rows.join(F.broadcast(sums), "__label")
    else:
        out = spread_join(rows, sums, "__label", "vec_id", hot_keys(rows, "__label", rows.count()))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
