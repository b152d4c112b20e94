"""Displacement fields of frames: chains over intervals of frames, and three-dimensional flow from depths and poses. A field is a flat array of doubles in a row, pixels in rows of the image."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from framewright.functions import flow as ff

#: Frames of an episode that one run of rows holds at least; results are given on after so many bytes.
BLOCK, BYTES = 256, 8 << 20
_DOUBLES = ArrayType(DoubleType())


def _arrays(batch: pa.RecordBatch, column: str) -> list[np.ndarray | None]:
    """Each row's array, without a copy of its numbers."""
    found = batch.column(column)
    if found.flatten().null_count:
        raise ValueError(f"{column} has a null number")
    values, offsets = found.values.to_numpy(zero_copy_only=False), found.offsets.to_numpy()
    return [values[a:b] if known else None for a, b, known in zip(offsets[:-1], offsets[1:], found.is_valid().to_pylist())]


def _shaped(field: np.ndarray | None, height: int | None, width: int | None, channels: tuple[int, ...], what: str) -> np.ndarray:
    """A flat array as an image; another size is an error."""
    size = (height or 0) * (width or 0)
    if field is None or size <= 0 or len(field) not in {size * c for c in channels}:
        raise ValueError(f"{what}: {None if field is None else len(field)} numbers for {height} x {width} pixels")
    return field.reshape(height, width, len(field) // size)


class _Rows:
    """Result rows, given on as batches of a bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if self.size >= BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)], schema=self.schema)
        self.rows, self.size = [], 0


def chained_flows(frames: DataFrame, keys: list[str], frame: str, flow: str, height: str, width: str, stride: int, every: int = 1) -> DataFrame:
    """keys, start, flow: for each start (a multiple of every) that has stride frames, where each pixel has gone after them. Each frame's flow (to the next one) is read at the place that the pixel has
    reached, bilinearly; a pixel outside moves with the border.

    Frames of a key are numbered from 0 without gaps; a gap, a repeated or null number, no flow, or another size than the episode's is an error that names key and frame. Intervals that reach past the last
    frame aren't given. An episode is cut into runs of frames, each with the first stride - 1 of the next, so a frame is shuffled about once however far chains overlap, and a task holds one frame and its
    open chains."""
    if stride < 1 or every < 1:
        raise ValueError("stride and every are at least 1")
    block = max(BLOCK, 8 * stride)
    number = F.coalesce(F.col(frame).cast("long"), F.lit(-1).cast("long"))
    own = F.floor(number / block).cast("long")
    shared = (number % block < stride - 1) & (own > 0)
    rows = frames.select(*keys, number.alias("__frame"), F.col(flow).cast(_DOUBLES).alias("__flow"), F.col(height).cast("int").alias("__h"), F.col(width).cast("int").alias("__w"), F.explode(F.when(shared, F.array(own - 1, own)).otherwise(F.array(own))).alias("__block"))
    rows = rows.repartition(*keys, "__block").sortWithinPartitions(*keys, "__block", "__frame")
    kinds = frames.select(*keys).schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, due, shape, chains = None, None, None, None, []
        for batch in batches:
            schema = pa.schema([*(batch.schema.field(k) for k in keys), pa.field("start", pa.int64()), pa.field("flow", pa.list_(pa.float64()))])
            out = out or _Rows(schema)
            names = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows
            columns = (batch.column(c).to_pylist() for c in ("__block", "__frame", "__h", "__w"))
            for name, part, number, h, w, field in zip(names, *columns, _arrays(batch, "__flow")):
                if (name, part) != at:
                    at, due, shape, chains = (name, part), part * block, (h, w), []
                if number != due or shape != (h, w):
                    raise ValueError(f"{name}: frame {number} of {h} x {w} where {due} of {shape} was due")
                field = _shaped(field, h, w, (2,), f"{name}, frame {number}")
                if number % every == 0 and number < (part + 1) * block:
                    chains.append((number, ff.grid(h, w)))
                chains = [(start, place + ff.sampled(field, place)) for start, place in chains]
                while chains and chains[0][0] + stride - 1 == number:
                    start, place = chains.pop(0)
                    moved = (place - ff.grid(h, w)).ravel()
                    yield from out.add((*name, start, moved), moved.nbytes)
                due += 1
        if out:
            yield from out.rest()

    return rows.mapInArrow(run, StructType([*kinds, StructField("start", LongType()), StructField("flow", _DOUBLES)]))


def _each(rows: DataFrame, inputs: list[str], made: list[StructField], run_row: Callable[..., tuple[np.ndarray, ...]]) -> DataFrame:
    """rows with columns that run_row makes of each row's inputs (arrays as numpy, the others as they are)."""
    clash = {f.name for f in made} & set(rows.columns)
    if clash:
        raise ValueError(f"rows have {sorted(clash)} already")
    lists = {f.name for f in rows.schema if isinstance(f.dataType, ArrayType)}
    arrow = {"boolean": pa.bool_(), "double": pa.float64()}
    kinds = [pa.field(f.name, pa.list_(arrow[f.dataType.elementType.typeName()])) for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [_arrays(batch, c) if c in lists else batch.column(c).to_pylist() for c in inputs]
            begin, held, size = 0, [], 0
            for k, row in enumerate(zip(*columns), 1):
                held.append([a.ravel() for a in run_row(*row)])
                size += sum(a.nbytes for a in held[-1])
                if size >= BYTES or k == batch.num_rows:
                    made_now = [pa.array(list(c), f.type) for c, f in zip(zip(*held), kinds)]
                    kept = batch.slice(begin, k - begin)
                    yield pa.RecordBatch.from_arrays([*kept.columns, *made_now], schema=pa.schema([*batch.schema, *kinds]))
                    begin, held, size = k, [], 0

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *made]))


def _matrix(numbers: np.ndarray | None, rows: int, columns: int, what: str) -> np.ndarray:
    if numbers is None or len(numbers) != rows * columns:
        raise ValueError(f"{what} isn't {rows} x {columns}")
    return numbers.reshape(rows, columns)


def _pose(numbers: np.ndarray | None) -> np.ndarray:
    """3 x 4 or 4 x 4 as 4 x 4."""
    if numbers is not None and len(numbers) == 12:
        numbers = np.concatenate([numbers, [0.0, 0.0, 0.0, 1.0]])
    return _matrix(numbers, 4, 4, "a pose")


def scene_flows(rows: DataFrame, steepest: float, height: str = "height", width: str = "width") -> DataFrame:
    """Adds flow_3d (three numbers a pixel) and mask to rows of depth, next_depth, camera, next_camera (3 x 3), pose, next_pose (3 x 4 or 4 x 4, world to camera) and flow (two numbers a pixel, or three
    that are the flow already): arrays of doubles, matrices by rows. See functions.flow.scene_flow. A null or an array of another size is an error. No shuffle."""

    def run(h, w, d1, d2, k1, k2, e1, e2, flow):
        depths = np.stack([_shaped(d, h, w, (1,), "a depth")[..., 0] for d in (d1, d2)])
        cameras = np.stack([_matrix(k, 3, 3, "a camera") for k in (k1, k2)])
        return ff.scene_flow(depths, cameras, np.stack([_pose(e1), _pose(e2)]), _shaped(flow, h, w, (2, 3), "a flow"), steepest)

    inputs = [height, width, "depth", "next_depth", "camera", "next_camera", "pose", "next_pose", "flow"]
    return _each(rows, inputs, [StructField("flow_3d", _DOUBLES), StructField("mask", ArrayType(BooleanType()))], run)


def static_flows(rows: DataFrame, height: str = "height", width: str = "width") -> DataFrame:
    """Adds static_flow (three numbers a pixel) to rows of motion (rotation vector and translation), depth and camera: the flow of a scene that stands still. Refuses what scene_flows does."""

    def run(h, w, motion, depth, camera):
        return (ff.static_flow(_matrix(motion, 1, 6, "a motion")[0], _shaped(depth, h, w, (1,), "a depth")[..., 0], _matrix(camera, 3, 3, "a camera")),)

    return _each(rows, [height, width, "motion", "depth", "camera"], [StructField("static_flow", _DOUBLES)], run)
