"""Frames of Zarr version 3 arrays of byte strings, stored in shards with an index at their end: indexes and frames are read as ranges of bytes, in as many tasks as there are shards and pieces of them."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.sources.scans import PIECE, _create, _open, ranged

#: What an index holds for a chunk that isn't there, the polynomial of an index's checksum, and its bytes.
ABSENT, CASTAGNOLI, CHECK = 2**64 - 1, 0x82F63B78, 4
#: Rows that are Python objects at once while frames are written.
ROWS = 64


def crc32c(data: bytes) -> int:
    value = 0xFFFFFFFF
    for byte in data:
        value = _TABLE[(value ^ byte) & 255] ^ (value >> 8)
    return value ^ 0xFFFFFFFF


def _table() -> list[int]:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(CASTAGNOLI), out >> 1)
    return out.tolist()


_TABLE = _table()


def layout(record: dict) -> tuple[int, int, int, str, bool]:
    """(length, frames a shard, frames a chunk, separator of shard names, whether indexes have a checksum) of an array's zarr.json; another kind of array is an error."""
    codecs = record.get("codecs") or [{}]
    inner = codecs[0].get("configuration", {})
    names = [c.get("name") for c in inner.get("codecs", [])]
    index = [c.get("name") for c in inner.get("index_codecs", [{"name": "bytes"}, {"name": "crc32c"}])]
    faults = {
        "node": record.get("node_type") != "array", "data type": record.get("data_type") not in ("variable_length_bytes", "bytes"), "shape": len(record.get("shape", ())) != 1,
        "codec": len(codecs) != 1 or codecs[0].get("name") != "sharding_indexed", "inner codecs": names != ["vlen-bytes", "zstd"], "place of the index": inner.get("index_location", "end") != "end",
        "index codecs": index not in (["bytes"], ["bytes", "crc32c"]),
    }
    if wrong := [name for name, bad in faults.items() if bad]:
        raise ValueError(f"an array whose {', '.join(wrong)} can't be read")
    shard, chunk = record["chunk_grid"]["configuration"]["chunk_shape"][0], inner["chunk_shape"][0]
    if chunk < 1 or shard < 1 or shard % chunk:
        raise ValueError(f"shards of {shard} frames in chunks of {chunk}")
    return record["shape"][0], shard, chunk, record.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/"), len(index) == 2


def footer(file, chunks: int, checked: bool) -> np.ndarray:
    """[chunks, 2]: offset and size of each chunk of a shard, from its last bytes; one that is cut off, or whose checksum or ranges are wrong, is an error."""
    size = 16 * chunks + CHECK * checked
    if file.size() < size:
        raise ValueError("a shard that is shorter than its index")
    data = file.read_at(size, file.size() - size)
    if checked and crc32c(data[:-CHECK]) != struct.unpack("<I", data[-CHECK:])[0]:
        raise ValueError("a shard's index with a wrong checksum")
    found = np.frombuffer(data, "<u8", 2 * chunks).reshape(chunks, 2)
    there = found[found[:, 0] != ABSENT]
    room = np.uint64(file.size() - size)
    if (there[:, 0] > room).any() or (there[:, 1] > room - np.minimum(there[:, 0], room)).any():
        raise ValueError("a shard's index that points beyond its chunks")
    return found


def elements(data: bytes) -> list[bytes]:
    """The byte strings of one chunk; a chunk that ends too early is an error."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    n, at, out = struct.unpack_from("<I", data)[0], 4, []
    for _ in range(n):
        size = struct.unpack_from("<I", data, at)[0]
        at += 4 + size
        if at > len(data):
            raise ValueError("a chunk that ends within a frame")
        out.append(data[at - size : at])
    return out


def zarr_lengths(arrays: DataFrame) -> DataFrame:
    """arrays: path. Adds length (the array's shape, whatever other records say) and its layout: per_shard, per_chunk, separator, checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                with _open(f"{path}/zarr.json") as file:
                    record = json.loads(file.read())
                try:
                    rows.append((path, *layout(record)))
                except (ValueError, KeyError, IndexError, TypeError) as fault:
                    raise ValueError(f"{path}: {fault}") from fault
            kinds = pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "length", "per_shard", "per_chunk", "separator", "checked"])

    return arrays.select("path").distinct().mapInArrow(run, "path string, length long, per_shard long, per_chunk long, separator string, checked boolean")


def read_zarr_frames(arrays: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """path, frame, content: the frames of arrays (path: their folders), or of those only that are wanted (path, frame; repeated ones count once). Of wanted frames only their shards' indexes and their own
    chunks are read. A frame outside of its array or in no chunk, an array that isn't given, and a faulty index or chunk are errors that name the array."""
    known = zarr_lengths(arrays)
    if wanted is None:
        shards = known.where("length > 0").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(length - 1) div per_shard"))))
    else:
        frames = wanted.select("path", F.col("frame").cast("long").alias("frame")).distinct().join(known, "path", "left")
        outside = F.coalesce((F.col("frame") < 0) | (F.col("frame") >= F.col("length")), F.lit(True))
        frames = frames.withColumn("frame", F.when(outside, F.raise_error(F.concat(F.coalesce("path", F.lit("null")), F.lit(": no frame "), F.coalesce(F.col("frame").cast("string"), F.lit("null")))).cast("long")).otherwise(F.col("frame")))
        chunks = frames.select("*", F.expr("frame div per_shard").alias("shard"), F.expr("frame div per_chunk").alias("chunk"))
        shards = chunks.select(*known.columns, "shard").distinct()
    shards = shards.repartition("path", "shard")

    def indexes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("array", pa.string()), ("chunk", pa.int64()), ("n", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])
        for batch in batches:
            for path, length, per_shard, per_chunk, separator, checked, shard in zip(*(c.to_pylist() for c in batch.columns)):
                name = f"{path}/c{separator}{shard}"
                with _open(name) as file:
                    try:
                        found = footer(file, per_shard // per_chunk, checked)
                    except ValueError as fault:
                        raise ValueError(f"{name}: {fault}") from fault
                first = shard * (per_shard // per_chunk)
                chunk = np.arange(first, min(first + len(found), -(-length // per_chunk)))
                found = found[: len(chunk)]
                gone = found[:, 0] == ABSENT
                at = [pa.array(np.where(gone, 0, found[:, k]).astype(np.int64), mask=gone) for k in range(2)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(chunk), pa.string()), pa.array(chunk), pa.array(np.minimum(per_chunk, length - chunk * per_chunk)), pa.array([name] * len(chunk), pa.string()), *at], schema=schema)

    ranges = shards.select(*known.columns, "shard").mapInArrow(indexes, "array string, chunk long, n long, path string, offset long, size long")
    ranges = ranges.join(known.select(F.col("path").alias("array"), "per_chunk"), "array")
    if wanted is not None:
        ranges = ranges.join(chunks.select(F.col("path").alias("array"), "chunk").distinct(), ["array", "chunk"], "left_semi")
    absent = F.raise_error(F.concat("array", F.lit(": no chunk "), F.col("chunk").cast("string"))).cast("long")
    ranges = ranges.withColumn("size", F.coalesce("size", absent)).repartition(F.col("path"), F.floor(F.col("offset") / (64 << 20))).sortWithinPartitions("path", "offset")
    ranges = ranges.select("array", "chunk", "n", "per_chunk", "path", "offset", "size")
    read = ranged(ranges.columns)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # read and decoded in one go: chunks don't leave the task in between, and no more frames than PIECE bytes (or one chunk) are held
        for batch in read(batches):
            arrays, numbers, contents, held = [], [], [], 0
            for array, chunk, n, per_chunk, data in zip(*(batch.column(c) for c in ("array", "chunk", "n", "per_chunk", "content"))):
                array, chunk, n, per_chunk = array.as_py(), chunk.as_py(), n.as_py(), per_chunk.as_py()
                try:
                    found = elements(data.as_py())[:n]
                    if len(found) < n:
                        raise ValueError(f"{len(found)} frames where {n} were due")
                except Exception as fault:
                    raise ValueError(f"{array}, chunk {chunk}: {fault}") from fault
                arrays += [array] * n
                numbers += range(chunk * per_chunk, chunk * per_chunk + n)
                contents += found
                held += sum(map(len, found))
                if held > PIECE:
                    yield _frames(arrays, numbers, contents)
                    arrays, numbers, contents, held = [], [], [], 0
            yield _frames(arrays, numbers, contents)

    found = ranges.mapInArrow(decoded, "path string, frame long, content binary")
    return found if wanted is None else found.join(frames.select("path", "frame"), ["path", "frame"], "left_semi")


def _frames(arrays: list[str], numbers: list[int], contents: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(arrays, pa.string()), pa.array(numbers, pa.int64()), pa.array(contents, pa.binary())], names=["path", "frame", "content"])


def write_zarr_frames(rows: DataFrame, per_shard: int, per_chunk: int = 1) -> None:
    """rows: path, frame, content. An array a path, its frames numbered from 0 without gaps (else an error). A task writes whole shards, one after the other, and holds one chunk and its shard's index;
    one that runs again writes the same. An array's record is written last."""
    if per_chunk < 1 or per_shard < 1 or per_shard % per_chunk:
        raise ValueError(f"shards of {per_shard} frames in chunks of {per_chunk}")
    rows = rows.select("path", F.col("frame").cast("long").alias("frame"), F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"))
    own = rows.withColumn("shard", F.expr(f"frame div {per_shard}")).repartition("path", "shard").sortWithinPartitions("path", "shard", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        at, due, out, held, index = None, 0, None, [], []

        def end_chunk() -> None:
            if held:
                body = struct.pack("<I", len(held)) + b"".join(struct.pack("<I", len(c)) + c for c in held)
                data = zstandard.ZstdCompressor().compress(body)
                index.append((out.tell(), len(data)))
                out.write(data)
                held.clear()

        def end_shard() -> None:
            end_chunk()
            places = index + [(ABSENT, ABSENT)] * (per_shard // per_chunk - len(index))
            data = np.array(places, "<u8").tobytes()
            out.write(data + struct.pack("<I", crc32c(data)))
            out.close()

        done = []
        for batch in batches:
            for path, frame, content, shard in (row for k in range(0, batch.num_rows, ROWS) for row in zip(*(c.to_pylist() for c in batch.slice(k, ROWS).columns))):
                if (path, shard) != at:
                    if out:
                        end_shard()
                        done.append((at[0], due))
                    at, due, index = (path, shard), shard * per_shard, []
                    out = _create(f"{path}/c/{shard}")
                if frame != due:
                    raise ValueError(f"{path}: frame {frame} where {due} was due")
                held.append(content)
                due += 1
                if len(held) == per_chunk:
                    end_chunk()
        if out:
            end_shard()
            done.append((at[0], due))
        columns = list(zip(*done)) if done else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64())], names=["path", "upto"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for path, length, shards in zip(*(c.to_pylist() for c in batch.columns)):
                if shards != -(-length // per_shard):
                    raise ValueError(f"{path}: {shards} shards for {length} frames")
                inner = {"chunk_shape": [per_chunk], "codecs": [{"name": "vlen-bytes"}, {"name": "zstd"}], "index_codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}], "index_location": "end"}
                record = {"zarr_format": 3, "node_type": "array", "shape": [length], "data_type": "variable_length_bytes", "fill_value": "", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [per_shard]}}}
                record |= {"chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "codecs": [{"name": "sharding_indexed", "configuration": inner}]}
                with _create(f"{path}/zarr.json") as file:
                    file.write(json.dumps(record).encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    shards = own.mapInArrow(run, "path string, upto long").groupBy("path").agg(F.max("upto").alias("length"), F.count(F.lit(1)).alias("shards"))
    shards.mapInArrow(records, "n long").agg(F.sum("n")).collect()
