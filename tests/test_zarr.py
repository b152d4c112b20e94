"""Sharded arrays written and read back, in part and whole, and arrays with faults."""

import json

import pytest
from framewright.sources import zarr
from pyspark.errors import PySparkException


def store(spark, folder, lengths, per_shard, per_chunk):
    rows = [(f"{folder}/{name}", k, bytes([k % 251]) * (k * 37 % 91)) for name, n in lengths.items() for k in range(n)]
    zarr.write_zarr_frames(spark.createDataFrame(rows, "path string, frame long, content binary").repartition(3), per_shard, per_chunk)
    return {(p, k): c for p, k, c in rows}, spark.createDataFrame([(f"{folder}/{n}",) for n in lengths], "path string")


def test_checksum_of_a_known_text():
    assert zarr.crc32c(b"123456789") == 0xE3069283 and zarr.crc32c(b"") == 0


@pytest.mark.parametrize("per_shard,per_chunk", [(10, 1), (12, 4), (1, 1)])
def test_frames_come_back(spark, tmp_path, per_shard, per_chunk):
    want, arrays = store(spark, tmp_path, {"a": 37, "b": 12, "c": 1}, per_shard, per_chunk)
    rows = zarr.read_zarr_frames(arrays)
    assert {(r.path, r.frame): bytes(r.content) for r in rows.collect()} == want and rows.count() == len(want)
    some = [k for k in want if k[1] % 9 == 0]
    got = zarr.read_zarr_frames(arrays, spark.createDataFrame(some + some[:2], "path string, frame long"))
    assert sorted((r.path, r.frame) for r in got.collect()) == sorted(some)
    assert all(bytes(r.content) == want[r.path, r.frame] for r in got.collect())
    assert {r.path.rpartition("/")[2]: r.length for r in zarr.zarr_lengths(arrays).collect()} == {"a": 37, "b": 12, "c": 1}
    assert zarr.read_zarr_frames(arrays.limit(0)).count() == 0


@pytest.mark.parametrize("frame", [-1, 5, None])
def test_frames_outside_are_errors(spark, tmp_path, frame):
    _, arrays = store(spark, tmp_path, {"a": 5}, 4, 2)
    with pytest.raises(PySparkException, match="no frame"):
        zarr.read_zarr_frames(arrays, spark.createDataFrame([(f"{tmp_path}/a", frame)], "path string, frame long")).collect()
    with pytest.raises(PySparkException, match="no frame"):
        zarr.read_zarr_frames(arrays, spark.createDataFrame([(f"{tmp_path}/b", 0)], "path string, frame long")).collect()


def test_gaps_and_repeats_arent_written(spark, tmp_path):
    for k, frames in enumerate([(0, 2), (0, 0), (1, 2), (0, 1, 2, 3, 8)]):
        rows = spark.createDataFrame([(f"{tmp_path}/{k}", f, b"x") for f in frames], "path string, frame long, content binary")
        with pytest.raises(PySparkException):
            zarr.write_zarr_frames(rows, 4)
        assert not (tmp_path / str(k) / "zarr.json").exists()


def test_faulty_shards_are_errors(spark, tmp_path):
    want, arrays = store(spark, tmp_path, {"a": 6}, 4, 1)
    shard = tmp_path / "a" / "c" / "1"
    whole = shard.read_bytes()
    faults = {"checksum": whole[:-6] + b"\1" + whole[-5:], "shorter": whole[-20:], "chunk 4": bytes([0] * 8) + whole[8:]}
    for match, data in faults.items():
        shard.write_bytes(data)
        with pytest.raises(PySparkException, match=match):
            zarr.read_zarr_frames(arrays).collect()
    shard.write_bytes(whole)
    # an index of no checksum, and a chunk that isn't there
    record = json.loads((tmp_path / "a" / "zarr.json").read_text())
    record["shape"] = [7]
    (tmp_path / "a" / "zarr.json").write_text(json.dumps(record))
    with pytest.raises(PySparkException, match="no chunk 6"):
        zarr.read_zarr_frames(arrays).collect()
    one = spark.createDataFrame([(f"{tmp_path}/a", 5)], "path string, frame long")
    assert [bytes(r.content) for r in zarr.read_zarr_frames(arrays, one).collect()] == [want[f"{tmp_path}/a", 5]]
    for key, value in {"node_type": "group", "data_type": "int8", "shape": [2, 2], "codecs": [{"name": "bytes"}]}.items():
        with pytest.raises(ValueError):
            zarr.layout({**record, key: value})


def test_a_task_holds_pieces_of_its_ranges(tmp_path):
    """A batch of ranges is handed on in pieces of so many bytes, and was in one before."""
    import pyarrow as pa
    from framewright.sources import scans

    (tmp_path / "f").write_bytes(bytes(range(100)))
    sizes = [10, 10, 10, 40, 5, 5, 20]
    offsets = [sum(sizes[:k]) for k in range(len(sizes))]
    batch = pa.RecordBatch.from_pydict({"path": [str(tmp_path / "f")] * 7, "offset": offsets, "size": sizes})
    got = list(scans.ranged(["path", "offset", "size"], 25)(iter([batch, batch.slice(0, 0)])))
    assert [b.column("size").to_pylist() for b in got] == [[10, 10], [10], [40], [5, 5], [20], []]
    assert b"".join(c for b in got for c in b.column("content").to_pylist()) == bytes(range(100))
    assert [c for b in got for c in b.column("offset").to_pylist()] == offsets
