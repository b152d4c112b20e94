"""Latent files: npz archives and safetensors, read and checked inside tasks from the bytes that Spark's binaryFile reader brings."""

from __future__ import annotations

import ast
import io
import json
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The meta record of a latent file, as the manifest needs it.
META = "struct<num_latents:int,num_frames:int,code_shape:array<int>,fps:double,protocol:struct<gap:int,pair_stride:int,start_frame:int,end_frame:int,representation:string,source:string>>"
#: Bytes at a file's end in which the meta member is looked for.
TAIL = 1 << 16


def npy_header(data: bytes, at: int) -> tuple[dict, int]:
    """The header of an npy at a place, versions 1 to 3, and where its values begin."""
    if data[at : at + 6] != b"\x93NUMPY":
        raise ValueError("no npy here")
    sizes = {1: "<H", 2: "<I", 3: "<I"}
    if data[at + 6] not in sizes:
        raise ValueError(f"npy version {data[at + 6]}")
    kind = sizes[data[at + 6]]
    begin = at + 8 + struct.calcsize(kind)
    end = begin + struct.unpack_from(kind, data, at + 8)[0]
    return ast.literal_eval(data[begin:end].decode("latin1")), end


def tail_meta(tail: bytes) -> str:
    """The text of an npz's member meta.npy, stored without compression, found from its local header in the file's last bytes."""
    at = len(tail)
    while (at := tail.rfind(b"PK\x03\x04", 0, at)) >= 0:
        method, = struct.unpack_from("<H", tail, at + 8)
        name, extra = struct.unpack_from("<HH", tail, at + 26)
        if tail[at + 30 : at + 30 + name] == b"meta.npy" and method == 0:
            header, begin = npy_header(tail, at + 30 + name + extra)
            kind = np.dtype(header["descr"])
            raw = tail[begin : begin + kind.itemsize * int(np.prod(header["shape"], dtype=np.int64))]
            if len(raw) < kind.itemsize:
                raise ValueError("the meta member is cut off")
            return raw.decode("utf-32-le" if kind.kind == "U" else "utf-8").rstrip("\0")
    raise ValueError("no meta member in the tail")


def probe(data: bytes, tail: int = TAIL) -> tuple[str | None, str]:
    """(meta, how): tail, npz (the whole archive had to be read) or unreadable_latent."""
    try:
        text = tail_meta(data[-tail:])
        json.loads(text)
        return text, "tail"
    except Exception:  # noqa: BLE001 - any fault of the tail means the whole file is tried
        pass
    try:
        with np.load(io.BytesIO(data), allow_pickle=False) as archive:
            text = str(archive["meta"])
        json.loads(text)
        return text, "npz"
    except Exception:  # noqa: BLE001 - the status is the result
        return None, "unreadable_latent"


def is_complete(data: bytes, members: tuple[str, ...] = ("latent_action.npy", "pair_indices.npy", "meta.npy")) -> bool:
    """Whether an npz has its members whole: a file that was cut off has no directory, or a member with a wrong checksum."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            return set(members) <= set(archive.namelist()) and archive.testzip() is None
    except (zipfile.BadZipFile, ValueError, EOFError, OSError):
        return False


def latent_array(name: str, data: bytes) -> np.ndarray:
    """latent_action, [T, width], of an npz or by its suffix a safetensors file."""
    if not name.endswith(".safetensors"):
        with np.load(io.BytesIO(data), allow_pickle=False) as archive:
            return archive["latent_action"]
    size, = struct.unpack_from("<Q", data)
    told = json.loads(data[8 : 8 + size])["latent_action"]
    a, b = told["data_offsets"]
    raw = data[8 + size + a : 8 + size + b]
    if told["dtype"] == "BF16":
        return (np.frombuffer(raw, "<u2").astype("<u4") << 16).view("<f4").reshape(told["shape"])
    return np.frombuffer(raw, {"F16": "<f2", "F32": "<f4", "F64": "<f8"}[told["dtype"]]).reshape(told["shape"])


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")


def probe_latents(spark: SparkSession, root: str, glob: str = "*.npz", tail: int = TAIL) -> DataFrame:
    """A row a file below root, laid out as dataset/episode/view/latent.npz (an episode may be nested): dataset, episode_id, view, how, complete and meta, null where unreadable.
    A view that the manifest has and this table lacks is a missing latent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *probe(c, tail), is_complete(c)) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.bool_()))], names=["path", "text", "how", "complete"])

    found = _files(spark, root, glob).mapInArrow(run, "path string, text string, how string, complete boolean")
    # whatever the file system's prefix, the root's own parts end where its last one stands in the path
    base = root.split("://")[-1].rstrip("/") + "/"
    inner = F.split(F.substring_index("path", base, -1), "/")
    n = F.size(inner)
    whole = F.from_json("text", META)
    meta = F.when(whole.isNotNull(), F.struct(
        whole["num_latents"].alias("num_latents"), whole["code_shape"].alias("code_shape"), whole["fps"].alias("fps"), whole["protocol"]["gap"].alias("gap"), whole["protocol"]["start_frame"].alias("start_frame"),
        whole["protocol"]["pair_stride"].alias("pair_stride"), whole["protocol"]["representation"].alias("representation"), whole["protocol"]["source"].alias("source"),
    ))
    return found.select(F.get(inner, F.lit(0)).alias("dataset"), F.array_join(F.slice(inner, F.lit(2), n - 3), "/").alias("episode_id"), F.get(inner, n - 2).alias("view"), "how", "complete", meta.alias("meta"))


def read_latents(spark: SparkSession, root: str, width: int, glob: str = "*.{npz,safetensors}") -> DataFrame:
    """path, t, latent (array<float>): a row a latent of all files below root. Another width is an error."""
    schema = pa.schema([("path", pa.string()), ("t", pa.int32()), ("latent", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = latent_array(path, data).astype(np.float32)
                if found.ndim != 2 or found.shape[1] != width:
                    raise ValueError(f"{path}: {found.shape}, not [T, {width}]")
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, width, dtype=np.int32)), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array(np.arange(len(found), dtype=np.int32)), flat], schema=schema)

    return _files(spark, root, glob).mapInArrow(run, "path string, t int, latent array<float>")


def npz_bytes(latents: np.ndarray, pairs: np.ndarray, meta: dict) -> bytes:
    """A latent file: the arrays, and last the meta record, so that a reader finds it in the tail."""
    out = io.BytesIO()
    np.savez(out, latent_action=latents.astype(np.float16), pair_indices=pairs.astype(np.int32), meta=np.array(json.dumps(meta)))
    return out.getvalue()
