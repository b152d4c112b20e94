"""Token ids as wavelet matrices, one a shard.

A wavelet matrix keeps a sequence as one bit-plane for each bit of an id, the highest first;
after each plane the ids with a 0 there move, in order, before those with a 1. With the
counts of ones before each block, a plane answers rank and select, and through
the planes: the id at a place, the number of an id's occurrences up to a place, and the place of an id's k-th occurrence.

A file is a Parquet file (zstd); a row is a shard: its documents' ids and lengths, and its planes, their block counts and numbers of zeros.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm.common import fresh_path
from framewright.llm.tokens import encoder

#: Bits a block of the rank directory has.
BLOCK = 512
SHARD = "part int, chunk int, n_tokens long, doc_ids array<long>, lengths array<long>, zeros array<long>, planes array<binary>, ranks array<binary>"
ROW = pa.schema([
    ("part", pa.int32()), ("chunk", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())),
])


class WaveletMatrix:
    """The wavelet matrix of n ids, from its stored parts; of(ids, bits) makes one."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def of(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        here = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for bit in range(bits - 1, -1, -1):
            ones = (here & here.dtype.type(1 << bit)) != 0
            packed = np.packbits(ones, bitorder="little")
            planes.append(packed.tobytes())
            padded = np.zeros(-(-len(ones) // BLOCK) * BLOCK // 8, np.uint8)
            padded[: len(packed)] = packed
            counts = np.zeros(len(padded) * 8 // BLOCK + 1, "<u4")
            np.cumsum(np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1), out=counts[1:])
            ranks.append(counts.tobytes())
            zeros.append(len(ones) - int(counts[-1]))
            here = np.concatenate([here[~ones], here[ones]])
        return cls(len(ids), zeros, planes, ranks)

    def _bit(self, plane: int, at: int) -> int:
        return self.planes[plane][at >> 3] >> (at & 7) & 1

    def _ones(self, plane: int, end: int) -> int:
        """Ones before end in a plane."""
        block = end // BLOCK
        count = int.from_bytes(self.ranks[plane][4 * block : 4 * block + 4], "little")
        tail = int.from_bytes(self.planes[plane][block * BLOCK // 8 : -(-end // 8)], "little")
        return count + (tail & ((1 << (end - block * BLOCK)) - 1)).bit_count()

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        found = 0
        for plane, zeros in enumerate(self.zeros):
            bit, ones = self._bit(plane, at), self._ones(plane, at)
            found = found << 1 | bit
            at = zeros + ones if bit else at - ones
        return found

    def _range(self, token: int, end: int) -> tuple[int, int]:
        begin = 0
        if not 0 <= token < 1 << len(self.zeros):
            return 0, 0
        for plane, zeros in enumerate(self.zeros):
            a, b = self._ones(plane, begin), self._ones(plane, end)
            bit = token >> (len(self.zeros) - 1 - plane) & 1
            begin, end = (zeros + a, zeros + b) if bit else (begin - a, end - b)
        return begin, end

    def rank(self, token: int, end: int) -> int:
        """Occurrences of an id before end."""
        begin, end = self._range(token, end)
        return end - begin

    def select(self, token: int, k: int) -> int:
        """The place of an id's k-th occurrence, from 0."""
        begin, end = self._range(token, self.n)
        if not 0 <= k < end - begin:
            raise IndexError(k)
        at = begin + k
        for plane in range(len(self.zeros) - 1, -1, -1):
            bit = token >> (len(self.zeros) - 1 - plane) & 1
            at = self._select_bit(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        low, high = 0, self.n - 1
        while low < high:
            middle = (low + high) // 2
            ones = self._ones(plane, middle + 1)
            if (ones if bit else middle + 1 - ones) > k:
                high = middle
            else:
                low = middle + 1
        return low

    def decoded(self) -> np.ndarray:
        """All ids: from the last plane up, each plane's order is undone."""
        here = np.zeros(self.n, np.uint32 if len(self.zeros) > 16 else np.uint16)
        for plane in range(len(self.zeros) - 1, -1, -1):
            ones = np.unpackbits(np.frombuffer(self.planes[plane], np.uint8), count=self.n, bitorder="little").view(bool)
            up = np.empty_like(here)
            up[~ones], up[ones] = here[: self.zeros[plane]], here[self.zeros[plane] :] | here.dtype.type(1 << (len(self.zeros) - 1 - plane))
            here = up
        return here


def write_token_shards(docs: DataFrame, tokenizer: str, path: str, bits: int = 16, end_id: int = 2, shard_tokens: int = 1 << 20, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the documents' ids, each document's followed by end_id, in ascending doc_id (null first, equal ids by text) as shards of about shard_tokens.

    A null text counts as empty; repeated rows are kept. A very long document makes a larger shard. An empty table makes files without shards.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end, part, chunk = encoder(tokenizer), end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        keys: list = []
        held: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            if len(ids) and int(ids.max()) >> bits:
                raise ValueError(f"an id doesn't fit {bits} bits")
            m = WaveletMatrix.of(ids, bits)
            row = {"part": part, "chunk": chunk, "n_tokens": m.n, "doc_ids": keys, "lengths": [len(x) // 4 for x in held], "zeros": m.zeros, "planes": m.planes, "ranks": m.ranks}
            return pa.RecordBatch.from_pylist([row], schema=ROW)

        for batch in batches:
            for key, found in zip(batch.column(0).to_pylist(), ids_of.ids(batch.column(1))):
                keys.append(key)
                held.append(found + end)
                size += len(found) // 4 + 1
                if size >= shard_tokens:
                    yield out()
                    keys, held, size, chunk = [], [], 0, chunk + 1
        if keys:
            yield out()

    rows = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"`{text}` as text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(encode, SHARD).write.option("compression", "zstd").parquet(path)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, chunk, first: tokens of all shards before this one. Parts are few; chunks are summed within their part."""
    sizes = _shards(spark, path).select("part", "chunk", "n_tokens")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("ahead"))
    inner = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("chunk"))), F.lit(0))
    return sizes.withColumn("inner", inner).join(parts, "part").select("part", "chunk", (F.col("ahead") + F.col("inner")).alias("first"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A row a document from the files: doc_id, start, n_tokens, ids_crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                ids = WaveletMatrix(row["n_tokens"], row["zeros"], row["planes"], row["ranks"]).decoded().astype("<u4").tobytes()
                starts = np.cumsum([0, *row["lengths"]])
                sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                n = len(sums)
                columns = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["chunk"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "chunk", "doc_id", "local", "n_tokens", "ids_crc32"])

    docs = _shards(spark, path).mapInArrow(decode, "part int, chunk int, doc_id long, local long, n_tokens long, ids_crc32 long")
    docs = docs.join(shard_starts(spark, path), ["part", "chunk"])
    return docs.select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def find_token(spark: SparkSession, path: str, token: int, limit: int | None = None) -> DataFrame:
    """A row a shard that has the token: part, chunk, count, and the places (in the shard) of its occurrences, or of the first limit of them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                m = WaveletMatrix(row["n_tokens"], row["zeros"], row["planes"], row["ranks"])
                if count := m.rank(token, m.n):
                    found = {"part": row["part"], "chunk": row["chunk"], "count": count, "places": [m.select(token, k) for k in range(count if limit is None else min(count, limit))]}
                    yield pa.RecordBatch.from_pylist([found], schema=pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("count", pa.int64()), ("places", pa.list_(pa.int64()))]))

    return _shards(spark, path).mapInArrow(find, "part int, chunk int, count long, places array<long>")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the documents as token shards into the shared folder and reads them back."""
    path = fresh_path(docs.sparkSession, "token-shards")
    write_token_shards(docs, tokenizer, path)
    return read_documents(docs.sparkSession, path)
