"""Near-duplicates by similarity: SimHashes meet at the anchors of a covering code, their differing bits are counted, and the exact Jaccard similarity of word shingles decides.

A text is its set of shingles. Sixteen 64-bit SimHashes of the set are cut into parts of 19 bits, and for corpora of millions of sets into longer ones and more of them, so that few unlike sets meet at any size.
As in simhash, a part's anchors are the words of a perfect Hamming code (of 7 bits) with its other bits as they are: a set is at home at the anchor that its part decodes to, and visits those of
the words one bit away, if they are below it. So two sets meet where a part differs in at most one bit of the word. At similarity 0.8 about 15 % of the bits differ, so they do in one part with probability 0.10, in one of 46 with 0.99; at 0.85 with 0.999. A set comes to 106 anchors on average.

Only distinct sets are sent. All pairs that meet are settled on the sets themselves (see meeting), so no link is below the similarity asked for, and none that meets is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from framewright.llm.common import one_row_each, written
from framewright.llm.meeting import links
from framewright.llm.simhash import components

#: Words of a shingle, and the least similarity of a link.
WIDTH, SIMILARITY = 5, 0.8
#: SimHashes of a set, and how many of them are its sketch.
WORDS, SKETCH = 16, 4
#: Bits that tell a part's anchors apart up to 2^22 sets, and the chance that two sets of the least similarity meet nowhere.
BITS, MISSED = 16, 0.0085
#: Bits of a part that are a word of the covering code.
WORD = 7
#: Shingles whose bits are counted at once.
_STEP = 4096
_SALTS = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles, ASCII capitals lowered; of a shorter text, of all its words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-width] + 1])
    return np.unique(np.array([xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist())], np.uint64))


def simhashes(hashes: np.ndarray) -> bytes:
    """WORDS SimHashes of a set, 8 bytes each. Ties fall as the smallest hash has the bit."""
    counts = np.zeros(64 * WORDS, np.int64)
    first = None
    for begin in range(0, len(hashes), _STEP):
        x = hashes[begin : begin + _STEP, None] + _SALTS
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ x >> np.uint64(31)).view(np.uint8), axis=1)
        counts += bits.sum(0, dtype=np.uint16)
        first = bits[0] if first is None else first
    if first is None:
        return bytes(8 * WORDS)
    return np.packbits(counts * 2 + first > len(hashes)).tobytes()


def set_key(hashes: np.ndarray) -> int:
    """A number for a set, 0 for the empty one."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(hashes.tobytes(), 42)).view(np.int64)) if len(hashes) else 0


def differing(similarity: float) -> float:
    """The share of bits that differ between SimHashes of two sets of this similarity."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def band_places(n_sets: int, similarity: float, word: int = 0) -> np.ndarray:
    """Which bits of a set's SimHashes make each band, a row a band: longer with more sets, and as many as MISSED needs. word: the first so many bits of a band are a word of
    a perfect Hamming code, in which sets that meet may differ in one bit; they count as those that tell its codewords apart."""
    bits = max(BITS, math.ceil(math.log2(max(2, n_sets))) - 6) + (word + 1).bit_length() - 1
    same = 1 - differing(similarity)
    meets = same**bits * (1 + word * (1 - same) / same)
    n = math.ceil(math.log(MISSED) / math.log1p(-meets))
    if bits * n <= 64 * WORDS:
        return np.arange(bits * n).reshape(n, bits)
    random = np.random.default_rng(bits)
    return np.stack([random.choice(64 * WORDS, bits, replace=False) for _ in range(n)])


def prints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, set, n, prints: one row a row of docs; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x.as_py() or "", width) for x in batch.column(1)]
            columns = [batch.column(0), pa.array([set_key(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int32()), pa.array([simhashes(x) for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "set", "n", "prints"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, set long, n int, prints binary")


def banded(sets: DataFrame, similarity: float) -> DataFrame:
    """set, n, first, bands, bits: the bands of sets (set, n, first, prints) that so many sets need, each with its word in the lowest WORD bits."""
    where = band_places(sets.count(), similarity, WORD)
    width = where.shape[1] - WORD
    weights = np.uint64(1) << np.arange(width, dtype=np.uint64)
    room = 32 - WORD
    schema = pa.schema([("set", pa.int64()), ("n", pa.int32()), ("first", pa.int64()), ("bands", pa.list_(pa.int32())), ("bits", pa.list_(pa.int64()))])
    lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                raw = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                bits = np.unpackbits(raw, axis=1)
                words = np.stack([bits[:, at[:WORD]].astype(np.uint64) @ weights[:WORD] for at in where], 1)
                bands = np.stack([bits[:, at[WORD:]].astype(np.uint64) @ weights for at in where], 1)
                if width > room:
                    bands = bands * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - room)
                bands = bands << np.uint64(WORD) | words
                sketch = raw[:, : 8 * SKETCH].copy().view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], lists(bands.astype(np.uint32).view(np.int32), pa.int32()), lists(sketch, pa.int64())], schema=schema)

    return sets.select("set", "n", "first", "prints").mapInArrow(run, "set long, n int, first long, bands array<int>, bits array<long>")


def gathered(some: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """set, hashes: the shingles of some sets: set and first, the id of a document that has it."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(s, x) for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if set_key(x := shingles(t or "", width)) == s]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int64()), pa.array([x.tobytes() for _, x in found], pa.binary())], names=["set", "hashes"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = some.join(texts, F.col("first").eqNullSafe(F.col("doc_id"))).select("set", "text").mapInArrow(gather, "set long, hashes binary")
    return held.dropDuplicates(["set"])


def similar_links(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id and set of each row; sets: set, first, the smallest id that has it; links: a, b, sets of at least this similarity)."""
    rows = written(prints(docs, width), "similar-prints")
    sets = written(rows.groupBy("set", "n", "prints").agg(F.min("doc_id").alias("first")), "similar-distinct")
    bands = written(banded(sets, similarity), "similar-bands")
    found = links(bands, lambda some: gathered(some, docs, width), Fraction(str(similarity)), differing(similarity), WORD, SKETCH)
    return rows.select("doc_id", "set"), sets.select("set", "first"), found.select(F.col("set").alias("a"), F.col("pivot").alias("b"))


def without_similar(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of documents joined by chains of links: that of the smallest id (null last), and of rows of that id the one of the smallest set.

    Columns are as docs has them. Null, empty and blank texts are equal to each other. Very long texts are compared whole. An
    empty table gives an empty result.
    """
    rows, sets, found = similar_links(docs.select("doc_id", "text"), width, similarity)
    labels = components(found, "a", "b").withColumnRenamed("node", "set")
    first = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "set")).alias("f")
    chosen = sets.join(labels, "set", "left").groupBy(F.coalesce("label", "set").alias("group")).agg(first)

    def numbered(some: DataFrame, name: str) -> DataFrame:
        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = pa.array([set_key(shingles(x.as_py() or "", width)) for x in batch.column(batch.schema.get_field_index("text"))], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

        return some.mapInArrow(number, StructType([*some.schema.fields, StructField(name, LongType(), False)]))

    rows = rows.select("doc_id", F.col("set").alias("number"))
    return one_row_each(docs, rows, chosen.select(F.col("f.first").alias("doc_id"), F.col("f.set").alias("number")), numbered)
