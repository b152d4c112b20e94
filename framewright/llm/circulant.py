"""MinHash near-duplicates with circulant signatures.

A text's set of shingles becomes places in a universe of 2^22: a first permutation spreads them, and all coordinates of the
signature come from one more permutation, shifted by one place for each: coordinate k is the least value that the second permutation has k
places behind one of the set's. Six coordinates make a band, taken far apart as neighbouring shifts see near places; in corpora of
millions more, so that unlike sets, whose pairs grow with the square of their number, rarely share one. There are as many bands as it takes for two sets of the least
similarity to share none with a chance of 2e-9 (43 at 0.85). Pairs that share one are settled on the full sets (see meeting).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import hot_keys, spread_join, written
from framewright.llm.meeting import links
from framewright.llm.similar import gathered, set_key, shingles
from framewright.llm.simhash import components

#: Bits of the universe, and coordinates whose bits make the sketch.
UNIVERSE, SKETCH = 22, 256
#: The chance that two sets of the least similarity share no band.
MISSED = 2e-9
#: Members of a set whose coordinates are compared at once.
STEP = 2048


def shape(n_docs: int, least: Fraction) -> tuple[int, int]:
    """(coordinates of a band, bands) for so many documents."""
    rows = 6 if n_docs < 1 << 20 else 8 if n_docs < 1 << 26 else 10 if n_docs < 1 << 32 else 12
    return rows, max(-(-SKETCH // rows), math.ceil(math.log(MISSED) / math.log1p(-(float(least) ** rows)))) if least < 1 else -(-SKETCH // rows)


@cache
def shifted(n: int) -> np.ndarray:
    """The second permutation, continued by its beginning; row v has the n values from place v on."""
    order = np.random.default_rng(22).permutation(1 << UNIVERSE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: n - 1]]), n)


def places(hashes: np.ndarray) -> np.ndarray:
    """The first permutation: of the universe, an odd factor and a shift, twice."""
    mask, half = np.uint64((1 << UNIVERSE) - 1), np.uint64(UNIVERSE // 2)
    x = hashes & mask
    for factor in (0x2C9277B5, 0x1B873593):
        x = x * np.uint64(factor) & mask
        x ^= x >> half
    return x.astype(np.int64)


def signature(hashes: np.ndarray, n: int) -> np.ndarray:
    """n coordinates of a set that isn't empty."""
    out = np.full(n, np.uint32(0xFFFFFFFF))
    at = places(hashes)
    for s in range(0, len(at), STEP):
        out = np.minimum(out, shifted(n)[at[s : s + STEP]].min(0))
    return out


def bands_and_bits(coordinates: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A 32-bit value a band, and a sketch with a bit of each of the first coordinates."""
    x = coordinates.astype(np.uint64)
    odd = np.arange(3, 2 * rows + 3, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    bands = (x.reshape(rows, -1) * odd[:, None]).sum(0, dtype=np.uint64)
    bands = (bands ^ bands >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
    bits = np.packbits(((x[:SKETCH] * np.uint64(0x94D049BB133111EB)) >> np.uint64(63)).astype(np.uint8))
    return bands.astype(np.uint32).view(np.int32), bits.view(np.int64)


def prints(docs: DataFrame, width: int, rows: int, bands: int) -> DataFrame:
    """doc_id, set, n, bands, bits: one row a row of docs; a null text has no words."""
    schema = pa.schema([("doc_id", pa.int64()), ("set", pa.int64()), ("n", pa.int32()), ("bands", pa.list_(pa.int32())), ("bits", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, tuple] = {}
            found = []
            for text in batch.column(1):
                members = shingles(text.as_py() or "", width)
                key = set_key(members)
                if key not in known:
                    known[key] = (key, len(members), *(bands_and_bits(signature(members, rows * bands), rows) if len(members) else ([], [])))
                found.append(known[key])
            columns = [pa.array([r[k] for r in found], schema.types[k + 1]) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=schema)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, set long, n int, bands array<int>, bits array<long>")


def near_duplicates(docs: DataFrame, width: int = 5, least: Fraction = Fraction(85, 100)) -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept (whether that is its own).

    Texts link if their sets of word shingles have this Jaccard similarity. Null, empty and blank texts have no shingles and link with nothing, not
    even each other; texts of fewer words than a shingle are one shingle. Texts of any length are compared whole. Repeated rows keep
    a row each. Null ids are left out of the minimum: a component of nothing else has a null id, and is kept. Other columns aren't read.
    An empty table gives an empty result.
    """
    rows = written(prints(docs, width, *shape(docs.count(), least)), "circulant-prints")
    sets = rows.where("n > 0").groupBy("set").agg(F.first("n").alias("n"), F.min("doc_id").alias("first"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    sets = written(sets, "circulant-sets")
    found = links(sets, lambda some: gathered(some, docs, width), least, float(1 - least) / 2)
    labels = components(found, "set", "pivot").withColumnRenamed("node", "set")
    joined = written(labels.join(sets.select("set", "first"), "set"), "circulant-labels")
    lowest = joined.groupBy("label").agg(F.min("first").alias("lowest"))
    joined = spread_join(joined, lowest, "label", "set", hot_keys(joined, "label", joined.count())).select("set", "lowest")
    ids = written(sets.join(joined, "set", "left").select("set", F.coalesce("lowest", "first").alias("lowest")), "circulant-components")
    filled = rows.where("n > 0").select("doc_id", "set", "n")
    out = spread_join(filled, ids, "set", "doc_id", hot_keys(filled, "set", filled.count())).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("lowest").alias("component_id"))
    empty = rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
