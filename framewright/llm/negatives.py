"""Hard negatives by blocked dense products.

Anchors are taken in blocks of a bounded number of bytes, and a block is broadcast to the tasks that read the candidates. A task
multiplies it with its candidates in float64, a tile at a time: products of integer vectors are exact below 2^53, which the vectors' lengths
prove for each tile; beyond, the tile is computed in integers of any size. The first pass keeps each anchor's five best rows of its own label, a
task's worth at a time, and merges these; the second keeps for each anchor and positive the best rows of other labels within the
positive's window of scores. Candidates are read once a pass and block; what tasks report doesn't depend on their number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import fresh_path, written
from framewright.llm.vectors import matrix, usable, widest

#: Anchors and candidates of a tile, and bytes of a broadcast block of anchors.
ANCHORS, CANDIDATES, BLOCK_BYTES = 256, 4096, 16 << 20
#: Integers up to here are exact in float64, and scores up to here are longs.
EXACT, LONG = 1 << 53, (1 << 63) - 1


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors (whole floats), as longs. Their lengths bound every partial sum; where that isn't under 2^53, Python's integers are used."""
    lengths = [float(np.sqrt((x * x).sum(1)).max(initial=0.0)) for x in (a, b)]
    if lengths[0] * lengths[1] < EXACT * (1 - 1e-9):
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(c) for c in row] for row in x], object).reshape(x.shape) for x in (a, b)]
    out = whole[0] @ whole[1].T
    if out.size and max(abs(out.max()), abs(out.min())) > LONG:
        raise OverflowError("a score is no long")
    return out.astype(np.int64)


@dataclass
class Best:
    """The k best (score down, id up) of each slot, from scores that come in tiles."""

    k: int
    n_slots: int

    def __post_init__(self):
        self.slot, self.score, self.id, self.row = (np.zeros(0, np.int64) for _ in range(4))
        self.worst = np.full(self.n_slots, np.iinfo(np.int64).min)  # a slot's k-th best score so far

    def add(self, first_slot: int, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """scores: a row a slot from first_slot on, a column a candidate."""
        slots = np.arange(first_slot, first_slot + len(scores))
        allowed &= scores >= self.worst[slots][:, None]
        many = np.flatnonzero(allowed.sum(1) > 4 * self.k)
        if len(many):  # only what reaches the tile's own k-th best
            low = np.iinfo(np.int64).min
            some = np.where(allowed[many], scores[many], low)
            allowed[many] &= scores[many] >= np.partition(some, -self.k, axis=1)[:, -self.k][:, None]
        at, c = np.nonzero(allowed)
        if not len(at):
            return
        slot, score = np.concatenate([self.slot, slots[at]]), np.concatenate([self.score, scores[at, c]])
        id_, row = np.concatenate([self.id, ids[c]]), np.concatenate([self.row, rows[c]])
        order = np.lexsort((row, id_, -score, slot))
        slot = slot[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = place < self.k
        order, slot = order[keep], slot[keep]
        self.slot, self.score, self.id, self.row = slot, score[order], id_[order], row[order]
        last = place[keep] == self.k - 1
        self.worst[slot[last]] = self.score[last]


def quantized(vectors: DataFrame, factor: int = 256) -> DataFrame:
    """vec_id, label, row, vector: rows that take part, numbered, with components floor(factor * x) as doubles, in the shared folder.
    Where vec_id is divisible by 7 the label is the next of ten."""
    rows = usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vector")), "vector").where(F.col("label").isNotNull())
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    width = widest(rows, "vector")

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.floor(matrix(batch.column(3), width) * factor)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=["vec_id", "label", "row", "vector"])

    rows = rows.select("vec_id", label.alias("label"), F.monotonically_increasing_id().alias("row"), "vector")
    return written(rows.mapInArrow(floors, "vec_id long, label long, row long, vector array<double>"), "negatives-rows")


def _ids(column: pa.Array) -> np.ndarray:
    """Ids; a null one stands after all others."""
    return column.fill_null(LONG).to_numpy()


def _scan(rows: DataFrame, block, task, schema: str, path: str) -> DataFrame:
    """What task(block, tiles) yields from each partition of rows, block being broadcast, as a table at path; tiles are (ids, labels, row numbers, vectors)."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tiles():
            for batch in batches:
                for s in range(0, batch.num_rows, CANDIDATES):
                    part = batch.slice(s, CANDIDATES)
                    lists = part.column(3)
                    yield _ids(part.column(0)), part.column(1).to_numpy(), part.column(2).to_numpy(), matrix(lists, len(lists[0]))

        yield from task(shared.value, tiles())

    rows.mapInArrow(run, schema).write.parquet(path)
    shared.unpersist()
    return rows.sparkSession.read.schema(schema).parquet(path)


def _positives(k: int):
    def task(block, tiles):
        labels, numbers, vectors = block
        best = Best(k, len(labels))
        for ids, of, rows, candidates in tiles:
            for s in range(0, len(labels), ANCHORS):
                own = labels[s : s + ANCHORS, None] == of
                if own.any():
                    own &= numbers[s : s + ANCHORS, None] != rows
                    best.add(s, products(vectors[s : s + ANCHORS], candidates), own, ids, rows)
        yield pa.RecordBatch.from_arrays([pa.array(numbers[best.slot]), pa.array(best.id), pa.array(best.row), pa.array(best.score)], names=["anchor", "id", "row", "score"])

    return task


def _negatives(k: int, percent: tuple[int, int]):
    def task(block, tiles):
        labels, numbers, vectors, positives = block  # positives: a row an anchor, its scores down; a score too many is LONG
        n = positives.shape[1]
        best = [Best(k, len(labels)) for _ in range(n)]
        whole = positives.astype(object)
        least, most = (-(-percent[0] * whole // 100)).astype(np.int64), (percent[1] * whole // 100).astype(np.int64)
        for ids, of, rows, candidates in tiles:
            for s in range(0, len(labels), ANCHORS):
                scores = products(vectors[s : s + ANCHORS], candidates)
                other = labels[s : s + ANCHORS, None] != of
                for j in range(n):
                    there = positives[s : s + ANCHORS, j, None] != LONG
                    best[j].add(s, scores, other & there & (scores >= least[s : s + ANCHORS, j, None]) & (scores <= most[s : s + ANCHORS, j, None]), ids, rows)
        for j, b in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(numbers[b.slot]), pa.array(np.full(len(b.slot), j, np.int32)), pa.array(b.id), pa.array(b.row), pa.array(b.score)], names=["anchor", "place", "id", "row", "score"])

    return task


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best of each key over all tasks, with their place from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, every: int = 50, n_positives: int = 5, k: int = 3, percent: tuple[int, int] = (50, 95), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: up to k hard negatives for each anchor and each of its positives.

    Anchors are the rows whose vec_id is divisible by every; each of repeated rows is a row of its own, also as an anchor. A null vec_id stands after all others
    where scores tie, and is no anchor. Shorter vectors count as filled up with zeros; an empty one has score 0 with all. Scores beyond a long
    are an error. Other columns aren't read. An empty table, or one without anchors, gives an empty result.
    """
    spark = vectors.sparkSession
    rows = quantized(vectors)
    anchors = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    n, width = anchors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n or not width:
        return spark.createDataFrame([], schema)
    # a block has half of block_bytes on average, by a hash of row numbers; what is more than block_bytes is taken in turns
    most = max(1, block_bytes // (8 * width + 64))
    blocks = -(-2 * n // most)
    anchors = written(anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")), "negatives-anchors")
    paths = [fresh_path(spark, name) for name in ("negatives-positives", "negatives-merged", "negatives-found")]
    found_schema, merged_schema = "anchor long, place int, id long, row long, score long", "anchor long, place int, id long, score long"
    for block in range(blocks):
        table = anchors.where(F.col("block") == block).select("label", "row", "vector").toArrow()
        for s in range(0, table.num_rows, most):
            part = table.slice(s, most).combine_chunks()
            labels, numbers, values = part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2).chunk(0), width)
            step = f"/{block}-{s}"
            found = _scan(rows, (labels, numbers, values), _positives(n_positives), "anchor long, id long, row long, score long", paths[0] + step)
            best = _best(found, ["anchor"], n_positives)
            best.select("anchor", (F.col("rank") - 1).cast("int").alias("place"), "id", "score").write.parquet(paths[1] + step)
            scores = np.full((len(labels), n_positives), LONG)
            order = np.argsort(numbers)
            known = spark.read.schema(merged_schema).parquet(paths[1] + step).select("anchor", "place", "score").toArrow()
            scores[order[np.searchsorted(numbers[order], known.column(0).to_numpy())], known.column(1).to_numpy()] = known.column(2).to_numpy()
            _scan(rows, (labels, numbers, values, scores), _negatives(k, percent), found_schema, paths[2] + step)
    read = lambda path, schema: spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    negatives = _best(read(paths[2], found_schema), ["anchor", "place"], k)
    positives = read(paths[1], merged_schema).select("anchor", "place", F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    out = negatives.join(positives, ["anchor", "place"]).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    id_ = lambda c: F.when(F.col(c) != LONG, F.col(c))
    return out.select("anchor_id", id_("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), id_("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
