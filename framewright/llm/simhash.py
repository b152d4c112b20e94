"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is seen as parts, chosen so that of two fingerprints that differ in at most four bits, some part differs in at most one.
A part's anchors are the words of a covering code: perfect Hamming words (covering radius 1) with the
part's other bits as they are (radius 0). A part's home is the anchor that it decodes to. A fingerprint
is sent to its home, and to each anchor within covering radius plus threshold that can be the home of a part one bit away:
about 13 of 2^17 anchors (or 17 of 2^26, for corpora of many fingerprints). So two linked fingerprints meet at an anchor, the one at home and the other visiting.

Only distinct fingerprints are sent, so copies cost nothing. Homes at an anchor are compared with its visitors
as they stream by; an anchor with very many homes is divided over tasks. A task reports the forest of the links that it found, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import hot_keys, spread_join, written

THRESHOLD = 4
#: Homes of one anchor that one task holds; more are divided.
HOMES = 2048
#: Pairs compared at once.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Cover:
    """Parts of a fingerprint, each some blocks of its bits (lowest bit, width), low ones first; word: bits that the Hamming word has."""

    parts: tuple[tuple[tuple[int, int], ...], ...]
    word: int


#: Three parts of 21 or 22 bits: 2^17 anchors or more a part, about 14 sends of a fingerprint to each.
NARROW = Cover((((0, 21),), ((21, 21),), ((42, 22),)), 15)
_SIX = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Six blocks, in threes: four differing bits leave two blocks untouched and a third with at most one of them in some of these. 2^26 anchors or more a part.
WIDE = Cover(tuple(tuple(_SIX[k] for k in three) for three in ((0, 1, 2), (0, 1, 3), (0, 4, 5), (1, 4, 5), (2, 3, 4), (2, 3, 5))), 31)
#: Distinct fingerprints from which on the wide cover is used, so that an anchor has few homes at any size: links are the same with either.
MANY = 1 << 25


def anchors(fingerprints: np.ndarray, cover: Cover = NARROW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index of the fingerprint, 1 at home): a row for each home, and one for each anchor visited, the own one included."""
    prints = fingerprints.view(np.uint64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    index = np.arange(len(prints))

    def add(anchor: np.ndarray, who: np.ndarray, home: int) -> None:
        out.append((anchor, who, np.full(len(who), home, np.int8)))

    for k, blocks in enumerate(cover.parts):
        part, width = np.zeros(len(prints), np.int64), 0
        for low, size in blocks:
            part |= (prints >> np.uint64(low) & np.uint64((1 << size) - 1)).astype(np.int64) << width
            width += size
        # positions count from 1; a word's syndrome is the position of the bit that is off from its codeword, 0 for none
        syndrome = np.zeros(len(prints), np.int64)
        for bit in range(cover.word):
            syndrome ^= (part >> bit & 1) * (bit + 1)
        at = part | k << 40
        home = np.where(syndrome > 0, at ^ 1 << np.maximum(syndrome - 1, 0), at)
        add(home, index, 1)
        add(home, index, 0)
        # codewords of the words one bit away: two flips whose positions have the syndrome as their difference
        for first in range(1, cover.word + 1):
            second = syndrome ^ first
            near = np.flatnonzero((syndrome > 0) & (second > first))
            add(at[near] ^ 1 << first - 1 ^ 1 << second[near] - 1, index[near], 0)
        for bit in range(cover.word, width):
            add(home ^ 1 << bit, index, 0)
    return tuple(np.concatenate(c) for c in zip(*out))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links a-b: (member, smallest member), without the smallest itself."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        following = label.copy()
        np.minimum.at(following, a, low)
        np.minimum.at(following, b, low)
        following = following[following]
        if (following == label).all():
            break
        label = following
    member = label != np.arange(len(nodes))
    return nodes[member], nodes[label[member]]


def fingerprint(text: str, width: int = 4) -> int:
    """The SimHash of a text's word shingles, ASCII capitals lowered; of a shorter text, of all its words; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxh64_intdigest(joined, 42)], "<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-width] + 1])
        hashes = np.array([xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist())], "<u8")
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp long: one row a row of docs; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py() or "") for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"`{text}` as text").mapInArrow(run, "doc_id long, fp long")


def links(prints: DataFrame, cover: Cover | None = None) -> DataFrame:
    """prints: fp, distinct. (fp, other): links that join all fingerprints joined by chains of THRESHOLD bits or fewer."""
    cover = cover or (WIDE if prints.count() >= MANY else NARROW)

    def send(only_homes: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch.column(0).to_numpy()
                for begin in range(0, len(values), 8192):
                    own = values[begin : begin + 8192]
                    anchor, index, home = anchors(own, cover)
                    if only_homes:
                        anchor, index, home = anchor[home == 1], index[home == 1], home[home == 1]
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(own[index]), pa.array(home)], names=["anchor", "fp", "home"])

        return run

    sent = "anchor long, fp long, home byte"
    crowded = prints.mapInArrow(send(True), sent).groupBy("anchor").count().where(F.col("count") > HOMES)
    crowded = written(crowded.select("anchor", F.ceil(F.col("count") / HOMES).cast("int").alias("parts")), "simhash-crowded")
    rows = prints.mapInArrow(send(False), sent).join(crowded, "anchor", "left")
    dealt = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("home") == 1, F.array(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.select("anchor", "fp", "home", F.explode(dealt).alias("part")).repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.desc("home"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)  # homes of the group that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy() * 4096 + batch.column(3).to_numpy() % 4096
            fp, home = batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy() == 1
            home_key, homes = np.concatenate([held_key, key[home]]), np.concatenate([held, fp[home]])
            order = np.argsort(home_key, kind="stable")
            home_key, homes = home_key[order], homes[order]
            visit_key, visits = key[~home], fp[~home]
            first = np.searchsorted(home_key, visit_key)
            total = np.concatenate([[0], np.cumsum(np.searchsorted(home_key, visit_key, "right") - first)])
            begin, left, right = 0, [], []
            while begin < len(visits):
                end = max(begin + 1, int(np.searchsorted(total, total[begin] + CHUNK, "right")) - 1)
                counts = np.diff(total[begin : end + 1])
                v = np.repeat(np.arange(begin, end), counts)
                h = np.arange(len(v)) - np.repeat(total[begin:end] - total[begin] - first[begin:end], counts)
                bits = np.bitwise_count(visits[v] ^ homes[h])
                near = (bits <= THRESHOLD) & (bits > 0)
                if near.any():
                    a, b = forest(visits[v[near]].view(np.int64), homes[h[near]].view(np.int64))
                    left.append(a)
                    right.append(b)
                begin = end
            if left:
                a, b = forest(np.concatenate(left), np.concatenate(right))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["fp", "other"])
            open_ = home_key == key[-1]
            held_key, held = home_key[open_], homes[open_]

    return rows.select("anchor", "fp", "home", "part").mapInArrow(compare, "fp long, other long").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the smallest node of each node's component, for the nodes of the edges.

    Each round gives a node, and the node that is its label, the smallest label among its neighbours, and then each node its label's label:
    trees hang on one another and get flat, so long chains end in few rounds too. Rounds are tables in the shared folder, and end when no
    label changes. A node of very many edges, or a label of very many nodes, is dealt over tasks.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("near")).union(edges.select(F.col(b), F.col(a))).distinct()
    both = written(both, "components-edges")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("label")), "components-labels")
    n_nodes = labels.count()
    hubs = hot_keys(both, "near", both.count())
    while True:
        seen = spread_join(both, labels.select(F.col("node").alias("near"), "label"), "near", "node", hubs)
        lower = labels.join(seen.groupBy("node").agg(F.min("label").alias("low")), "node")
        hook = lower.groupBy(F.col("label").alias("node")).agg(F.min("low").alias("hook"))
        lower = lower.join(hook, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "low", "hook").alias("label"))
        lower = written(lower, "components-hooked")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("onward"))
        flat = spread_join(lower, jump, "label", "node", hot_keys(lower, "label", n_nodes)).select("node", "was", F.least("label", "onward").alias("label"))
        flat = written(flat, "components-labels")
        labels = flat.select("node", "label")
        if flat.where("label <> was").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links).

    Null, empty and blank texts have fingerprint 0 and link like any other. Rows with equal fingerprints are linked. Null ids are left
    out of the minimum, so a component of nothing else has a null id. Other columns aren't read.
    """
    rows = written(fingerprints(docs, doc_id, text), "simhash-prints")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    found = written(links(prints.select("fp")), "simhash-links")
    labels = components(found, "fp", "other").withColumnRenamed("node", "fp")
    joined = written(labels.join(prints, "fp"), "simhash-labels")
    lowest = joined.groupBy("label").agg(F.min("first").alias("lowest"))
    joined = spread_join(joined, lowest, "label", "fp", hot_keys(joined, "label", joined.count())).select("fp", "lowest")
    ids = written(prints.join(joined, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component_id")), "simhash-components")
    out = spread_join(rows, ids, "fp", "doc_id", hot_keys(rows, "fp", rows.count()))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
