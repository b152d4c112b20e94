"""Links between sets that meet in a band, decided on the sets themselves.

Two sets meet where they have the same value in a band or, with the words of a covering code, at an anchor: a set is at home at the anchor that its band's value
decodes to, and visits those of the values one bit away that are below its own, so that sets of which a band differs in one bit of the word meet too, and at one anchor. Whoever calls this chooses bands in which similar sets meet almost
surely, and a sketch of few bits by which most others are told apart. Every pair that meets and whose sketches are near enough is then settled: it is checked
on the full sets, or links join its two sets already. Nothing is cut off, and no list of pairs is made:

1. where very many sets meet, each is checked against the nearest of the smallest sets that it meets, one pair a set, which joins most of a crowd of near copies;
2. a task compares the first bits (or all) of the sketches of sets that meet and aren't joined yet, and tells of each set the smallest that is near it there. Most
   that meet by chance end here;
3. each of those sets is checked against the nearest of those;
4. chains of near sets that meet are crowds. One with sets of different components comes to a place of its own, a row a set (a large one in parts), so that a pair is looked at
   once, in however many bands it meets; whole sketches and bands are compared there, which leaves the sets that have an open pair;
5. those sets, and no others, are brought to that place, and all their open pairs are checked there. A task reports a forest of the links.

A crowd of more than PARTS parts is dealt by its bands once more, each pair in the first band that it shares, so that a set has at most as many rows as it has anchors in a crowd of any size.
A band value of very many sets is divided over tasks. What a crowd costs beyond its rows is comparing those of its sets that no link has joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import hot_keys, spread_join, written
from framewright.llm.simhash import Cover, anchors, components, forest

#: What one task holds of a band value's sets: their number, and their shingles.
HOMES, WEIGHT = 2048, 1 << 20
#: Sets of a crowd at home in a part, and the most parts of a crowd that has a place of its own: a set comes to at most so many of them.
BLOCK, PARTS = 512, 32
#: Pairs of near sets that one task joins to chains.
CHAINED = 1 << 20
#: Pairs of sketches, and of band lists, compared at once.
CHUNK, SLICE = 1 << 19, 1 << 15
#: Longs of a sketch that the first comparison reads unless told otherwise, and standard deviations of its bits that a pair may be off.
FIRST, DEVIATIONS = 2, 5
SETS = "set long, n int, first long, bands array<int>, bits array<long>"


def enough(both: int | np.ndarray, n: int | np.ndarray, m: int | np.ndarray, least: Fraction) -> bool | np.ndarray:
    """Whether sets of n and m members with so many in common have this Jaccard similarity; in integers."""
    return least.denominator * both >= least.numerator * (n + m - both)


def apart(a: Column, b: Column) -> Column:
    """Differing bits of two sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def radius(share: float, n: int) -> float:
    """Differing bits, of n, of two sets that differ in this share of bits: the mean and DEVIATIONS."""
    return n * share + DEVIATIONS * math.sqrt(n * share * (1 - share))


def anchors_of_words(word: int) -> list[list[int]]:
    """For each word of a perfect Hamming code's length (3, 7 or 15): the anchor where it is at home, and then those that it visits."""
    anchor, of, home = anchors(np.arange(1 << word), Cover((((0, word),),), word))
    own = anchor[home == 1][np.argsort(of[home == 1])]
    return [[int(own[w]), *sorted(set(anchor[of == w].tolist()) - {int(own[w])})] for w in range(1 << word)]


def sent(sets: DataFrame, word: int = 0, *also: str) -> DataFrame:
    """anchor, set, n, bits (and other columns): a row for each band of each set; an anchor is a band and its value. With a word, the lowest so many bits of a value, a row for each anchor that a set comes to, and visit: whether it isn't at home there.
    Of two anchors one bit apart, those at home at the upper one visit the lower one: a pair that visits both ways would be found, and brought, twice."""
    rows = sets.where("n > 0").select("set", "n", "bits", *also, F.posexplode("bands").alias("band", "value"))
    extra = []
    if word:
        mask = (1 << word) - 1
        code = F.array(*[F.array(*[F.lit(c) for c in found if c <= found[0]]) for found in anchors_of_words(word)])
        rows = rows.select("set", "n", "bits", *also, "band", "value", F.posexplode(F.get(code, F.col("value").bitwiseAND(F.lit(mask)))).alias("at", "codeword"))
        rows = rows.withColumn("value", F.col("value").bitwiseAND(F.lit(~mask)).bitwiseOR(F.col("codeword")))
        extra = [(F.col("at") > 0).alias("visit")]
    return rows.select((F.shiftleft(F.col("band").cast("long"), 32) + F.col("value") + F.lit(1 << 31)).alias("anchor"), "set", "n", "bits", *also, *extra)


def hot_anchors(anchors: DataFrame) -> DataFrame | None:
    """Of anchors (anchor, sets) those whose rows a join deals over tasks, with the number of parts; None without any."""
    hot = anchors.where(F.col("sets") > 1 << 20).select("anchor", F.ceil(F.col("sets") / (1 << 20)).cast("int").alias("__parts"))
    hot = written(hot, "meeting-hot")
    return None if hot.isEmpty() else hot


def star(rows: DataFrame, hot: DataFrame | None, sets: DataFrame, gather, least: Fraction, within: float) -> DataFrame:
    """rows: anchor, set. (set, pivot): links of each set with the nearest of its anchors' smallest sets, where that is similar enough."""
    pivots = rows.groupBy("anchor").agg(F.min("set").alias("pivot"))
    pairs = spread_join(rows.select("anchor", "set"), pivots, "anchor", "set", hot).where("set <> pivot").select("set", "pivot").distinct()
    pairs = written(pairs, "meeting-pairs")
    sketch = lambda key: sets.select(F.col("set").alias(key), F.col("bits").alias(f"{key}_bits"))
    pairs = spread_join(pairs, sketch("pivot"), "pivot", "set", hot_keys(pairs, "pivot", pairs.count())).join(sketch("set"), "set")
    pairs = pairs.select("set", "pivot", apart(F.col("set_bits"), F.col("pivot_bits")).alias("apart")).where(F.col("apart") <= within)
    nearest = pairs.groupBy("set").agg(F.min(F.struct("apart", "pivot")).alias("e")).select("set", F.col("e.pivot").alias("pivot"))
    return linked(nearest, gather, least)


def linked(nearest: DataFrame, gather, least: Fraction) -> DataFrame:
    """Of the pairs (set, pivot), one a set, those that are similar enough."""
    nearest = written(nearest, "meeting-nearest")
    held = written(gather(nearest.select("set").union(nearest.select("pivot"))), "meeting-sets")
    return written(checked(nearest, held, least), "meeting-links")


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """set, pivot: a forest of the pairs (or several, of very many pairs)."""
    out = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["set", "pivot"])
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a, b = np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) >= CHAINED:
            a, b = forest(a, b)
            if len(a) > CHAINED // 2:
                yield out(a, b)
                a = b = np.zeros(0, np.int64)
    yield out(*forest(a, b))


def crowds(near: DataFrame) -> DataFrame:
    """set, crowd: the smallest set that chains of the pairs (set, pivot) lead to. Tasks of CHAINED pairs make forests first."""
    few = near.select("set", "pivot").coalesce(max(1, math.ceil(near.count() / CHAINED))).mapInArrow(_chains, "set long, pivot long")
    return components(written(few, "meeting-chains"), "set", "pivot").select(F.col("node").alias("set"), F.col("label").alias("crowd"))


def placed(rows: DataFrame) -> DataFrame:
    """Rows of each anchor and part in one task: those at home (role 1) first, of larger sets first. rows: parts (null: 1) and the columns that go along.
    A row is at home in one part of its anchor, and visits (role 0) the later ones, so that each pair meets once. One that only visits its anchor (visit, where rows have it) comes to all parts."""
    at = lambda part, role: F.struct(part.cast("int").alias("part"), F.lit(role).cast("byte").alias("role"))
    rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("set"), F.col("parts")))
    later = F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p > F.col("own")), lambda p: at(p, 0))
    to = F.concat(F.array(at(F.col("own"), 1)), later)
    if "visit" in rows.columns:
        to = F.when(F.col("visit"), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: at(p, 0))).otherwise(to)
    rows = rows.withColumn("to", F.explode(to))
    rows = rows.select("anchor", "to.part", "to.role", *[c for c in rows.columns if c not in ("anchor", "parts", "own", "to")])
    return sorted_places(rows)


def sorted_places(rows: DataFrame) -> DataFrame:
    return rows.repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.desc("role"), F.desc("set"))


def checked(pairs: DataFrame, held: DataFrame, least: Fraction) -> DataFrame:
    """Of the pairs (set, pivot) those whose sets (held: set, hashes) are similar enough. Narrow rows go to a pivot's hashes, however many they are."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for u, v in zip(batch.column(2), batch.column(3)):
                u, v = np.frombuffer(u.as_buffer(), np.uint64), np.frombuffer(v.as_buffer(), np.uint64)
                kept.append(bool(enough(len(np.intersect1d(u, v, assume_unique=True)), len(u), len(v), least)))
            yield batch.select(["set", "pivot"]).filter(pa.array(kept, pa.bool_()))

    hashes = lambda key, name: held.select(F.col("set").alias(key), F.col("hashes").alias(name))
    rows = spread_join(pairs, hashes("pivot", "v"), "pivot", "set", hot_keys(pairs, "pivot", pairs.count()))
    return rows.join(hashes("set", "u"), "set").select("set", "pivot", "u", "v").mapInArrow(check, "set long, pivot long")


def _first_shared(bands: np.ndarray, a: np.ndarray, others: np.ndarray, b: np.ndarray, band: np.ndarray | None, word: int = 0) -> np.ndarray:
    """Of pairs of rows a of bands and b of others, whether the first band that both have alike, but for one bit of the word, is this one (None: whether there is one)."""
    out = np.zeros(len(a), bool)
    for s in range(0, len(a), SLICE):
        off = bands[a[s : s + SLICE]] ^ others[b[s : s + SLICE]]
        alike = (off >> word == 0) & (off & off - 1 == 0) if word else off == 0
        out[s : s + SLICE] = alike.any(1) if band is None else (alike.argmax(1) == band[s : s + SLICE]) & alike.any(1)
    return out


def _matrix(column: pa.ListArray, kind: str) -> np.ndarray:
    flat = column.flatten().to_numpy().astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _open_pairs(rows: dict, homes: dict, visits: np.ndarray, first: np.ndarray, counts: np.ndarray, within: float, word: int = 0, anywhere: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(visit, home) of pairs that are to be checked: of different components, of near sketches, and here in the first band that they share (where rows have their bands; anywhere: that share a band).
    Visit k of rows meets counts[k] of homes from first[k] on."""
    v = np.repeat(visits, counts)
    h = np.arange(len(v)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
    # of two sets at home, one visits the other
    keep = (rows["label"][v] != homes["label"][h]) & ((rows["role"][v] == 0) | (rows["set"][v] < homes["set"][h]))
    v, h = v[keep], h[keep]
    bits = np.zeros(len(v), np.int64)
    for k in range(rows["bits"].shape[1]):
        bits += np.bitwise_count(rows["bits"][v, k] ^ homes["bits"][h, k])
    v, h = v[bits <= within], h[bits <= within]
    if rows["bands"] is None:
        return v, h
    keep = _first_shared(rows["bands"], v, homes["bands"], h, None if anywhere else rows["key"][v] >> 48, word)
    return v[keep], h[keep]


def _columns(batch: pa.RecordBatch) -> dict:
    at = {c: batch.column(c).to_numpy() for c in ("anchor", "part", "role", "set", "label")}
    first = [c for c in batch.schema.names if c.startswith("bits_")]
    bits = np.stack([batch.column(c).to_numpy() for c in first], 1) if first else _matrix(batch.column("bits"), "int64")
    bands = None if first else _matrix(batch.column("bands"), "int32")
    return at | {"key": at["anchor"] << 16 | at["part"], "bits": bits.view(np.uint64), "bands": bands}


_PLACE = "anchor long, part int, role byte, set long, label long"


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of rows sorted by place, role (those at home first) and set, large ones first, so that a later row visits the held ones: each batch, its columns, the rows at home that it meets, their columns,
    and (visits, first, counts) of CHUNK pairs each."""
    held: pa.Table | None = None  # rows at home in the place that the last batch ended in
    for batch in batches:
        if not batch.num_rows:
            continue
        at = _columns(batch)
        own = pa.Table.from_batches([batch]).filter(pa.array(at["role"] == 1))
        table = (pa.concat_tables([held, own]) if held is not None else own).combine_chunks()
        if table.num_rows:
            homes = _columns(table.to_batches()[0])
            first = np.searchsorted(homes["key"], at["key"])
            counts = np.searchsorted(homes["key"], at["key"], "right") - first
            total = np.concatenate([[0], np.cumsum(counts)])
            begin, slices = 0, []
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(total, total[begin] + CHUNK, "right")) - 1)
                slices.append((np.arange(begin, min(end, batch.num_rows)), first[begin:end], counts[begin:end]))
                begin = end
            yield batch, at, table, homes, slices
            held = table.filter(pa.array(homes["key"] == at["key"][-1]))


def _near(within: float):
    """Rows as _met takes them; out: of each set the smallest that is near it at a place, and their differing bits, for sets that have a smaller one. Pairs of no bits
    make the chains whole: those that are near by chains of all pairs are so by chains of what comes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, at, _, homes, slices in _met(batches):
            for visits, first, counts in slices:
                v, h = _open_pairs(at, homes, visits, first, counts, within)
                if not len(v):
                    continue
                a, b = at["set"][v], homes["set"][h]
                of_v, of_h = np.full(len(at["set"]), np.iinfo(np.int64).max), np.full(len(homes["set"]), np.iinfo(np.int64).max)
                np.minimum.at(of_v, v, b)
                np.minimum.at(of_h, h, a)
                few = np.flatnonzero((a > b) & (of_v[v] == b) | (b > a) & (of_h[h] == a))
                large, small = np.maximum(a, b)[few], np.minimum(a, b)[few]
                bits = np.bitwise_count(at["bits"][v[few]] ^ homes["bits"][h[few]]).sum(1, dtype=np.int32)
                member, root = forest(large, small)

                def top(x: np.ndarray, member: np.ndarray = member, root: np.ndarray = root) -> np.ndarray:
                    i = np.minimum(np.searchsorted(member, x), len(member) - 1)
                    return np.where(member[i] == x, root[i], x)

                x, y = top(a), top(b)
                x, y = forest(x[x != y], y[x != y])
                apart = pa.array(np.concatenate([bits, np.zeros(len(x), np.int32)]), mask=np.arange(len(bits) + len(x)) >= len(bits))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([large, x])), pa.array(np.concatenate([small, y])), apart], names=["set", "pivot", "apart"])

    return run


def _needed(within: float, word: int = 0, anywhere: bool = False):
    """Rows as _met takes them; out: the rows, as they are, that have an open pair there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, table, homes, slices in _met(batches):
            of_visits, of_homes = np.zeros(batch.num_rows, bool), np.zeros(table.num_rows, bool)
            for visits, first, counts in slices:
                v, h = _open_pairs(at, homes, visits, first, counts, within, word, anywhere)
                of_visits[v], of_homes[h] = True, True
            yield batch.filter(pa.array(of_visits))
            yield from table.filter(pa.array(of_homes)).combine_chunks().to_batches()

    return run


def _settle(least: Fraction, within: float, word: int = 0, anywhere: bool = False):
    """Rows as _needed gives them, with their hashes, sorted likewise; out: a forest of the links among each place's open pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, sets, words = None, None, [], None  # the place, its rows at home, their hashes, all their members

        def compare(rows: dict, own: list[np.ndarray]) -> pa.RecordBatch | None:
            nonlocal words
            if words is None:
                members = np.concatenate(sets)
                words, ids = np.unique(members, return_inverse=True)
                words = (words, ids, np.cumsum([0, *map(len, sets)]))
            vocabulary, ids, begins = words
            order, left, right = np.arange(len(homes["set"])), [], []
            mark = np.zeros(len(vocabulary), bool)
            for k in range(len(own)):
                _, h = _open_pairs(rows, homes, np.array([k]), order[:1], order[-1:] + 1, within, word, anywhere)
                if not len(h):
                    continue
                at = np.searchsorted(vocabulary, own[k])
                at = at[(at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == own[k])]
                mark[at] = True
                sizes = begins[h + 1] - begins[h]
                flat = np.repeat(begins[h] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                both = np.add.reduceat(mark[ids[flat]].astype(np.int64), np.cumsum(sizes) - sizes)
                mark[at] = False
                h = h[enough(both, len(own[k]), sizes, least)]
                left.append(np.full(len(h), rows["set"][k]))
                right.append(homes["set"][h])
            if sum(map(len, left)):
                a, b = forest(np.concatenate(left), np.concatenate(right))
                return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["set", "pivot"])
            return None

        def ended() -> Iterator[pa.RecordBatch]:
            if homes is not None and (out := compare(homes, sets)) is not None:
                yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            at = _columns(batch)
            hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("hashes")]
            cuts = np.flatnonzero((np.diff(at["key"]) != 0) | (np.diff(at["role"]) != 0)) + 1
            for s, e in zip([0, *cuts], [*cuts, batch.num_rows]):
                rows, own = {c: x[s:e] for c, x in at.items()}, hashes[s:e]
                if rows["key"][0] != key:
                    yield from ended()
                    key, homes, sets, words = rows["key"][0], None, [], None
                if rows["role"][0] == 1:
                    homes = rows if homes is None else {c: np.concatenate([homes[c], rows[c]]) for c in homes}
                    sets.extend(x.copy() for x in own)
                elif homes is not None and (out := compare(rows, own)) is not None:
                    yield out
        yield from ended()

    return run


def links(sets: DataFrame, gather, least: Fraction, share: float, word: int = 0, longs: int = FIRST) -> DataFrame:
    """sets: SETS, a row a set. gather(some: set, first) gives (set, hashes: binary) of some sets; share: of the bits of sketches, that differ between
    sets of the least similarity; word: of how many low bits of a band's value one may differ between sets that meet (0: none; else the length of a perfect Hamming code); longs: of a sketch, that the first comparison reads. (set, pivot): links that join
    all sets joined by chains of pairs that meet in a band, have near sketches, and have at least this Jaccard similarity."""
    n_bits = 64 * (sets.agg(F.max(F.size("bits"))).first()[0] or FIRST)
    within = radius(share, n_bits)
    wanted = lambda some: gather(some.distinct().join(sets.select("set", "first"), "set"))
    rows = sent(sets, word)
    visit = ["visit"] if word else []
    at_home = ~F.col("visit") if word else F.lit(True)
    homes = F.count_if(at_home)
    crowded = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("sets"), homes.alias("homes")).where(F.col("homes") > HOMES)
    crowded = written(crowded, "meeting-crowded")
    first, hot = None, hot_anchors(crowded)
    rows = rows.withColumn("label", F.col("set"))
    parts = crowded.select("anchor", F.ceil(F.col("homes") / HOMES).cast("int").alias("parts"))
    if not crowded.isEmpty():
        first = star(rows.where(at_home).join(crowded.select("anchor"), "anchor", "left_semi"), hot, sets, wanted, least, within)
        labels = components(first, "set", "pivot").select(F.col("node").alias("set"), F.col("label").alias("of"))
        rows = rows.join(labels, "set", "left").withColumn("label", F.coalesce("of", "set")).drop("of")
    rows = spread_join(rows, parts, "anchor", "set", hot, "left")
    few = [F.get("bits", F.lit(k)).alias(f"bits_{k}") for k in range(longs)]
    near = placed(rows.select("anchor", "set", "label", *few, *visit, "parts")).mapInArrow(_near(radius(share, 64 * longs)), "set long, pivot long, apart int")
    near = written(near, "meeting-near")

    nearest = near.where("apart is not null").groupBy("set").agg(F.min(F.struct("apart", "pivot")).alias("e")).select("set", F.col("e.pivot").alias("pivot"))
    found = linked(nearest, wanted, least)
    found = found if first is None else found.unionByName(first)
    labels = components(found, "set", "pivot").withColumnRenamed("node", "set")
    # a crowd's place: a number of 47 bits, as a place's key has room for; crowds of one number share it
    members = crowds(near).select("set", F.shiftrightunsigned(F.xxhash64("crowd"), 17).alias("anchor"))
    members = members.join(labels, "set", "left").withColumn("label", F.coalesce("label", "set")).join(sets.select("set", "n"), "set")
    members = written(members, "meeting-members")
    open_ = members.groupBy("anchor").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("weight"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    parts = F.greatest(F.ceil(F.col("sets") / BLOCK), F.ceil(F.col("weight") / WEIGHT)).cast("int")
    open_ = written(open_.select("anchor", "sets", parts.alias("parts")), "meeting-open")
    rows = spread_join(members, open_.select("anchor", "parts"), "anchor", "set", hot_anchors(open_))
    rows = rows.join(sets.select("set", "bits", "bands"), "set")

    def settled(rows: DataFrame, anywhere: bool) -> DataFrame:
        """rows: as placed takes them, with label, bits and bands."""
        needed = placed(rows).drop("visit").mapInArrow(_needed(within, word, anywhere), _PLACE + ", bits array<long>, bands array<int>").dropDuplicates(["anchor", "part", "role", "set"])
        needed = written(needed, "meeting-needed")
        held = written(wanted(needed.select("set")), "meeting-sets")
        brought = sorted_places(needed.join(held, "set").select("anchor", "part", "role", "set", "label", "bits", "bands", "hashes"))
        return brought.mapInArrow(_settle(least, within, word, anywhere), "set long, pivot long")

    more = settled(rows.where(F.col("parts") <= PARTS).select("anchor", "set", "label", "bits", "bands", "parts"), True)
    if not open_.where(F.col("parts") > PARTS).isEmpty():
        vast = written(rows.where(F.col("parts") > PARTS).select("set", "n", "label", "bits", "bands"), "meeting-vast")
        more = more.unionByName(settled(_by_bands(vast, word, few, radius(share, 64 * longs)), False))
    return written(found.unionByName(more), "meeting-links")


def _by_bands(vast: DataFrame, word: int, few: list[Column], within: float) -> DataFrame:
    """vast: set, n, label, bits, bands. A row for each anchor at which a set has an open pair by first bits; with the parts that an anchor's sets at home are dealt to."""
    visit = ["visit"] if word else []
    at_home = ~F.col("visit") if word else F.lit(True)
    homes = F.count_if(at_home)

    def dealt(rows: DataFrame) -> DataFrame:
        parts = F.greatest(F.lit(1), F.ceil(F.col("homes") / HOMES), F.ceil(F.col("weight") / WEIGHT)).cast("int")
        places = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("sets"), homes.alias("homes"), F.sum(F.when(at_home, F.col("n"))).alias("weight")).where("homes > 0")
        places = written(places.select("anchor", "sets", parts.alias("parts")), "meeting-places")
        return spread_join(rows, places.select("anchor", "parts"), "anchor", "set", hot_anchors(places))

    rows = dealt(sent(vast, word, "label"))
    schema = _PLACE + "".join(f", bits_{k} long" for k in range(len(few))) + ", visit boolean" * len(visit)
    near = placed(rows.select("anchor", "set", "label", *few, *visit, "parts")).mapInArrow(_needed(within), schema)
    near = written(near.select("anchor", "set", *visit).distinct(), "meeting-met")
    rows = dealt(near.join(vast.select("set", "n"), "set"))
    return rows.join(vast.select("set", "label", "bits", "bands"), "set").select("anchor", "set", "label", "bits", "bands", *visit, "parts")
