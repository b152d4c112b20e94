"""Sharding: minimax contiguous partition of ordered groups of equal texts.

Documents with equal texts form an atomic group; its size is the sum of its
documents' sizes (UTF-8 bytes plus a fixed overhead). Groups stand in an order,
and a shard is a run of them. The smallest capacity for which greedy filling needs at most
n_shards shards is found by binary search, and the cuts are made there.

The order: a group's place is a uniform key of its text. Groups over 1/64 of a shard are few
(at most 64 a shard, so that list is bounded whatever the corpus) and would leave
ragged cuts, so they are dealt over the shards first, largest to the emptiest shard, and
stand in the middle of their shard's key range. A group larger than what is left for
each remaining shard has a shard of its own.

The search needs no sorted table: sums over key ranges answer it. Only the ranges that a
cut may fall into are divided further, until every cut is known exactly; the driver holds
those sums only (their number is bounded by a parameter), never documents or groups.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import running_sum, uniform_key, written

#: Bits of a group's place.
BITS = 60
#: Key ranges that the search starts from, and children of a range that it divides.
FIRST_BITS, MORE_BITS = 12, 6


class _Ranges:
    """Sums over key ranges in order; some are single groups (exact), the others can be cut anywhere inside."""

    def __init__(self, rows: list[tuple[int, int, int, bool]]):
        self.rows = sorted(rows)  # (first key, bits, sum, single)
        self.ends, total = [], 0
        for _, _, size, _ in self.rows:
            total += size
            self.ends.append(total)
        self.total = total

    def walk(self, capacity: int, n_shards: int, hopeful: bool) -> tuple[bool, list[tuple[int, int]]]:
        """Greedy filling where a cut inside a divisible range falls as late (hopeful) or as early as it could.
        Returns whether all fits, and for each cut (index of its range, cumulated size at the cut)."""
        at, cuts = 0, []
        for _ in range(n_shards - 1):
            if self.total - at <= capacity:
                return True, cuts
            reach = at + capacity
            i = bisect_right(self.ends, reach)
            begin = self.ends[i - 1] if i else 0
            at = reach if hopeful and not self.rows[i][3] else max(at, begin)
            cuts.append((i, at))
        return self.total - at <= capacity, cuts

    def least(self, n_shards: int, hopeful: bool) -> int:
        low, high = -(-self.total // n_shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.walk(middle, n_shards, hopeful)[0]:
                high = middle
            else:
                low = middle + 1
        return low


def _place_large(large: list[tuple[int, int]], rest: int, n_shards: int) -> tuple[list[int], dict[int, int]]:
    """large: (size, key). Returns the keys of groups with a shard of their own, and the places of the other large ones."""
    large, own = sorted(large, reverse=True), []
    left = rest + sum(size for size, _ in large)
    while large and len(own) < n_shards - 1 and large[0][0] * (n_shards - len(own)) > left:
        size, key = large.pop(0)
        own.append(key)
        left -= size
    shards = n_shards - len(own)
    loads: list[tuple[int, int]] = [(0, i) for i in range(shards)]
    homes: dict[int, int] = {}
    for size, key in large:
        load, home = min(loads)
        loads[home] = (load + size, home)
        homes[key] = home
    small = [max(0, left // shards - load) for load, _ in loads]
    scale, ahead, middle = max(1, sum(small)), 0, []
    for size in small:
        middle.append(((2 * ahead + size) * (1 << BITS)) // (2 * scale))
        ahead += size
    return own, {key: min(middle[home], (1 << BITS) - 1) for key, home in homes.items()}


def shard_plan(groups: DataFrame, n_shards: int) -> tuple[list[int], dict[int, int], list[tuple[int, int]]]:
    """groups: key long, size long, a row each. Returns the keys of the groups with own shards, the places of moved
    groups, and the first (place, key) of each further shard."""
    total, = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()
    large = [tuple(r) for r in groups.where(F.col("size") * (64 * n_shards) > F.lit(total)).select("size", "key").collect()]
    own, places = _place_large(large, total - sum(s for s, _ in large), n_shards)
    taken = set(own) | set(places)
    rest = groups.where(~F.col("key").isin(list(taken))) if taken else groups
    shards = n_shards - len(own)
    if shards <= 1 or not total:
        return own, places, []
    single = {(places[key], key): size for size, key in large if key in places}

    def sums(within: Column, bits: int) -> list[tuple[tuple[int, int], int, int, bool]]:
        first = F.shiftleft(F.expr(f"shiftright(key, {BITS - bits})"), BITS - bits)
        rows = rest.where(within).groupBy(first.alias("first")).agg(F.sum("size"), F.count(F.lit(1)), F.min("key")).collect()
        return [((key, key), BITS, size, True) if n == 1 else ((first, -1), bits, size, False) for first, size, n, key in rows]

    bits = FIRST_BITS
    known = sums(F.lit(True), bits)
    while True:
        # a moved group stands at its place, before the groups of the range that begins there
        ranges = _Ranges([(place, BITS, size, True) for place, size in single.items()] + known)
        low, high = ranges.least(shards, True), ranges.least(shards, False)
        early, late = ranges.walk(low, shards, False)[1], ranges.walk(high, shards, True)[1]
        unsure: set[int] = set()
        for k in range(shards - 1):
            a = early[k][0] if k < len(early) else len(ranges.rows) - 1
            b = late[k][0] if k < len(late) else len(ranges.rows) - 1
            unsure.update(i for i in range(min(a, b), max(a, b) + 1) if not ranges.rows[i][3])
        if not unsure:
            cuts = ranges.walk(high, shards, False)[1]
            return own, places, [ranges.rows[i][0] for i, _ in cuts]
        chosen = sorted(unsure)
        by_bits: dict[int, list[int]] = {}
        for i in chosen:
            by_bits.setdefault(ranges.rows[i][1], []).append(ranges.rows[i][0][0])
        known = [x for x in ranges.rows if x[0] not in single]
        divided = {ranges.rows[i][0] for i in chosen}
        known = [x for x in known if x[0] not in divided]
        for held, firsts in by_bits.items():
            deeper = min(BITS, held + MORE_BITS)
            found = sums(F.shiftleft(F.expr(f"shiftright(key, {BITS - held})"), BITS - held).isin(firsts), deeper)
            known += found if deeper < BITS else [((first[0], first[0]), BITS, size, True) for first, _, size, _ in found]


def shard_by_bytes(docs: DataFrame, n_shards: int, overhead: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of docs: doc_id, size, text_crc32, shard (0 to n_shards - 1), slot.

    A null text counts as an empty one, and empty texts are one group like any other. Repeated rows and
    repeated ids keep a row each. slot numbers a shard's rows from 0 without gaps. With fewer groups than shards
    some shards stay empty; an empty table gives an empty result. Other columns of docs are not read.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"), uniform_key(whole).alias("key"), uniform_key(F.col(doc_id)).alias("spread"),
    )
    rows = written(rows, "shard-rows")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    own, places, cuts = shard_plan(groups, n_shards)
    # at most 64 large groups a shard: a proven bound for the broadcast
    moved = [(k, place, None) for k, place in places.items()] + [(k, None, i) for i, k in enumerate(own)]
    moved = docs.sparkSession.createDataFrame(moved, "key long, moved long, own int")
    rows = rows.join(F.broadcast(moved), "key", "left")
    place, key = F.coalesce(F.col("moved"), F.col("key")), F.col("key")
    shard = F.lit(len(own))
    for first, then in cuts:
        shard = shard + ((place > first) | ((place == first) & (key >= then))).cast("int")
    shard = F.coalesce(F.col("own"), shard)
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("one", F.lit(1).cast("long"))
    placed = running_sum(placed, "shard", "spread", "one", ["doc_id", "key"], "slot")
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot")
