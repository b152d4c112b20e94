"""Sharding and mixing against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from framewright.llm import sharding
from framewright.llm.mixing import first_words, mix, mixed_documents
from framewright.llm.sharding import shard_by_bytes, shard_plan
from pyspark.sql import functions as F


def greedy_cuts(sizes: list[int], capacity: int) -> list[int]:
    """The first index of each further shard when shards are filled in order up to capacity."""
    cuts, load = [], 0
    for i, size in enumerate(sizes):
        if load and load + size > capacity:
            cuts.append(i)
            load = 0
        load += size
    return cuts


def smallest_capacity(sizes: list[int], n_shards: int) -> int:
    """Binary search for the least capacity with which greedy filling needs at most n_shards shards."""
    low, high = max(max(sizes, default=0), -(-sum(sizes) // n_shards)), max(sum(sizes), 0)
    while low < high:
        middle = (low + high) // 2
        if len(greedy_cuts(sizes, middle)) < n_shards:
            high = middle
        else:
            low = middle + 1
    return low


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("n_shards", [1, 3, 40])
def test_shards_keep_groups_and_number_slots(table, odd_rows, n_shards):
    rows = shard_by_bytes(table(odd_rows), n_shards).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _, _ in odd_rows)
    homes = defaultdict(set)
    for r in rows:
        homes[(r.text_crc32, r.size)].add(r.shard)
    assert all(len(s) == 1 for s in homes.values())
    expected = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in odd_rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert set(by_shard) <= set(range(n_shards))


@pytest.mark.parametrize("n,seed", [(50, 1), (700, 2), (3000, 3)])
def test_capacity_is_the_least_for_the_order(spark, monkeypatch, n, seed):
    monkeypatch.setattr(sharding, "FIRST_BITS", 4)
    monkeypatch.setattr(sharding, "MORE_BITS", 2)
    x, groups = seed, {}
    for _ in range(n):
        x = x * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        groups[x >> 4] = 20 + (x >> 40) % 1000
    shards = 7
    own, places, cuts = shard_plan(spark.createDataFrame(list(groups.items()), "key long, size long"), shards)
    ordered = sorted(groups, key=lambda k: (places.get(k, k), k))
    ordered = [k for k in ordered if k not in own]
    sizes = [groups[k] for k in ordered]
    capacity = smallest_capacity(sizes, shards - len(own))
    wanted = [(places.get(ordered[i], ordered[i]), ordered[i]) for i in greedy_cuts(sizes, capacity)]
    assert cuts == wanted


def test_capacity_by_brute_force():
    sizes = [5, 1, 1, 9, 2, 2, 2, 7, 3]
    for n in range(1, 6):
        least = next(c for c in range(100) if c >= max(sizes) and len(greedy_cuts(sizes, c)) < n)
        assert smallest_capacity(sizes, n) == least


def test_shards_balance_and_giants_stand_alone(table):
    rows = [(i, f"{i} " * (i % 9 + 3), "a") for i in range(2000)] + [(5000 + i, "giant " * 300, "a") for i in range(20)]
    found = defaultdict(int)
    for r in shard_by_bytes(table(rows), 10).collect():
        found[r.shard] += r.size
    loads = sorted(found.values())
    assert loads[-1] == 20 * (1800 + 16) and loads[0] > 0.95 * loads[-2] and len(loads) == 10


def test_empty_tables(table):
    assert shard_by_bytes(table([]), 4).collect() == []
    assert mix(table([]), [3, 1, 2]).collect() == [] and mixed_documents(table([]), [1]).collect() == []


def brute_targets(sizes, weights, share, most):
    """Resharing the excess by weight until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, target, open_ = share * sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(most * sizes[s] for s in names if s not in open_)
        level = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if level[s] > most * sizes[s]}
        if not above:
            return {s: level.get(s, most * sizes[s]) for s in names}
        open_ -= above
        if not open_:
            return {s: most * sizes[s] for s in names}


def test_mix_meets_targets(table, odd_rows):
    rows = mix(table(odd_rows), [3, 1, 2]).collect()
    sizes, source = Counter(), {}
    for i, t, s in odd_rows:
        sizes[s] += len(words(t))
    target, taken = brute_targets(sizes, [3, 1, 2], 1.5, 2), Counter()
    for r in rows:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, mix(table(odd_rows).repartition(5), [3, 1, 2]).collect()))


def test_mixed_documents_hold_what_was_taken(table, odd_rows):
    docs = table(odd_rows)
    out = mixed_documents(docs, [3, 1, 2])
    assert out.columns == docs.columns
    got, want = Counter(), Counter()
    for r in out.collect():
        got[r.source] += len(words(r.text))
        assert r.n_chars == len(r.text or "")
    for r in mix(docs, [3, 1, 2]).collect():
        want[r.source] += r.taken
    assert +got == +want


def test_first_words(spark):
    cases = [("a b  c\nd", 3), ("  a b", 1), ("a", 1), ("\tx  y ", 2)]
    got = [r[0] for r in spark.createDataFrame(cases, "t string, n long").select(first_words(F.col("t"), F.col("n"))).collect()]
    assert [words(g) for g in got] == [words(t)[:n] for t, n in cases] and all(t.startswith(g) for g, (t, _) in zip(got, cases))
