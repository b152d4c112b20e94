"""SimHash links against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from framewright.llm import common, simhash
from framewright.llm.simhash import NARROW, WIDE, anchors, components, fingerprint, links, near_duplicates


def brute_components(values):
    """The smallest value reachable over steps of at most 4 bits."""
    values, root = sorted(set(values)), {}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for v in values:
        root[v] = v
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def prints(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        v = r.getrandbits(64)
        out.append(v)
        for _ in range(r.choice([0, 0, 1, 3, 8])):
            for bit in r.sample(range(64), r.randint(1, 6)):
                v ^= 1 << bit
            out.append(v)
    return [v - 2**64 if v >> 63 else v for v in out]


@pytest.mark.parametrize("homes,cover,hot", [(2048, NARROW, 1 << 20), (3, NARROW, 7), (2048, WIDE, 1 << 20), (3, WIDE, 7)])
def test_links_join_what_all_pairs_join(spark, monkeypatch, homes, cover, hot):
    monkeypatch.setattr(simhash, "HOMES", homes)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    values = prints(250, 5) + [2**k for k in range(40)] + [0]
    found = links(spark.createDataFrame([(v,) for v in sorted(set(values))], "fp long"), cover)
    labels = {r.node: r.label for r in components(found, "fp", "other").collect()}
    assert all(labels.get(v, v) == low for v, low in brute_components(values).items())


@pytest.mark.parametrize("cover,sends", [(NARROW, 3 * 18), (WIDE, 6 * 20)])
def test_neighbours_meet_at_an_anchor(cover, sends):
    r = random.Random(2)
    for _ in range(300):
        x = r.getrandbits(64)
        y = x
        for bit in r.sample(range(64), 4):
            y ^= 1 << bit
        a, i, home = anchors(np.array([x, y], np.uint64).view(np.int64), cover)
        assert set(a[(i == 0) & (home == 1)]) & set(a[(i == 1) & (home == 0)])
        assert len(a) < 2 * sends


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "  \n", "A b C", "one two three four", "É İ Ünï x\x0by z Q w e", "a a a a a a a b", "no break space here and there ok"])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


def test_near_duplicates(table, odd_rows):
    rows = odd_rows + [(100 + i, odd_rows[3][1].replace(f"word{i}", "changed"), "a") for i in range(20)] + [(1000, None, None)]
    own = defaultdict(set)
    for i, t, _ in rows:
        own[plain_fingerprint(t)].add(i)
    label = brute_components(list(own))
    lowest = defaultdict(list)
    for fp, ids in own.items():
        lowest[label[fp]] += [i for i in ids if i is not None]
    want = sorted(str((i, f"{plain_fingerprint(t):016x}", min(lowest[label[plain_fingerprint(t)]], default=None))) for i, t, _ in rows)
    assert sorted(str(tuple(r)) for r in near_duplicates(table(rows)).collect()) == want
    assert near_duplicates(table([])).collect() == []


@pytest.mark.parametrize("hot", [1 << 20, 1000])
def test_components_of_a_chain_and_a_star(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    n = 30_000 if hot > 1000 else 3000
    r = random.Random(4)
    names = r.sample(range(10**9), 2 * n)
    chain, star = names[:n], names[n:]
    edges = list(zip(chain, chain[1:])) + [(star[0], v) for v in star[1:]]
    found = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert len(found) == 2 * n
    assert {(r.node, r.label) for r in found} == {(v, min(chain)) for v in chain} | {(v, min(star)) for v in star}
