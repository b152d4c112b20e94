"""Circulant MinHash near-duplicates against all pairs of whole sets."""

import random
from fractions import Fraction

import numpy as np
import pytest
from framewright.llm import common, meeting
from framewright.llm.circulant import SKETCH, UNIVERSE, bands_and_bits, near_duplicates, places, shape, signature


def shingle_set(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) of rows of ids that may be null or repeated."""
    sets = [frozenset(shingle_set(t)) for _, t, _ in rows]
    parents = list(range(len(rows)))

    def find(v):
        while parents[v] != v:
            v = parents[v]
        return v

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                parents[y] = x
    lowest = {}
    for i, (doc, _, _) in enumerate(rows):
        if doc is not None:
            lowest[find(i)] = min(lowest.get(find(i), doc), doc)
    return sorted(map(str, ((doc, len(s), lowest.get(find(i)), doc == lowest.get(find(i))) for i, ((doc, _, _), s) in enumerate(zip(rows, sets)))))


def found(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(str(tuple(r)) for r in df.collect())


def crowd(n, words, most, seed):
    r = random.Random(seed)
    base = [f"Word{k}" for k in range(words)]
    for i in range(n):
        copy = list(base)
        for at in r.sample(range(words), r.randint(0, most)):
            copy[at] = f"new{i}x{at}"
        yield " ".join(copy)


@pytest.mark.parametrize("homes,hot", [(2048, 1 << 20), (4, 9)])
def test_components_are_those_of_all_pairs(table, odd_rows, monkeypatch, homes, hot):
    monkeypatch.setattr(meeting, "HOMES", homes)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    texts = [*crowd(150, 150, 7, 1), *crowd(60, 90, 3, 2), *crowd(40, 400, 30, 3)]
    texts += [" ".join(f"t{k}" for k in range(s, s + 80)) for s in range(0, 90, 3)]  # a chain
    rows = odd_rows + [(1000 - i, t, "a") for i, t in enumerate(texts)] + [(2000, "SAME\ttext here", "a"), (2001, None, None), (2001, "", "a")]
    assert found(near_duplicates(table(rows))) == brute(rows)


def test_empty_table_and_nothing_alike(table):
    assert found(near_duplicates(table([]))) == []
    rows = [(1, "a b c d e f g", "x"), (2, "h i j k l m n", "x"), (3, None, None)]
    assert found(near_duplicates(table(rows))) == brute(rows)


def test_coordinates_estimate_similarity():
    """Coordinates agree as often as sets have members in common, as with independent permutations; pairs at the least similarity share a band."""
    rows, bands = shape(1000, Fraction(85, 100))
    assert (rows, bands) == (6, 43)
    r = np.random.default_rng(3)
    shares, met = [], 0
    for _ in range(300):
        members = r.integers(0, 1 << 63, 215, dtype=np.uint64)
        a, b = np.unique(members[:200]), np.unique(np.concatenate([members[15:200], members[200:215]]))  # 185 of 215: 0.86
        x, y = signature(a, rows * bands), signature(b, rows * bands)
        shares.append((x == y).mean())
        met += bool((bands_and_bits(x, rows)[0] == bands_and_bits(y, rows)[0]).any())
    assert abs(np.mean(shares) - 185 / 215) < 0.01 and np.std(shares) < 0.03 and met == 300


def test_first_permutation_and_shift():
    every = np.arange(1 << UNIVERSE, dtype=np.uint64)
    assert len(np.unique(places(every))) == len(every)
    one = np.array([12345], np.uint64)
    at = int(places(one)[0])
    order = np.random.default_rng(22).permutation(1 << UNIVERSE)
    assert signature(one, 600).tolist() == [order[(at + k) % (1 << UNIVERSE)] for k in range(600)]


def test_bands_for_any_number_of_documents():
    for n in (0, 10**6, 10**8, 10**10):
        for least in (Fraction(1, 2), Fraction(85, 100), Fraction(1)):
            rows, bands = shape(n, least)
            assert rows * bands >= SKETCH and (least == 1 or (1 - float(least) ** rows) ** bands <= 2.1e-9)
