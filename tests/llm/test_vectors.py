"""Hard negatives and vector codes against plain loops, and both queries against their SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from framewright.llm import negatives, queries
from framewright.llm.codes import assign, compress
from framewright.llm.negatives import hard_negatives, products

SCHEMA = "vec_id long, embedding array<float>, label int, row string, anchor string, code string, part string"
INF, NAN = float("inf"), float("nan")


@pytest.fixture
def vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, label, "a", "b", "c", "d") for i, v, label in rows], SCHEMA)

    return make


def some(n, width, seed, spread=0.3):
    r = random.Random(seed)
    return [(i, [float(np.float32(r.gauss(0.05, spread))) for _ in range(width)], r.randrange(3)) for i in range(n)]


def odd(width):
    whole = [0.5] * width
    return [(None, whole, 1), (150, whole, 1), (150, whole, 1), (151, whole, 2), (151, [0.3] * width, 2), (200, None, 1), (201, [NAN, *whole[1:]], 1), (202, [INF, *whole[1:]], 1), (203, [None, *whole[1:]], 1), (204, whole, None), (205, whole[:3], 0), (206, [], 0), (250, [], 0), (251, [0.4] * width, 0)]


def brute_negatives(rows, every=50):
    kept = [(i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    place = lambda i: (i is None, i or 0)
    out = []
    for k, (i, v, label) in enumerate(kept):
        if i is None or i % every:
            continue
        others = sorted(((-sum(x * y for x, y in zip(v, u)), place(j), of) for m, (j, u, of) in enumerate(kept) if m != k))
        shown = lambda p: None if p[0] else p[1]
        for p, j, _ in [o for o in others if o[2] == label][:5]:
            p = -p
            good = [(-s, m) for s, m, of in others if of != label and 50 * p <= -100 * s <= 95 * p][:3]
            out += [(i, shown(j), rank, shown(m), p, s) for rank, (s, m) in enumerate(good, 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("tile,block", [(4096, 16 << 20), (7, 600)])
def test_negatives_are_those_of_plain_loops(vectors, monkeypatch, tile, block):
    monkeypatch.setattr(negatives, "CANDIDATES", tile)
    monkeypatch.setattr(negatives, "ANCHORS", tile)
    rows = [(i * 5, v, label) for i, v, label in some(150, 6, 1)] + odd(6) + [(1000 + i, [0.5] * 6, i % 2) for i in range(60)]
    found = hard_negatives(vectors(rows), block_bytes=block)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows)
    assert sorted(str(tuple(r)) for r in found.collect()) == want and len(want) > 100


def test_negatives_of_empty_tables_and_no_anchors(vectors):
    for rows in ([], [(1, [0.5, 0.5], 1), (3, [0.2, 0.4], 2)], [(50, None, 1)], [(50, [], 1)]):
        assert hard_negatives(vectors(rows)).collect() == []


def test_products_are_exact_beyond_doubles():
    a, b = np.array([[2.0**30, 1.0, 3.0]]), np.array([[2.0**32, 7.0, 1.0], [1.0, 1.0, 1.0]])
    assert products(a, b).tolist() == [[2**62 + 10, 2**30 + 4]]
    with pytest.raises(OverflowError):
        products(np.array([[2.0**40]]), np.array([[2.0**40]]))


def brute_codes(rows, parts=8, entries=16, rounds=6, factor=4096):
    kept = [(i, [math.floor(factor * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))[:entries]
    books = [[v[p * width : (p + 1) * width] for _, v, _ in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))

    for round_ in range(rounds + 1):
        best = [[nearest(v[p * width : (p + 1) * width], books[p]) for p in range(parts)] for _, v, _ in kept]
        if round_ == rounds:
            break
        for p in range(parts):
            for k in range(len(first)):
                own = [v[p * width : (p + 1) * width] for (_, v, _), b in zip(kept, best) if b[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    errors = [sum(d for d, _ in b) for b in best]
    by = {}
    for (_, _, label), e in zip(kept, errors):
        by[label] = by.get(label, 0) + e
    return sorted(str((i, "".join(f"{k:02x}" for _, k in b), e, by[label], digest)) for (i, _, label), b, e in zip(kept, best, errors))


def test_codes_are_those_of_plain_loops(vectors):
    ties = [(300 + i, [0.25 * (k % 2) for k in range(32)], None) for i in range(9)]
    rows = [(i + 10, v, label) for i, v, label in some(160, 32, 4)] + odd(32) + ties
    for given in (rows, rows[:7], odd(32)[5:9], [], [(1, [], 1), (2, [], None)], [(5, [0.1, 0.2, 0.3], 1), (4, [0.5], 1)]):
        found = compress(vectors(given))
        assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted(str(tuple(r)) for r in found.collect()) == brute_codes(given)


def test_codes_with_many_labels(vectors, monkeypatch):
    from framewright.llm import codes, common

    monkeypatch.setattr(codes, "LABELS", 1)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rows = some(120, 16, 5)
    assert sorted(str(tuple(r)) for r in compress(vectors(rows)).collect()) == brute_codes(rows)


def test_bounds_hold_and_save_distances():
    """Upper and lower bounds stay on their sides of the true distances, and later rounds compute few of all distances."""
    r = np.random.default_rng(6)
    centres = r.integers(-3000, 3000, (16, 8))
    vectors = centres[r.integers(0, 16, 3000)] + r.integers(-300, 300, (3000, 8))
    entries = vectors[:16].copy()
    code, upper, lower = np.zeros(3000, np.uint8), np.full(3000, np.inf, np.float32), np.zeros((3000, 16), np.float32)
    moved, counts = np.zeros(16), []
    for _ in range(8):
        counts.append(assign(vectors, entries, moved, code, upper, lower))
        squares = ((vectors[:, None] - entries) ** 2).sum(2)
        assert (code == squares.argmin(1)).all()
        assert (upper.astype(np.float64) >= np.sqrt(squares[np.arange(3000), code])).all() and (lower.astype(np.float64) <= np.sqrt(squares)).all()
        following = np.stack([vectors[code == k].sum(0) // (code == k).sum() if (code == k).any() else entries[k] for k in range(16)])
        moved, entries = np.sqrt(((following - entries) ** 2).sum(1)), following
    assert counts[0] < 3000 * 16 and counts[-1] < 3000 * 16 / 5


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_vector_codes", "op13_minhash"])
def test_queries_agree_with_sql(spark, name):
    data = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    want = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    out = queries.queries()[name](spark, data)
    assert sorted(columns) == sorted(out.columns)
    have = sorted(str(tuple(r)) for r in out.select(*columns).collect())
    assert have == sorted(map(str, want.fetchall())) and have
