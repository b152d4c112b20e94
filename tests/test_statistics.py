"""Exact quantiles by counted ranges, reservoirs, and moments that keep their digits."""

import random
import statistics as plain

import numpy as np
import pytest
from framewright.operators import statistics


@pytest.mark.parametrize("cells,few", [(1024, 4096), (16, 3)])
def test_quantiles_of_any_distribution_and_split(spark, monkeypatch, cells, few):
    monkeypatch.setattr(statistics, "CELLS", cells)
    monkeypatch.setattr(statistics, "FEW", few)
    r = random.Random(1)
    groups = {"even": [float(k) for k in range(500)], "far": [2.0**k for k in range(-20, 20)], "ties": [1.0] * 300 + [2.0] * 5, "one": [7.5], "same": [3.0] * 50, None: [r.gauss(0, 1) for _ in range(400)], "signs": [-0.5, -1e9, 1e9, 0.0]}
    rows = [(k, x) for k, xs in groups.items() for x in xs] + [("even", None), ("none", None)]
    r.shuffle(rows)
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "k string, x double").repartition(parts)
        found = {row.k: row for row in statistics.quantiles(df, ["k"], "x", {"q01": 0.01, "mid": 0.5, "top": 1.0}).collect()}
        assert set(found) == {*groups, "none"} and found["none"].mid is None
        for k, xs in groups.items():
            assert [found[k].q01, found[k].mid, found[k].top] == pytest.approx(np.quantile(xs, [0.01, 0.5, 1.0]).tolist(), rel=1e-12)


def test_leaf_stats_count_each_value_once(spark):
    rows = spark.range(30_000).selectExpr("id % 2 AS k", "double(id div 2) AS x")  # more rows than are sorted as they are
    for row in statistics.leaf_stats(rows, ["k"], "x").collect():
        assert (row.n, row.q01, row.q99) == (15_000, pytest.approx(149.99), pytest.approx(14849.01))


def test_reservoirs_merge_in_any_order(spark):
    rows = spark.range(6000).selectExpr("id", "id % 3 AS k", "double(id) AS x")
    whole = {(r.k, r.key, r.value) for r in statistics.reservoir(rows, ["k"], "x", ["id"], 500).collect()}
    assert len(whole) == 1500
    parts = [statistics.reservoir(rows.where(f"id % 4 IN ({own})").repartition(n), ["k"], "x", ["id"], 500) for own, n in (("0", 1), ("2, 3", 5), ("1", 3))]
    for order in (parts, parts[::-1]):
        merged = order[0].unionByName(order[1])
        merged = statistics.merge_reservoirs(statistics.merge_reservoirs(merged, ["k"], 500).unionByName(order[2]), ["k"], 500)
        assert {(r.k, r.key, r.value) for r in merged.collect()} == whole
    assert abs(np.mean([v for *_, v in whole]) - 3000) < 200
    assert statistics.reservoir(rows, ["k"], "x", ["id"], 5000).count() == 6000


def test_weighted_moments_keep_their_digits(spark):
    xs = [1e9 + k / 8 for k in range(40)]
    rows = spark.createDataFrame([("a", x, 1 + k % 3) for k, x in enumerate(xs)] + [(None, 2.0, 1)], "k string, x double, w int")
    found = {r.k: r for r in statistics.weighted_moments(rows, ["k"], "x", "w").collect()}
    every = [x for k, x in enumerate(xs) for _ in range(1 + k % 3)]
    assert found["a"].n == len(every) and found["a"].mean == pytest.approx(plain.fmean(every), rel=1e-15)
    assert found["a"].std == pytest.approx(plain.stdev(every), rel=1e-9)
    assert (found[None].n, found[None].std) == (1, 0.0)


def test_stored_tables_can_be_removed(spark):
    from framewright.operators import ranges

    kept = ranges.stored(spark.range(5), "some")
    assert kept.count() == 5 and ranges.remove_stored(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0]).count()
    assert ranges.remove_stored(spark) == 0
