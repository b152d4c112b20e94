"""Batches padded to their longest, and work dealt by length."""

import pytest
from framewright.operators import sampling
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


@pytest.mark.parametrize("left", [True, False])
def test_batches_are_padded_to_their_longest(spark, left):
    given = [(1, 1, [5, 6, 7], [1, 2, 3]), (2, 1, [8], [4]), (3, 1, None, None), (4, 2, [], []), (5, None, [9, 9], [0, 0]), (6, None, [3], [1])]
    rows = spark.createDataFrame(given, "id int, batch int, ids array<int>, labels array<int>")
    out = {r.id: r for r in sampling.padded(rows, "batch", {"ids": F.lit(0), "labels": F.lit(-100)}, left).collect()}
    assert len(out) == len(given) and set(out[1].asDict()) == {*rows.columns, "mask", "position"}
    for i, b, ids, labels in given:
        n = max(len(x or []) for _, c, x, _ in given if c == b)
        ids, labels = ids or [], labels or []
        pad, r = n - len(ids), out[i]
        both = lambda fill, own: [fill] * pad + own if left else own + [fill] * pad  # noqa: B023, E731
        assert (r.ids, r.labels, r["mask"]) == (both(0, ids), both(-100, labels), both(False, [True] * len(ids)))
        assert r.position == ([-1] * pad + list(range(len(ids))) if left else list(range(n)))


def test_arrays_of_one_length_and_no_rows(spark):
    rows = spark.createDataFrame([(1, [1, 2], [1])], "batch int, ids array<int>, labels array<int>")
    with pytest.raises(PySparkException, match="differ in length"):
        sampling.padded(rows, "batch", {"ids": F.lit(0), "labels": F.lit(0)}).collect()
    assert sampling.padded(rows.limit(0), "batch", {"ids": F.lit(0)}).collect() == []


def test_too_many_lengths_to_deal(spark):
    rows = spark.range(1, 9).select(F.col("id").alias("key"), F.col("id").alias("length"))
    assert sampling.least_loaded(rows, "key", "length", 2, 8).count() == 8
    with pytest.raises(ValueError, match="more than 7"):
        sampling.least_loaded(rows, "key", "length", 2, 7)
