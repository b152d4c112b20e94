"""Pipeline stages on documents with columns of the names that stages use inside."""

from framewright.llm.similar import without_similar
from framewright.llm.suffixes import without_repeats

SCHEMA = "doc_id long, text string, __number string, __id string, __text_is_null string, __text string, __row string, `number` int, `set` int"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e", k, -k) for k, (i, t) in enumerate(rows)], SCHEMA)


def test_near_duplicates_with_any_columns(spark):
    rows = [(1, "one two three four five six"), (1, "other words are here in this row"), (2, "one two three four five six"), (None, None), (None, "third text of its own words")]
    docs = rows_of(spark, rows)
    out = without_similar(docs)
    assert out.columns == docs.columns
    assert sorted(r.number for r in out.collect()) == [0, 1, 3, 4]
    assert all((r["__number"], r["__id"], r["__row"]) == ("a", "b", "e") for r in out.collect())


def test_repeats_with_any_columns(spark):
    long = "a passage of well over fifty bytes that stands in two documents and goes from one. "
    docs = rows_of(spark, [(1, long), (2, "before " + long), (3, None)])
    out = without_repeats(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: long, 2: "before ", 3: None}
    assert all((r["__text_is_null"], r["__text"]) == ("c", "d") for r in out.collect())
