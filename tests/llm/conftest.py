import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, shard string, run string"


@pytest.fixture
def table(spark):
    """A documents table from (doc_id, text, source) rows, with further columns whose names operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z", None) for i, t, s in rows], SCHEMA)

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty and long texts, repeated rows and ids, white space of all kinds."""
    long = " ".join(f"word{i % 700} other{i}" for i in range(9000))
    rows = [(0, None, None), (1, "", "a"), (2, "   \n\t ", "a"), (3, long, "b"), (4, "same text here", "a"), (5, "same text here", None)]
    rows += [(6, "same text here", "b"), (6, "same text here", "b"), (6, "another text", "b"), (None, "no id at all", "c"), (7, "é ü 漢字 \x0b x\fy", "c")]
    return rows + [(i, f"document {i} has its own words {i * 7} and ends\nhere {i % 5}.", f"s{i % 3}") for i in range(8, 60)]
