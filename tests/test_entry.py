"""The entry's queries where parts of the library can't be imported."""

import sys

import __spark_entry__
from framewright import plans


def test_queries_without_the_training_data_part(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("framewright.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("framewright.llm", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)  # an import of it raises ImportError
    monkeypatch.delattr("framewright.llm", raising=False)
    assert set(__spark_entry__.queries()) == set(plans.queries())
    assert set(__spark_entry__.oracle_sql()) == set(plans.oracle_sql())
