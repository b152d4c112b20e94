"""Quality rules and toxicity: counts against plain Python, the held-out rows' accuracy, monotonic scores and odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from framewright.llm.quality import BASE, FEATURES, fit_quality, judge, kept_documents
from framewright.llm.toxicity import fit_toxicity, score_documents
from framewright.llm.trees import fit_forest, fit_isotonic
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def counts(text):
    """BASE of a text, by the definition."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)]


def ranking(scores, marks):
    """The chance that a marked row scores above another one; ties count half."""
    high, low = scores[marks == 1], scores[marks == 0]
    return float(((high[:, None] > low).sum() + 0.5 * (high[:, None] == low).sum()) / (len(high) * len(low)))


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_counts_are_those_of_plain_python(spark, table, odd_rows):
    again = "one two three four five six " * 3 + "\nsame line\nsame line\n \n# $ <b> & |"
    docs = table([*odd_rows, (100, again, "a"), (101, "a b c d e a b c d e", "a"), (102, "x\r\ny\r\nx\r\n", "b")])
    rows = judge(docs, fit_quality(docs, spark.createDataFrame([], LABELS))).collect()
    wanted = Counter((r.doc_id, *counts(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, *(r[c] for c in BASE)) for r in rows) == wanted
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed)  # without labels the forest accepts all


def test_kept_documents_are_those_that_judge_keeps(corpus):
    docs, labels = corpus
    forest = fit_quality(docs, labels)
    kept = kept_documents(docs, forest)
    assert kept.columns == docs.columns
    wanted = {r.doc_id for r in judge(docs, forest).where("kept").collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == wanted
    assert 0 < len(wanted) < docs.count()


def test_quality_of_held_out_rows(corpus):
    docs, labels = corpus
    forest = fit_quality(docs, labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    held = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 and quality is not null")
    rows = judge(docs, forest).join(held, "doc_id").select("score", "quality").toPandas()
    assert len(rows) > 50
    assert ranking(rows.score.to_numpy(), rows.quality.to_numpy()) > 0.8


def test_quality_is_monotonic_in_chosen_features(corpus):
    docs, labels = corpus
    forest = fit_quality(docs, labels)
    draw = np.random.default_rng(3)
    for at, way in enumerate(FEATURES.values()):
        if way:
            low = draw.uniform(0, 1, (400, len(FEATURES))) * np.array([8, 10, *[1] * (len(FEATURES) - 2)])
            high = low.copy()
            high[:, at] += draw.uniform(0, 1, 400)
            assert (way * (forest.raw(high) - forest.raw(low)) >= -1e-9).all()


def test_toxicity_of_held_out_rows(corpus):
    docs, labels = corpus
    rows = score_documents(docs, fit_toxicity(docs, labels))
    assert rows.count() == docs.count()
    found = rows.where("held_out").join(labels.where("toxic is not null"), "doc_id").select("score", "predicted", "toxic").toPandas()
    assert len(found) > 50
    score, toxic = found.score.to_numpy(), found.toxic.to_numpy()
    assert ((score >= 0) & (score <= 1)).all() and (found.predicted == (score >= 0.5)).all()
    assert ranking(score, toxic) > 0.9
    assert (found.predicted == toxic).mean() > max(toxic.mean(), 1 - toxic.mean())


def test_labels_of_held_out_rows_are_never_read(spark, corpus):
    docs, labels = corpus
    few = docs.where("doc_id < 3000")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = score_documents(few, fit_toxicity(few, labels)).orderBy("doc_id").collect()
    b = score_documents(few, fit_toxicity(few, turned)).orderBy("doc_id").collect()
    assert a == b
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in a)


def test_odd_rows_and_empty_tables(spark, table, odd_rows):
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(60)] + [(7, None, None), (None, 1, 1)], LABELS)
    docs, nothing = table(odd_rows), table([(1, "x", "a")]).where("doc_id < 0")
    rows = score_documents(docs, fit_toxicity(docs, labels)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _, _ in odd_rows)
    by_text = {}
    texts = {i: t or "" for i, t, _ in odd_rows if i not in (6, None)}
    for r in rows:
        if r.doc_id in texts:
            assert by_text.setdefault(texts[r.doc_id], r.score) == r.score
        if r.doc_id is None:
            assert r.held_out is False
    assert judge(docs, fit_quality(docs, labels)).count() == len(odd_rows)
    for found in (score_documents(nothing, fit_toxicity(nothing, labels)), judge(nothing, fit_quality(nothing, labels)), kept_documents(nothing, fit_quality(nothing, labels))):
        assert found.count() == 0


def test_forest_and_steps_on_made_up_rows():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(2000, 3))
    y = (x[:, 0] + 0.3 * draw.normal(size=2000) > 0).astype(float)
    forest = fit_forest(x[:1500], y[:1500], [1, 0, 0])
    assert ((forest.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.85
    at, p = fit_isotonic(forest.raw(x), y)
    assert (np.diff(p) >= 0).all() and (np.diff(at) >= 0).all()
