"""Quality rules: hard limits on document statistics, then a monotonic forest over them.

The statistics of a document are counted over its whole text in tasks; the forest is fitted on a bounded sample
of labelled rows and sent to the tasks as flat arrays. More symbols, capitals, repeated lines or
repeated words never raise a document's score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.trees import Forest, fit_forest

#: Labelled rows that the forest is fitted on, about; chosen by a hash of their id.
SAMPLE_ROWS = 20_000
#: A document is kept from this probability of being good: clean documents score far above.
KEEP_AT = 0.35
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features of the forest and the direction in which each may move the score.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_a_word": -1, "dup_lines_a_line": -1, "repeats_a_word": -1, "capitals_a_letter": -1,
    "digits_a_char": 0, "marks_a_word": -1, "distinct_a_word": 0, "lines_a_word": 0, "points_a_word": 0,
}


def repeated_words(codes: np.ndarray, width: int = 5) -> int:
    """Words in windows of width that occur twice or more; codes: a number a word."""
    n = len(codes) - width + 1
    if n < 2:
        return 0
    window, distinct = codes[:n].astype(np.int64), int(codes.max()) + 1
    for k in range(1, width):
        if int(window.max()) * distinct >= 1 << 62:
            window = np.unique(window, return_inverse=True)[1].astype(np.int64)
        window = window * distinct + codes[k : k + n]
    order = np.sort(window)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    twice = np.isin(window, again)
    inside = np.zeros(n + width, np.int64)
    inside[:n] += twice
    inside[width:] -= twice
    return int((inside.cumsum() > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """BASE counts and FEATURES of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # on the six ASCII white space characters, no others
    n = len(words)
    blank = len(raw) - sum(map(len, words))
    seen: dict[bytes, int] = {}
    codes = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = len(text) - blank
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    marks = len(raw) - len(raw.translate(None, b"!?^~_=+{}[]\\/@"))
    points = len(raw) - len(raw.translate(None, b".,;:"))
    again, repeats = len(lines) - len(set(lines)), repeated_words(codes) if n else 0
    per = max(n, 1)
    return [n, letters, symbols, again, repeats], [
        np.log1p(n), letters / per, symbols / per, again / max(len(lines), 1), repeats / per, upper / max(upper + lower, 1),
        digits / max(letters, 1), marks / per, len(seen) / per, len(lines) / per, points / per,
    ]


def _per_row(docs: DataFrame, schema: str, columns) -> DataFrame:
    """mapInArrow with columns(texts): the columns that follow the ones of docs before text, which is last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                more = columns([x.as_py() or "" for x in texts.slice(at, 500)])
                names = [*batch.schema.names[:-1], *(x.split()[0] for x in schema.split(", ")[batch.num_columns - 1 :])]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *more], names=names)

    return docs.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, where=None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, label of about rows labelled documents: those with the lowest hashes. Two labels of an id count as their maximum, of two texts of an id the smaller is taken."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    marked = marked if where is None else marked.where(where)
    share = min(1.0, rows / max(marked.count(), 1))
    marked = marked.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) <= F.lit(min(2**63 - 1, int(share * 2**63)))).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    # about SAMPLE_ROWS narrow rows: a proven bound for the broadcast
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(marked), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def fit_quality(docs: DataFrame, labels: DataFrame) -> Forest:
    """A forest for labels.quality. Without labels of both kinds it accepts all."""
    sample = labelled_sample(docs, labels, "quality").select("doc_id", "label", "text")
    schema = "doc_id long, label double, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = _per_row(sample, schema, lambda texts: [pa.array(c, pa.float64()) for c in zip(*[statistics(t)[1] for t in texts])] if texts else [pa.array([], pa.float64())] * len(FEATURES))
    found = rows.toPandas().sort_values("doc_id")
    x, y = found[list(FEATURES)].to_numpy(), found["label"].to_numpy()
    forest = fit_forest(x, y, list(FEATURES.values()))
    if not len(forest.roots):
        forest.base = 10.0
    return forest


def judge(docs: DataFrame, forest: Forest, keep_at: float = KEEP_AT) -> DataFrame:
    """One row a row of docs: doc_id, BASE, base_failed, score, kept.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged alike. A very long text is counted whole. Other columns aren't read.
    """
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, score double, kept boolean"

    def columns(texts: list[str]) -> list:
        counts, features = zip(*[statistics(t) for t in texts]) if texts else ((), ())
        counts = np.array(counts, np.int64).reshape(-1, len(BASE))
        score = forest.score(np.array(features, np.float64).reshape(-1, len(FEATURES)))
        failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
        return [*(pa.array(c) for c in counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep_at))]

    return _per_row(docs.select(F.col("doc_id").cast("long"), "text"), schema, columns)


def kept_documents(docs: DataFrame, forest: Forest, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs that judge keeps, with their columns."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for at in range(0, batch.num_rows, 500):
                found = [statistics(x.as_py() or "") for x in texts.slice(at, 500)]
                counts, features = np.array([f[0] for f in found]), np.array([f[1] for f in found])
                good = (counts[:, 0] >= 10) & (100 * counts[:, 4] <= 20 * counts[:, 0]) & (forest.score(features) >= keep_at)
                yield batch.slice(at, 500).filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
