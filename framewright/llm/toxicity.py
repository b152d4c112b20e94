"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon is learned from labelled training rows and from nothing else: word beginnings (and whole words) that are far more frequent in toxic
documents. Features are its densities, how near it stands to the second person, capitals, marks, and the rate of obfuscated words (digits or
symbols between letters), which are read again without the disguise.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.quality import _per_row, labelled_sample
from framewright.llm.trees import Forest, fit_forest, fit_isotonic

#: Labelled rows that the model is fitted on, about; chosen by a hash of their id.
SAMPLE_ROWS = 12_000
#: Entries of the lexicon at most, those with the most evidence; and the fewest toxic documents that show one.
LEXICON, SUPPORT = 600, 6
#: Lengths of word beginnings in the lexicon.
BEGINNINGS = (4, 5, 6, 7)
#: Second-person words of four languages.
SECOND_PERSON = "you your yours yourself ur u tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie tú usted ustedes ti tus su vosotros".split()
_SECOND = frozenset(SECOND_PERSON)
#: Signs that stand for letters.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
FEATURES = [
    "hits", "hits_a_word", "weight", "weight_a_word", "distinct_hits", "best", "near_second", "second_a_word",
    "disguised_a_word", "disguised_hits", "capitals_a_letter", "shouts_a_word", "asks_a_word", "stretched_a_word", "log_words",
]
#: More of these never lowers a score.
DIRECTIONS = [1 if f in ("hits", "weight", "disguised_hits", "near_second") else 0 for f in FEATURES]
_EDGE = re.compile(r"^\W+|\W+$")
_MIXED = re.compile(r"[^\W\d_][^\w\s'’-]+[^\W\d_]|[^\W\d_]\d+[^\W\d_]|[^\W\d_]\$|@[^\W\d_]")
_STRETCHED = re.compile(r"(\w)\1\1")


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5: 0 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


@dataclass
class Toxicity:
    lexicon: dict[str, float]
    forest: Forest
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts: list[str]) -> np.ndarray:
        raw = self.forest.raw(np.array(features(texts, self.lexicon)).reshape(-1, len(FEATURES)))
        at, p = self.knots
        smooth = 1 / (1 + np.exp(-raw))
        # interpolated steps, and a little of the forest's own order inside a step
        return np.clip(0.98 * np.interp(raw, at, p) + 0.02 * smooth, 0, 1) if len(at) else smooth


#: Most words whose facts a worker remembers.
_MOST = 400_000
_PLAIN = ".,;:!?|\"'()"


def _word_facts(word: str, lexicon: dict[str, float]) -> tuple[float, int, int, int]:
    """Weight in the lexicon, second person, disguised, stretched."""
    bare = word.strip(_PLAIN).lower()
    forms, mixed = [bare], 0
    if not bare.isalpha():
        bare = _EDGE.sub("", bare)
        mixed = int(bool(_MIXED.search(bare) or _MIXED.search(word)))
        forms = [bare] + ([re.sub(r"[^\w]", "", word.lower().translate(DISGUISE))] if mixed else [])
    weight = 0.0
    for f in forms:
        for entry in (f + "$", f[:4], f[:5], f[:6], f[:7]):
            if lexicon.get(entry, 0.0) > weight:
                weight = lexicon[entry]
    return weight, int(bare in _SECOND), mixed, int(bool(_STRETCHED.search(bare)))


class _Facts:
    """Facts of words under one lexicon: a number a word, and the rows that the numbers stand for."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.number, self.rows = lexicon, {}, {}

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        new = set(words).difference(self.number)
        if len(self.number) + len(new) > _MOST:
            self.number.clear()
            new = set(words)
        for w in new:
            self.number[w] = self.rows.setdefault(_word_facts(w, self.lexicon), len(self.rows))
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        return numbers, np.array(list(self.rows), np.float64).reshape(-1, 4)[numbers]


_facts: list[_Facts] = []


def features(texts: list[str], lexicon: dict[str, float]) -> list[list[float]]:
    if not _facts or _facts[0].lexicon != lexicon:
        _facts[:] = [_Facts(lexicon)]
    facts, out = _facts[0], []
    for text in texts:
        words = text.split()
        n = max(len(words), 1)
        numbers, found = facts.of(words)
        weight, second, mixed, stretched = found.T
        hit = weight > 0
        near = distinct = 0
        if hit.any():
            distinct = len({words[k] for k in np.flatnonzero(hit).tolist()})
            if second.any():
                sums = np.concatenate([[0], np.cumsum(second)])
                at = np.flatnonzero(hit)
                near = int((sums[np.minimum(at + 4, len(words))] > sums[np.maximum(at - 3, 0)]).sum())
        raw = text.encode("utf-8", "surrogatepass")
        upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        out.append([
            hit.sum(), hit.sum() / n, weight.sum(), weight.sum() / n, distinct, weight.max(initial=0), near, second.sum() / n,
            mixed.sum() / n, (hit & (mixed > 0)).sum(), upper / max(len(text), 1), text.count("!") / n, text.count("?") / n, stretched.sum() / n, np.log1p(len(words)),
        ])
    return out


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Entries with their log odds, from documents (text, label): each counts once a document; a whole word's entry ends with $."""
    toxic, clean = sample.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    if not toxic or not clean:
        return {}
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}]{3,}"), F.lit(0)))

    def beginnings(n: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.substring(w, 1, n))

    parts = [beginnings(n) for n in BEGINNINGS]
    entries = sample.select("label", F.explode(F.array_distinct(F.concat(*parts, F.transform(words, lambda w: F.concat(w, F.lit("$")))))).alias("entry"))
    counted = entries.groupBy("entry").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    best = counted.where(F.col("t") >= SUPPORT).withColumn("odds", odds).where("odds > 2").orderBy(F.desc(F.col("odds") * F.col("t")), "entry").limit(LEXICON)
    return {r.entry: r.odds for r in best.collect()}


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> Toxicity:
    """Fitted on labelled rows outside the held-out fifth: three of the other remainders for lexicon and trees, one for calibration."""
    fold = remainder(F.col("doc_id"))
    sample = labelled_sample(docs, labels, "toxic", where=fold != 0, rows=SAMPLE_ROWS).cache()
    lexicon = learn_lexicon(sample.where(fold != 1))
    rows = sample.select("doc_id", "label", fold.alias("fold"), "text")
    schema = "doc_id long, label double, fold long, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = _per_row(rows, schema, lambda texts: [pa.array(c) for c in np.array(features(texts, lexicon), np.float64).reshape(-1, len(FEATURES)).T])
    found = rows.toPandas().sort_values("doc_id")
    sample.unpersist()
    x, y, held = found[FEATURES].to_numpy(), found["label"].to_numpy(), found["fold"].to_numpy() == 1
    forest = fit_forest(x[~held], y[~held], DIRECTIONS)
    return Toxicity(lexicon, forest, fit_isotonic(forest.raw(x[held]), y[held]))


def score_documents(docs: DataFrame, model: Toxicity) -> DataFrame:
    """One row a row of docs: doc_id, held_out, score, predicted.

    A null text counts as empty and gets an empty text's score; equal texts get equal scores; a very long text is scored whole. A null id is not held out. Other columns aren't read.
    """

    def columns(texts: list[str]) -> list:
        score = model.score(texts) if texts else np.zeros(0)
        return [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    return _per_row(rows, "doc_id long, held_out boolean, score double, predicted int", columns)
