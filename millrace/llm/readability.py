"""Problem 9: the reading level of each document, by boosted trees over text distributions.

The trees see distributions of length, vocabulary, syntax and cohesion. A document whose grade is
clear of the limits between bands gets its band from the model; near a limit, within the margin that
cross-validation by source calls for, the exact score settles it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, Calibration
from .common import strip
from .distributions import FEATURES, distributions

#: Most rows the model is fitted on, drawn by a hash of the id; training does not grow with the corpus.
MAX_TRAINING_ROWS = 6_000
MIN_WORDS = 10
EASY_BELOW, MIDDLE_BELOW = 30.0, 55.0
LIMITS = (EASY_BELOW, MIDDLE_BELOW)
#: The margin is so many times the furthest (in expected errors) that a held-out grade went wrong,
#: and more the fewer rows were held out: SAFETY x (1 + FEW / root of n).
SAFETY, FEW = 1.75, 20.0


def _rows(documents: DataFrame, text: str, ident: str, source: str) -> DataFrame:
    rows = documents.select(F.col(ident).alias("doc_id"), F.lower(strip(F.col(source))).alias("source"), F.col(text).alias("text"))
    return rows.where(F.col("doc_id").isNotNull())


def _measure(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    return distributions(b.column("text").to_pylist())


def measured(documents: DataFrame, text: str = "text", ident: str = "doc_id", source: str = "source") -> DataFrame:
    """``(doc_id, source, words, sentences, score, <features>)``, a row per row with an id.

    Whole texts are measured where they are read, a batch of characters at a time; the texts are
    never shuffled. Null and blank texts have 0 words and 0 everywhere.
    """
    rows = _rows(documents, text, ident, source)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["score", *FEATURES]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _measure(b)
                counts = [pa.array(m[c].astype(np.int64)) for c in ("words", "sentences")]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), *counts, *(pa.array(m[c].astype(float)) for c in names)], ["doc_id", "source", "words", "sentences", *names])

    return rows.mapInArrow(measure, f"doc_id {id_type}, source string, words long, sentences long, " + ", ".join(f"{c} double" for c in names))


def band_of(grade: np.ndarray) -> np.ndarray:
    return np.searchsorted(LIMITS, grade, side="right")


@dataclass
class ReadingModel:
    """Trees of the logarithm of the score, calibrated, and trees of how far they err.

    A grade is ``clear`` where its distance from every limit, measured in expected errors, is over
    ``margin``.
    """

    trees: BoostedTrees
    calibration: Calibration
    errors: BoostedTrees
    margin: float
    folds: list[dict] = field(default_factory=list)

    def log_grade(self, x: np.ndarray) -> np.ndarray:
        return self.calibration.apply(self.trees.predict(x))

    def distance(self, x: np.ndarray, log_grade: np.ndarray) -> np.ndarray:
        """From each grade to each limit, in expected errors."""
        return np.abs(log_grade[:, None] - np.log1p(LIMITS)) / np.exp(self.errors.predict(np.column_stack([x, log_grade])))[:, None]

    def grade(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Grades, and whether each is clear."""
        g = self.log_grade(x)
        return np.expm1(g), self.distance(x, g).min(1) > self.margin


def train(sample: pd.DataFrame, folds: int = 4, **trees: float) -> ReadingModel:
    """Fit on measured rows; cross-validate by source.

    Sources are dealt to folds by size. Each fold's sources are predicted by trees that never saw
    them; these predictions fit the calibration and the expected errors, give error and bias by
    source, and the margin, from the furthest that one of them lies beyond a limit.
    """
    x, y = sample[FEATURES].to_numpy(float), np.log1p(sample["score"].to_numpy(float))
    source = sample["source"].fillna("").to_numpy(object)
    names, sizes = np.unique(source.astype(str), return_counts=True)
    load, fold_of = np.zeros(folds), {}
    for k in np.argsort(-sizes, kind="stable"):
        fold_of[names[k]] = int(load.argmin())
        load[fold_of[names[k]]] += sizes[k]
    fold = np.array([fold_of[s] for s in source.astype(str)], int) if len(source) else np.zeros(0, int)
    held = np.zeros(len(y))
    for f in range(folds):
        test = fold == f
        if test.any() and not test.all():
            held[test] = BoostedTrees(**trees).fit(x[~test], y[~test]).predict(x[test])
        elif test.any():
            held[test] = BoostedTrees(**trees).fit(x, y).predict(x[test])
    calibration = Calibration.fit(held, y)
    guess = calibration.apply(held)
    errors = BoostedTrees(rounds=80, depth=3, rate=0.1).fit(np.column_stack([x, guess]), np.log(np.abs(guess - y) + 0.005))
    model = ReadingModel(BoostedTrees(**trees).fit(x, y), calibration, errors, 0.0)
    grade, score = np.expm1(guess), np.expm1(y)
    right = band_of(grade) == band_of(score)
    limits = np.array(LIMITS)
    between = (np.minimum(grade, score)[:, None] <= limits) & (limits <= np.maximum(grade, score)[:, None])
    missed = np.where(between & ~right[:, None], model.distance(x, guess), 0.0) if len(y) else np.zeros(1)
    model.margin = SAFETY * (1 + FEW / max(1, len(y)) ** 0.5) * max(1.0, float(missed.max()))
    error = grade - score
    model.folds = [
        {"source": s, "n": int(n), "rmse": float(np.sqrt((error[source == s] ** 2).mean())), "bias": float(error[source == s].mean()), "band_accuracy": float(right[source == s].mean()), "fold": fold_of[s]}
        for s, n in zip(names, sizes)
    ]
    return model


def fit_reading_model(documents: DataFrame, max_rows: int = MAX_TRAINING_ROWS, folds: int = 4, seed: int = 5) -> ReadingModel:
    """Train on at most ``max_rows`` documents, drawn by a hash of their ids before any text is
    measured. Empty input gives a model that grades 0."""
    total = documents.count()
    draw = F.xxhash64("doc_id", F.lit(seed))
    share = min(1.0, 1.1 * max_rows / max(total, 1))
    some = documents.where(draw <= int(-(2**63) + share * (2**64 - 1))) if share < 1 else documents
    sample = measured(some).withColumn("_d", draw).orderBy("_d", "doc_id").limit(max_rows).drop("_d").toPandas()
    return train(sample[sample["words"] >= MIN_WORDS], folds)


def reading_levels(documents: DataFrame, model: ReadingModel) -> DataFrame:
    """``(doc_id, source, words, sentences, grade, settled_by, band)``, one row per document.

    ``grade`` is the model's calibrated prediction. ``band`` is the model's where the grade is clear
    of the limits between bands (``settled_by`` = ``model``); near them the exact score decides
    (``check``). Of rows repeating an id the one with most words
    (then the greatest grade) counts. Documents of fewer than ten words, null and blank texts among
    them, and rows without an id are left out.
    """
    rows = _rows(documents, "text", "doc_id", "source")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = _measure(b)
            long = found["words"] >= MIN_WORDS
            if not long.any():
                continue
            grades, clear = m.grade(np.stack([found[c][long] for c in FEATURES], 1).astype(float))
            number = band_of(np.where(clear, grades, found["score"][long]))
            kept = b.filter(pa.array(long))
            yield pa.RecordBatch.from_arrays(
                [kept.column("doc_id"), kept.column("source"), pa.array(found["words"][long].astype(np.int64)), pa.array(found["sentences"][long].astype(np.int64)), pa.array(grades),
                 pa.array(np.where(clear, "model", "check")), pa.array(np.array(["easy", "middle", "hard"])[number])],
                ["doc_id", "source", "words", "sentences", "grade", "settled_by", "band"],
            )

    graded = rows.mapInArrow(grade, f"doc_id {id_type}, source string, words long, sentences long, grade double, settled_by string, band string")
    best = graded.groupBy("doc_id").agg(F.max(F.struct("words", "grade", "sentences", "settled_by", "band", "source")).alias("_b"))
    return best.select("doc_id", "_b.source", "_b.words", "_b.sentences", "_b.grade", "_b.settled_by", "_b.band")


def corpus_profile(levels: DataFrame) -> DataFrame:
    """Per source and band: documents, words, mean grade, and the share that the model settled."""
    own = F.avg(F.when(F.col("settled_by") == "model", 1.0).otherwise(0.0))
    return levels.groupBy("source", "band").agg(F.count("*").alias("n_docs"), F.sum("words").alias("n_words"), F.round(F.avg("grade"), 3).alias("mean_grade"), F.round(own, 4).alias("by_model"))
