import random
import re

import numpy as np
import pandas as pd
import pytest

from millrace.llm.boosting import BoostedTrees, Calibration
from millrace.llm.distributions import distributions
from millrace.llm.readability import FEATURES, band_of, corpus_profile, fit_reading_model, measured, reading_levels, train

DOC = "doc_id long, text string, source string, score string, band string"


def truth(text):
    words = re.findall(r"[^\W\d_]+", text or "")
    if len(words) < 10:
        return None
    n = sum(bool(re.search(r"[^\W\d_]", s)) for s in re.split(r"[.!?]+(?=\s|$)|\n", text))
    score = len(words) / n + 100 * sum(len(w) > 6 for w in words) / len(words)
    return "easy" if score < 30 else "middle" if score < 55 else "hard"


def corpus(n, seed=1):
    r = random.Random(seed)
    short, long = ["the", "cat", "sat", "on", "a", "mat", "größe", "ñandú"], ["institutional", "surveillance", "quantitative", "methodology"]
    out = []
    for k in range(n):
        share, size = r.random(), r.randint(3, 25)
        text = "".join(" ".join(r.choice(long if r.random() < share else short) for _ in range(size)) + r.choice([". ", "! ", "\n", "?! ", "... ", ".5 "]) for _ in range(r.randint(1, 20)))
        out.append((k, text, r.choice(["A", "b ", "c", None]), "clash", "clash"))
    return out


def test_bands_are_exact(spark):
    rows = corpus(400) + [(1000, None, "a", "", ""), (1001, "", "a", "", ""), (1002, "too few words here", "a", "", ""), (1003, "word " * 30_000, None, "", ""), (None, "w " * 50, "a", "", "")]
    df = spark.createDataFrame(rows + rows[:20], DOC)
    want = {r[0]: truth(r[1]) for r in rows if r[0] is not None and truth(r[1])}
    few = {r.doc_id: r.band for r in reading_levels(df, fit_reading_model(df, max_rows=200)).collect()}
    assert few.keys() == want.keys() and sum(few[k] != want[k] for k in want) <= 2
    model = fit_reading_model(df)
    got = {r.doc_id: r.band for r in reading_levels(df, model).collect()}
    assert got == want
    profile = corpus_profile(reading_levels(df, model)).collect()
    assert sum(r.n_docs for r in profile) == len(want)
    assert 0 <= np.average([r.by_model for r in profile], weights=[r.n_docs for r in profile]) <= 1


def test_held_out_accuracy_by_source(spark):
    df = spark.createDataFrame(corpus(600, 4), DOC)
    model = train(measured(df).where("words >= 10").toPandas())
    assert {f["source"] for f in model.folds} == {"", "a", "b", "c"}
    fresh = measured(spark.createDataFrame(corpus(300, 9), DOC)).where("words >= 10").toPandas()
    grade, clear = model.grade(fresh[FEATURES].to_numpy(float))
    error = grade - fresh["score"]
    assert np.sqrt((error**2).mean()) < 8 and abs(error.mean()) < 2
    right = band_of(grade) == band_of(fresh["score"])
    assert clear.mean() > 0.2 and right[clear].all() and right.mean() > 0.85


def test_counts_are_those_of_plain_python():
    texts = [r[1] for r in corpus(60, 3)] + [None, "", " \n ", "Één. Twee?! drie 3,5 (vier)\u2003vijf.zes", "x" * 1000, "a\x00b \U0001d4d0\U0001d4d1 c."]
    got = distributions(texts)
    for k, t in enumerate(texts):
        words = re.findall(r"[^\W\d_]+", t or "")
        parts = [s for s in re.split(r"[.!?]+(?=\s|$)|\n", t or "") if re.search(r"[^\W\d_]", s)]
        assert got["words"][k] == len(words) and got["sentences"][k] == len(parts)
        assert got["richness"][k] == pytest.approx(np.log1p(len({w.lower() for w in words})) / np.log1p(max(1, len(words))))
        sets = [{w.lower() for w in re.findall(r"[^\W\d_]+", s) if len(w) > 3} for s in parts]
        ties = [len(b & a) / len(b) if b else 0.0 for a, b in zip(sets, sets[1:])]
        assert got["overlap"][k] == pytest.approx(np.mean(ties) if ties else 0.0)
        lengths = sorted(len(re.findall(r"[^\W\d_]+", s)) for s in parts)
        assert got["sentence_median"][k] == (lengths[(len(lengths) - 1) // 2] if lengths else 0)
    together = distributions(texts * 3)
    assert all((together[n][: len(texts)] == got[n]).all() for n in got)


def test_trees_learn_and_calibration_is_monotone():
    r = np.random.default_rng(0)
    x = r.normal(size=(1500, 4))
    y = np.sin(2 * x[:, 0]) + (x[:, 1] > 0) * x[:, 2]
    trees = BoostedTrees(rounds=120).fit(x[:1000], y[:1000])
    assert ((trees.predict(x[1000:]) - y[1000:]) ** 2).mean() < 0.15 * y.var()
    c = Calibration.fit(trees.predict(x), y)
    assert (np.diff(c.apply(np.linspace(-3, 3, 200))) >= -1e-12).all()


def test_empty(spark):
    df = spark.createDataFrame([], DOC)
    model = fit_reading_model(df)
    assert reading_levels(df, model).count() == 0 and corpus_profile(reading_levels(df, model)).count() == 0
    assert isinstance(train(pd.DataFrame(columns=["source", "score", *FEATURES])).folds, list)
    nothing = spark.createDataFrame([(1, None, None, None, None), (2, " ", None, None, None)], DOC)
    assert reading_levels(nothing, fit_reading_model(nothing)).count() == 0
