"""The quality classifier's parts against plain solvers, and odd tables."""

import numpy as np
import pyarrow as pa

from tidemill.llm import classifier


def problem(n=40, seed=0):
    r = np.random.default_rng(seed)
    y = (r.random(n) < 0.5).astype(int)
    rows = [np.unique(np.concatenate([r.integers(0, 30, 8), r.integers(30 + 10 * label, 45 + 10 * label, 3)])) for label in y]
    return rows, y


def test_log_count_ratio():
    rows, y = problem()
    ratio = classifier.log_count_ratio(rows, y)
    counts = [[1 + sum(f in row for row, label in zip(rows, y, strict=True) if label == c) for f in range(60)] for c in (0, 1)]
    totals = [sum(c) + classifier.FEATURES - 60 for c in counts]
    for f in range(60):
        assert np.isclose(ratio[f], np.log(counts[1][f] / totals[1]) - np.log(counts[0][f] / totals[0]))


def test_dual_descent_against_projected_gradient():
    """Both end at the same dual objective, which is the smallest there is."""
    for seed in range(3):
        rows, y = problem(seed=seed)
        ratio = classifier.log_count_ratio(rows, y)
        weights, bias = classifier.hinge_fit(rows, y, ratio, rounds=400)
        x = np.zeros((len(rows), 61))
        for i, row in enumerate(rows):
            x[i, row] = ratio[row] / np.sqrt((ratio[row] ** 2).sum())
        x[:, 60] = 1  # the bias is a feature like the others
        sign = np.where(y > 0, 1.0, -1.0)
        cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y == 0).sum()))
        primal = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - sign * (x @ w))).sum()
        q = (sign[:, None] * x) @ (sign[:, None] * x).T
        alpha = np.zeros(len(y))
        for _ in range(20_000):
            alpha = np.clip(alpha - 0.02 * (q @ alpha - 1), 0, cost)
        best = alpha.sum() - 0.5 * alpha @ q @ alpha
        assert np.isclose(primal(np.append(weights[:60], bias)), best, rtol=1e-2)


def test_logistic_against_a_grid():
    r = np.random.default_rng(2)
    y = (r.random(300) < 0.3).astype(int)
    margins = r.normal(size=300) + 1.5 * y
    a, b = classifier.logistic(margins, y)
    pos, neg = y.sum(), (1 - y).sum()
    target, each = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2)), np.where(y > 0, 0.5 / pos, 0.5 / neg)

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * margins + b)))
        return -(each * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum() + 0.5e-3 * (a - 1) ** 2

    assert loss(a, b) <= min(loss(a + da, b + db) for da in np.linspace(-0.5, 0.5, 21) for db in np.linspace(-0.5, 0.5, 21)) + 1e-9


def test_features_do_not_depend_on_the_batch():
    texts = ["one two two three", None, "", "é" * 9, "a b", "x" * 50_000, "WORD! " * 500]
    whole = list(classifier.features(pa.array(texts)))
    assert [f.tolist() for f in whole] == [next(classifier.features(pa.array([t]))).tolist() for t in texts] and not len(whole[1]) and not len(whole[2])


def test_odd_tables(spark):
    rows = [(i, f"good words of text {i}" if i % 2 else f"BAD!!! ### {i}", "en", 1) for i in range(60)]
    docs = spark.createDataFrame([*rows, (7, "good words", "en", 1), (7, "good words", "en", 1), (None, None, "de", 0), (99, "z" * 200_000, "en", 2)], "doc_id long, text string, lang string, quality int")
    labels = spark.createDataFrame([(i, i % 2, "x", 3) for i in range(60)] + [(3, 0, "x", 3), (4, 7, "x", 3), (None, 1, "x", 3)], "doc_id long, quality int, text string, score int")
    out = classifier.score_documents(docs, labels).collect()
    assert len(out) == 64 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    sevens = [r["score"] for r in out if r["doc_id"] == 7]
    assert len(sevens) == 3 and sorted(sevens)[0] > 0.3
    assert classifier.score_documents(docs.limit(0), labels).count() == 0
    assert classifier.score_documents(docs, labels.limit(0)).count() == 64
