import random

import numpy as np
import pytest

from seismark.operators import confidence


def _rows(n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(8, 3), rng.choice((0.1, 0.2, 0.4)), rng.uniform(20, 300)
        y = int(rng.random() < 1 / (1 + np.exp(-(0.6 * (a - 8) - 6 * (b - 0.2) - 0.01 * (c - 150)))))
        rows.append((i, a, b, c, rng.randint(4, 7), y, i % 4))
    return rows


SCHEMA = "eventId long, a double, b double, c double, n long, y int, fold long"


def _newton(x, y, ridge):
    """The same optimum by Newton's steps over the whole matrix, on standardised features."""
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ beta))
        pen = 2 * ridge * np.concatenate([[0], np.ones(x.shape[1] - 1)])
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (y - p) - pen * beta)
    return beta


def test_equals_a_fit_of_the_whole_matrix(spark):
    rows = _rows()
    df = spark.createDataFrame([*rows, (900, None, 0.1, 5.0, 4, 1, 0), (901, 1.0, 0.1, 5.0, 4, None, 1)], SCHEMA)
    models = confidence.fit_logistic(df, ["a", "b", "c"], "y", "fold", 4)
    x, y, fold = np.array([r[1:4] for r in rows]), np.array([r[5] for r in rows]), np.array([r[6] for r in rows])
    z = np.column_stack([np.ones(len(x)), (x - x.mean(axis=0)) / x.std(axis=0)])
    want = np.zeros(len(x))
    for f in range(4):
        beta = _newton(z[fold != f], y[fold != f], 1e-3)
        want[fold == f] = 1 / (1 + np.exp(-z[fold == f] @ beta))
    got = {r.eventId: r.score for r in confidence.out_of_fold(df, models, "fold").collect()}
    assert got[900] is None and np.abs(np.array([got[i] for i in range(len(x))]) - want).max() < 1e-9


def test_separable_rows_have_an_optimum(spark):
    df = spark.createDataFrame([(i, float(i), 1.0, 1.0, 4, int(i >= 20), i % 2) for i in range(40)], SCHEMA)
    models = confidence.fit_logistic(df, ["a", "b"], "y", "fold", 2)
    assert all(m["weights"]["a"] > 0 and m["weights"]["b"] == pytest.approx(0.0) for m in models.values())
    with pytest.raises(ValueError):
        confidence.fit_logistic(df.where("y = 5"), ["a"], "y", "fold", 2)


@pytest.mark.parametrize("places", [1, 6])
def test_precision_and_auc_by_pairs(spark, places):
    rows = [(r[4], round(random.Random(r[0]).random(), places), r[5]) for r in _rows(300)]
    df = spark.createDataFrame(rows, "n long, s double, y int")
    up = [s for _, s, y in rows if y]
    want = np.mean([sum(s >= u for s in up) / sum(s >= u for _, s, _ in rows) for u in up])
    got = confidence.average_precision(df, "s", "y").first()
    assert (got.positives, got.averagePrecision) == (len(up), pytest.approx(want))
    pairs = [(a[1] > b[1]) + 0.5 * (a[1] == b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] and not b[2]]
    got = confidence.auc_at_equal(df, "s", "y", "n").first()
    assert (got.pairs, got.auc) == (len(pairs), pytest.approx(np.mean(pairs)))
    none = confidence.auc_at_equal(df.where("y = 1"), "s", "y", "n").first()
    assert (none.pairs, none.auc) == (0, None)


def test_score_problems(spark):
    scores = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 1.5), ("x", 3, 0.1), ("r", 4, float("nan")), ("r", 9, 0.2), ("r", 1, 0.5)], "runId string, eventId long, score double")
    events = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "eventId long")
    got = {tuple(r) for r in confidence.score_problems(scores, events, "r").collect()}
    assert got == {("two_scores", 1), ("no_unit_score", 2), ("other_run", 3), ("no_unit_score", 4), ("no_score", 5), ("no_event", 9)}
