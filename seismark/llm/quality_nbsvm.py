"""Quality by naive Bayes support vectors.

N-gram indicators are scaled by the log ratio of their smoothed counts in both classes, and a
squared-hinge linear model is fitted on them by dual coordinate descent.  Margins become
probabilities on a part of the sample that the fit hasn't seen.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from seismark.llm.linear_text import BUCKETS, LinearScore, Sample, labelled_sample, platt, scored, style_features

#: Labelled rows that the fit takes at most, on average: their features are all that the driver gathers.
SAMPLE_ROWS = 8000


def log_count_ratios(sample: Sample, alpha: float = 1.0) -> np.ndarray:
    row = sample.rows()
    up = np.bincount(sample.columns, weights=(sample.labels[row] == 1), minlength=BUCKETS) + alpha
    down = np.bincount(sample.columns, weights=(sample.labels[row] == 0), minlength=BUCKETS) + alpha
    return np.log(up / up.sum()) - np.log(down / down.sum())


def dual_coordinate_descent(sample: Sample, values: np.ndarray, *, cost: float = 1.0, tolerance: float = 1e-3, passes: int = 1000, seed: int = 7) -> np.ndarray:
    """Weights, and at the end the bias, of an L2-regularised squared-hinge machine over rows of values at sample.columns.

    One dual variable is set to its optimum at a time, in a new random order each pass, until no step of a pass exceeds the
    tolerance; that takes some tens of passes, and without it after `passes` the fit is an error.
    """
    n, rng = len(sample), np.random.default_rng(seed)
    sign = np.where(sample.labels == 1, 1.0, -1.0)
    # Classes weigh alike.
    share = np.array([max(1, (sign < 0).sum()), max(1, (sign > 0).sum())]) / max(1, n)
    diagonal = 1 / (2 * cost / (2 * share[(sign > 0).astype(int)]))
    weights = np.zeros(BUCKETS + 1)
    rows = [(sample.columns[a:b], values[a:b]) for a, b in zip(sample.offsets[:-1], sample.offsets[1:])]
    square = np.array([v @ v + 1 for _, v in rows]) + diagonal
    alpha = np.zeros(n)
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(n):
            at, v = rows[i]
            gradient = sign[i] * (weights[at] @ v + weights[BUCKETS]) - 1 + diagonal[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / square[i])
            if (step := (new - alpha[i]) * sign[i]) != 0:
                weights[at] += step * v
                weights[BUCKETS] += step
                worst = max(worst, abs(step))
                alpha[i] = new
        if worst < tolerance:
            return weights
    raise ValueError(f"no optimum after {passes} passes")


def fit(sample: Sample, *, seed: int = 7) -> LinearScore:
    """A model of P(label = 1); with one class only, or no rows, a constant one."""
    if len(set(sample.labels.tolist())) < 2:
        share = (sample.labels.sum() + 1) / (len(sample) + 2)
        return LinearScore(np.zeros(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))))
    unseen = np.random.default_rng(seed).random(len(sample)) < 0.25
    if len(sample) < 40 or len(set(sample.labels[unseen].tolist())) < 2 or len(set(sample.labels[~unseen].tolist())) < 2:
        unseen = np.zeros(len(sample), bool)
    learn = sample.take(~unseen)
    ratios = log_count_ratios(learn)
    sizes = np.diff(learn.offsets)
    scale = 1 / np.sqrt(np.maximum(1, sizes))
    fitted = dual_coordinate_descent(learn, ratios[learn.columns] * np.repeat(scale, sizes), seed=seed)
    model = LinearScore(ratios * fitted[:BUCKETS], float(fitted[BUCKETS]))
    check = sample.take(unseen) if unseen.any() else learn
    model.slope, model.intercept = platt(model.of(check), check.labels)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, limit: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each row of docs: its id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= threshold).

    Labels are learnt only from rows that aren't held out.  A null text counts as empty and has a
    score like any other.  Repeated rows give repeated results; a null id stays null and isn't held
    out; without labels every score is one half; an empty table gives an empty result.
    """
    model = fit(labelled_sample(docs, labels, style_features, label_col=label_col, limit=limit, id_col=id_col, text_col=text_col))
    return scored(docs, model, style_features, id_col=id_col, text_col=text_col, threshold=threshold)
