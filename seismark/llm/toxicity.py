"""Toxicity by a counterfactual-regularised classifier.

A logistic model over indicators of words and their beginnings, each scaled by how much the log
odds of the classes differ with it, so that few labels suffice for rare insults.  Each labelled text that names a
group is set beside copies of itself in which the term is swapped for another of its kind, and the
squared change of the score is part of the loss: what tells toxic from not must not be who is named.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seismark.llm.linear_text import BUCKETS, LinearScore, Sample, labelled_sample, platt, scored, sigmoid, under, word_features

#: Labelled rows that the fit takes at most, on average: their features are all that the driver gathers.
SAMPLE_ROWS = 8000

#: Terms for groups of people, by kind; terms of one kind are swapped for each other.
IDENTITY_TERMS = {
    "gender": "women men girls boys female male woman man frauen männer mujeres hombres femmes hommes transgender".split(),
    "religion": "muslims christians jews hindus buddhists atheists muslim christian jewish hindu buddhist muslime christen juden musulmanes cristianos judíos musulmans chrétiens juifs".split(),
    "origin": "immigrants refugees foreigners americans germans french spaniards turks africans asians arabs mexicans chinese indians ausländer flüchtlinge extranjeros étrangers".split(),
    "orientation": "gay lesbian straight bisexual queer heterosexual homosexual schwul lesbisch".split(),
    "colour": "black white brown schwarze weiße negros blancos noirs blancs".split(),
    "age_ability": "elderly young old disabled blind deaf behinderte discapacitados handicapés".split(),
}


def _term_features(terms: list[str]) -> list[np.ndarray]:
    ((_, n, text, bucket),) = word_features(pa.array(terms))
    return [bucket[text == t] for t in range(n)]


def counterfactuals(sample: Sample, terms: dict[str, list[str]], *, swaps: int = 3, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Changes that swaps make: (pair, bucket, +1 or -1), for rows of the sample that name a group.

    A term is named if all features of it are in the row, and its swap takes them out and puts those
    of another term of its kind in.
    """
    rng = np.random.default_rng(seed)
    pairs, columns, signs, n = [], [], [], 0
    sets = {k: _term_features(kind) for k, kind in terms.items()}
    known = np.zeros(BUCKETS, bool)
    for features in sets.values():
        known[np.concatenate(features)] = True
    at = np.flatnonzero(known[sample.columns])
    named_column, named_row = sample.columns[at], np.searchsorted(sample.offsets, at, "right") - 1
    for features in sets.values():
        for t, own in enumerate(features):
            word = own[np.isin(own, np.concatenate([f for u, f in enumerate(features) if u != t] or [own[:0]]), invert=True)]
            if not len(word) or len(features) < 2:
                continue
            named = np.flatnonzero(np.bincount(named_row[np.isin(named_column, word)], minlength=len(sample)) == len(word))
            for i in named:
                have = sample.columns[sample.offsets[i] : sample.offsets[i + 1]]
                for other in rng.choice([u for u in range(len(features)) if u != t], min(swaps, len(features) - 1), replace=False):
                    out, into = np.setdiff1d(own, features[other]), np.setdiff1d(features[other], have)
                    pairs += [np.full(len(out) + len(into), n)]
                    columns += [out, into]
                    signs += [np.full(len(out), -1.0), np.full(len(into), 1.0)]
                    n += 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(pairs), np.concatenate(columns), np.concatenate(signs)


def least(loss, slope, curve, n: int, tolerance: float) -> np.ndarray:
    """Where a convex loss is least: Newton's steps from 0, each solved by conjugate gradients, until the gradient is tolerance times as long as at first.

    slope(z) is the gradient at z, and curve(z) gives the second derivatives' product with any vector.
    """
    z, value = np.zeros(n), loss(np.zeros(n))
    g = slope(z)
    first = size = np.linalg.norm(g)
    while size > tolerance * first:
        times, step, rest = curve(z), np.zeros(n), -g
        way, left = rest, rest @ rest
        goal = min(0.25, np.sqrt(size / first)) * size
        while np.sqrt(left) > goal:
            bent = times(way)
            far = left / (way @ bent)
            step, rest = step + far * way, rest - far * bent
            left, before = rest @ rest, left
            way = rest + left / before * way
        share, gain = 1.0, g @ step
        while (now := loss(z + share * step)) > value + 1e-4 * share * gain and share > 1e-8:
            share /= 2
        if now >= value:  # no step is seen to lower the loss: what is left is rounding
            break
        z, value = z + share * step, now
        g = slope(z)
        size = np.linalg.norm(g)
    return z


def fit(sample: Sample, *, terms: dict[str, list[str]] | None = None, weight: float = 5.0, l2: float = 1e-4, tolerance: float = 1e-4, seed: int = 7) -> LinearScore:
    """P(label = 1).  weight is what the mean squared change of the margin under swaps counts against the mean log loss.

    Newton's steps go on until the loss's gradient is tolerance times as long as at the start.  With one class only, or no rows, the model is constant.
    """
    if len(set(sample.labels.tolist())) < 2:
        share = (sample.labels.sum() + 1) / (len(sample) + 2)
        return LinearScore(np.zeros(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))))
    unseen = np.random.default_rng(seed).random(len(sample)) < 0.25
    if len(sample) < 40 or len(set(sample.labels[unseen].tolist())) < 2 or len(set(sample.labels[~unseen].tolist())) < 2:
        unseen = np.zeros(len(sample), bool)
    learn = sample.take(~unseen)
    pair, column, sign = counterfactuals(learn, IDENTITY_TERMS if terms is None else terms)
    n_pairs = int(pair.max()) + 1 if len(pair) else 0
    columns, labels, sizes = learn.columns, learn.labels, np.diff(learn.offsets)
    scale = 1 / np.sqrt(np.maximum(1, sizes))
    full = np.flatnonzero(sizes)

    def by_row(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(learn))
        if len(full):
            out[full] = np.add.reduceat(values, learn.offsets[:-1][full])
        return out

    def by_column(values: np.ndarray) -> np.ndarray:
        return np.bincount(columns, weights=np.repeat(values, sizes), minlength=BUCKETS)

    # Classes weigh alike.
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    up, down = by_column((labels == 1).astype(float)) + 1, by_column((labels == 0).astype(float)) + 1
    size = np.abs(np.log(up / (labels.sum() + 2)) - np.log(down / ((1 - labels).sum() + 2)))
    swapped = size[column] * sign

    def margins(z: np.ndarray) -> np.ndarray:
        return by_row((z[:-1] * size)[columns]) * scale + z[-1]

    def changes(z: np.ndarray) -> np.ndarray:
        return np.bincount(pair, weights=z[column] * swapped, minlength=n_pairs)

    def back(of_rows: np.ndarray, of_pairs: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Derivatives by z, from those by each row's margin and each swap's change."""
        g = by_column(of_rows * scale) * size + l2 * z[:-1]
        if n_pairs:
            g += np.bincount(column, weights=2 * weight / n_pairs * of_pairs[pair] * swapped, minlength=BUCKETS)
        return np.append(g, of_rows.sum())

    def loss(z: np.ndarray) -> float:
        m = margins(z)
        logs = np.logaddexp(0, m) - labels * m
        return float(share @ logs + l2 / 2 * (z[:-1] @ z[:-1]) + (weight * np.mean(changes(z) ** 2) if n_pairs else 0.0))

    def slope(z: np.ndarray) -> np.ndarray:
        return back((sigmoid(margins(z)) - labels) * share, changes(z), z)

    def curve(z: np.ndarray):
        p = sigmoid(margins(z))
        return lambda v: back(p * (1 - p) * share * margins(v), changes(v), v)

    z = least(loss, slope, curve, BUCKETS + 1, tolerance)
    w, b = z[:-1], z[-1]
    weights = w * size
    model = LinearScore(weights, float(b))
    check = sample.take(unseen) if unseen.any() else learn
    model.slope, model.intercept = platt(model.of(check), check.labels)
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, limit: int = SAMPLE_ROWS, terms: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each row of docs: its id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= threshold).

    Labels are learnt only from rows that aren't held out.  A null text counts as empty and has a
    score like any other.  Repeated rows give repeated results; a null id stays null and isn't held
    out; without labels every score is one half; an empty table gives an empty result.
    """
    model = fit(labelled_sample(docs, labels, word_features, label_col=label_col, limit=limit, id_col=id_col, text_col=text_col), terms=terms)
    return scored(docs, model, word_features, id_col=id_col, text_col=text_col, threshold=threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, limit: int = SAMPLE_ROWS, terms: dict[str, list[str]] | None = None) -> DataFrame:
    """The rows of docs that score under threshold, with the columns of docs; otherwise as toxicity_scores."""
    model = fit(labelled_sample(docs, labels, word_features, label_col=label_col, limit=limit, id_col=id_col, text_col=text_col), terms=terms)
    return under(docs, model, word_features, text_col=text_col, threshold=threshold)
