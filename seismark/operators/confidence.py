"""How much an event looks like a real association rather than a chance one: a logistic fit, scores out of fold, and their quality.

Each of Newton's steps is one aggregate of a few sums for every fold; rows never reach the driver.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seismark.functions.tables import materialised, ranked


def _margin(coefficients: list[float], z: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(float(c)) * x for c, x in zip(coefficients, z)])


def fit_logistic(rows: DataFrame, features: list[str], label: str, fold: str, k: int, *, ridge: float = 1e-3, tolerance: float = 1e-10, most: int = 60) -> dict[int, dict]:
    """For each fold 0..k-1 the model of the rows in all other folds: bias and weight of each feature.

    Features are brought to mean 0 and deviation 1 over all rows (labels have no part in that); ridge is half the penalty
    on the squares of those weights, so that separable rows have an optimum too.  Rows with a null feature, label or fold take no part.
    Steps go on until none changes a coefficient by more than `tolerance`; more than `most` are an error.
    """
    rows = materialised(rows.select(*(F.col(f).cast("double").alias(f) for f in features), F.col(label).cast("double").alias("_y"), F.col(fold).alias("_fold")).dropna())
    s = rows.agg(*(F.avg(f).alias(f"m_{i}") for i, f in enumerate(features)), *(F.stddev_pop(f).alias(f"s_{i}") for i, f in enumerate(features))).first()
    if s["m_0"] is None:
        raise ValueError("no whole rows to fit")
    mean, scale = ([s[f"m_{i}"] for i in range(len(features))], [s[f"s_{i}"] or 1.0 for i in range(len(features))])
    z = [F.lit(1.0), *((F.col(f) - m) / d for f, m, d in zip(features, mean, scale))]
    d = len(z)
    beta = np.zeros((k, d))
    for _ in range(most):
        sums = []
        for f in range(k):
            p = 1 / (1 + F.exp(-_margin(beta[f], z)))
            part = lambda v, f=f: F.coalesce(F.sum(F.when(F.col("_fold") != f, v)), F.lit(0.0))
            sums += [part((F.col("_y") - p) * x) for x in z]
            sums += [part(p * (1 - p) * z[a] * z[b]) for a in range(d) for b in range(a + 1)]
        got = np.array(rows.agg(*[v.alias(f"v{i}") for i, v in enumerate(sums)]).first(), float).reshape(k, -1)
        step = np.zeros_like(beta)
        for f in range(k):
            h = np.zeros((d, d))
            h[np.tril_indices(d)] = got[f, d:]
            h = h + np.tril(h, -1).T + 2 * ridge * np.diag([1e-12, *[1.0] * (d - 1)])
            step[f] = np.linalg.solve(h, got[f, :d] - 2 * ridge * np.concatenate([[0.0], beta[f, 1:]]))
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < tolerance:
            return {f: {"bias": float(beta[f, 0] - sum(w * m / c for w, m, c in zip(beta[f, 1:], mean, scale))), "weights": {n: float(w / c) for n, w, c in zip(features, beta[f, 1:], scale)}} for f in range(k)}
    raise ValueError(f"no optimum after {most} steps")


def out_of_fold(rows: DataFrame, models: dict[int, dict], fold: str) -> DataFrame:
    """rows with `score`, from the model that hasn't seen the row's fold; null where a feature or the fold is."""
    score = F.lit(None).cast("double")
    for f, m in models.items():
        margin = F.lit(m["bias"])
        for name, w in m["weights"].items():
            margin = margin + F.lit(w) * F.col(name)
        score = F.when(F.col(fold) == f, 1 / (1 + F.exp(-margin))).otherwise(score)
    return rows.withColumn("score", score)


def average_precision(rows: DataFrame, score: str, label: str) -> DataFrame:
    """(positives, averagePrecision): the mean over positives of the precision among all rows that score no less.

    Equal scores are one threshold.  Places come from range sorts of all rows and of the positives; null without positives.
    """
    r = rows.select(F.col(score).alias("_s"), F.col(label).cast("int").alias("_y")).dropna()
    all_, up = ranked(r, "_s", name="_k"), ranked(r.where("_y = 1"), "_s", name="_k")
    at = all_.groupBy("_s").agg(F.min("_k").alias("_first"))
    ups = up.groupBy("_s").agg(F.min("_k").alias("_up"), F.count(F.lit(1)).alias("_n"))
    total = r.agg(F.count(F.lit(1)).alias("_all"), F.sum("_y").alias("_ups"))
    joined = ups.join(at, "_s").join(F.broadcast(total))  # one row
    precision = (F.col("_ups") - F.col("_up") + 1) / (F.col("_all") - F.col("_first") + 1)
    return joined.agg(F.sum("_n").alias("positives"), (F.sum(F.col("_n") * precision) / F.sum("_n")).alias("averagePrecision"))


def auc_at_equal(rows: DataFrame, score: str, label: str, group: str) -> DataFrame:
    """(pairs, auc): how often the positive of a pair scores higher, over pairs of equal `group`; ties count half."""
    r = rows.select(F.col(group).alias("_g"), F.col(score).alias("_s"), F.col(label).cast("int").alias("_y")).dropna()
    ties = ranked(r, "_g", "_s", name="_k").groupBy("_g", "_s").agg(F.avg("_k").alias("_mean"), F.min("_k").alias("_least"), F.sum("_y").alias("_up"), F.count(F.lit(1)).alias("_n"))
    g = ties.groupBy("_g").agg(F.min("_least").alias("_base"), F.sum(F.col("_mean") * F.col("_up")).alias("_ranks"), F.sum("_up").alias("p"), (F.sum("_n") - F.sum("_up")).alias("q"))
    won = F.col("_ranks") - F.col("p") * (F.col("_base") - 1) - F.col("p") * (F.col("p") + 1) / 2
    pairs = F.sum(F.col("p") * F.col("q"))
    return g.agg(F.coalesce(pairs, F.lit(0)).cast("long").alias("pairs"), F.when(pairs > 0, F.sum(F.when(F.col("q") > 0, won).otherwise(0.0)) / pairs).alias("auc"))


def score_problems(scores: DataFrame, events: DataFrame, run: str) -> DataFrame:
    """(problem, eventId): scores (runId, eventId, score) that don't fit the run's events; no row where all is well."""
    bad = F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(0.0, 1.0)
    own = scores.select(F.explode(F.filter(F.array(F.when(~F.col("runId").eqNullSafe(F.lit(run)), "other_run"), F.when(bad, "no_unit_score")), lambda x: x.isNotNull())).alias("problem"), "eventId")
    ids = events.select("eventId").distinct()
    missing = ids.join(scores.select("eventId").distinct(), "eventId", "left_anti").select(F.lit("no_score").alias("problem"), "eventId")
    foreign = scores.select("eventId").distinct().join(ids, "eventId", "left_anti").select(F.lit("no_event").alias("problem"), "eventId")
    twice = scores.groupBy("eventId").count().where("count > 1").select(F.lit("two_scores").alias("problem"), "eventId")
    return own.unionByName(missing).unionByName(foreign).unionByName(twice)
