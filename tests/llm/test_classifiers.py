import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from seismark.llm import linear_text, quality_nbsvm, toxicity
from seismark.llm.linear_text import Sample, word_features
from tests.llm import cases

FOLDER = "/root/testdata/sf0.01"


def tables(spark):
    return (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))


@pytest.mark.parametrize(("f", "label", "least"), [(quality_nbsvm.quality_scores, "quality", 0.9), (toxicity.toxicity_scores, "toxic", 0.85)])
def test_held_out(spark, f, label, least):
    docs, labels = tables(spark)
    rows = f(docs, labels).join(labels, "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    own = rows[rows.held_out]
    assert ((own.predicted == own[label]).mean()) >= least and own.score.between(0, 1).all()


@pytest.mark.parametrize(("f", "cut"), [(quality_nbsvm.quality_scores, 0.7), (toxicity.toxicity_scores, 0.3)])
def test_cases(spark, f, cut):
    name = "quality" if cut == 0.7 else "toxic"
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 13)] + [(None, 1), (4, None), (5, 1)], f"doc_id long, {name} int")
    rows = f(cases.docs(spark), labels).collect()
    assert len(rows) == len(cases.ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in rows)
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(str(i) for i, _ in cases.ROWS)
    assert {r.score for r in f(cases.docs(spark), labels.limit(0)).collect()} == {0.5}
    assert f(cases.empty(spark), labels).count() == 0


def test_without_toxic(spark):
    docs, labels = tables(spark)
    kept = toxicity.without_toxic(docs, labels)
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, p in scores.items() if not p}


def sample(texts, labels):
    offsets, columns = [0], []
    for _, n, text, bucket in word_features(pa.array(texts)):
        columns.append(bucket)
        offsets += (offsets[-1] + np.searchsorted(text, np.arange(1, n + 1))).tolist()
    return Sample(np.arange(len(texts)), np.array(labels), np.array(offsets), np.concatenate(columns))


def biased(n=400, seed=1):
    """Insults make a text toxic; a group is named mostly in toxic ones."""
    rng = np.random.default_rng(seed)
    plain = [f"word{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(n):
        toxic = i % 2
        words = list(rng.choice(plain, 12)) + (["idiot"] if toxic and rng.random() < 0.7 else []) + (["muslims"] if rng.random() < (0.8 if toxic else 0.05) else [])
        texts.append(" ".join(words))
        labels.append(toxic)
    return sample(texts, labels)


def test_swaps_lower_the_bias():
    s = biased()
    neutral = sample([f"muslims word{i} word{i + 1} word{i + 2}" for i in range(50)] + [f"christians word{i} word{i + 1} word{i + 2}" for i in range(50)], [0] * 100)
    insult = sample(["you idiot word1 word2"], [1])
    gaps, scores = [], []
    for weight in (0.0, 50.0):
        m = toxicity.fit(s, weight=weight)
        p = m.probability(m.of(neutral))
        gaps.append(abs(p[:50].mean() - p[50:].mean()))
        scores.append(m.probability(m.of(insult))[0])
    assert gaps[1] < 0.3 * gaps[0] and scores[1] > 0.5


def test_toxicity_fit_reaches_the_least_loss():
    """At the query's own settings: the slope of the loss, written out over dense rows, is gone, and no step from there lowers it."""
    s = biased(200, 4)
    unseen = np.random.default_rng(7).random(len(s)) < 0.25
    learn = s.take(~unseen)
    pair, column, sign = toxicity.counterfactuals(learn, toxicity.IDENTITY_TERMS)
    used = np.unique(np.concatenate([learn.columns, column]))
    at = {c: i for i, c in enumerate(used.tolist())}
    x, swaps = np.zeros((len(learn), len(used))), np.zeros((pair.max() + 1, len(used)))
    for i in range(len(learn)):
        own = learn.columns[learn.offsets[i] : learn.offsets[i + 1]]
        x[i, [at[c] for c in own.tolist()]] = 1
    for k, c, v in zip(pair, column.tolist(), sign):
        swaps[k, at[c]] += v
    y = learn.labels
    size = np.abs(np.log((x[y == 1].sum(0) + 1) / (y.sum() + 2)) - np.log((x[y == 0].sum(0) + 1) / ((1 - y).sum() + 2)))
    x, swaps = x * size / np.sqrt(x.sum(1, keepdims=True)), swaps * size
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())

    def loss(w, b):
        m = x @ w + b
        return share @ np.log1p(np.exp(np.where(y == 1, -m, m))) + 5e-5 * w @ w + 5 * np.mean((swaps @ w) ** 2)

    def slope(w, b):
        e = (1 / (1 + np.exp(-(x @ w + b))) - y) * share
        return np.linalg.norm(np.append(x.T @ e + 1e-4 * w + 10 / len(swaps) * swaps.T @ (swaps @ w), e.sum()))

    m = toxicity.fit(s)
    live = size > 0
    w, b = np.where(live, m.weights[used] / np.where(live, size, 1), 0), m.bias
    assert slope(w, b) <= 1.01e-4 * slope(0 * w, 0.0)
    rng = np.random.default_rng(0)
    for _ in range(30):
        assert loss(w, b) <= loss(w + rng.normal(size=len(w)) * 1e-2, b + rng.normal() * 1e-2)


def test_swaps_are_of_one_kind():
    s = sample(["old muslims word", "word"], [1, 0])
    pair, column, sign = toxicity.counterfactuals(s, toxicity.IDENTITY_TERMS)
    assert len(set(pair.tolist())) == 6 and set(sign.tolist()) == {-1.0, 1.0} and len(column) == len(pair)


def test_dual_coordinate_descent():
    """The optimum's gradient is zero: w is the sum of its dual variables' rows, and no step lowers the loss."""
    s = biased(120, 3)
    values = np.ones(len(s.columns)) * 0.3
    w = quality_nbsvm.dual_coordinate_descent(s, values)
    sign, row = np.where(s.labels == 1, 1.0, -1.0), s.rows()
    share = np.array([(sign < 0).mean(), (sign > 0).mean()])[(sign > 0).astype(int)]

    def loss(v):
        margin = np.bincount(row, weights=v[s.columns] * values, minlength=len(s)) + v[-1]
        return 0.5 * v @ v + np.sum(0.5 / share * np.maximum(0, 1 - sign * margin) ** 2)

    rng, at = np.random.default_rng(0), np.unique(s.columns)
    for _ in range(30):
        step = np.zeros(len(w))
        step[at] = rng.normal(size=len(at)) * 1e-2
        assert loss(w) <= loss(w + step) + 1e-6


def test_platt():
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < linear_text.sigmoid(2 * x - 1)).astype(int)
    a, b = linear_text.platt(x, y)
    assert abs(a - 2) < 0.25 and abs(b + 1) < 0.2


def slow_words(text):
    """Words, and the beginnings of words, as a set of (kind, bytes)."""
    words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[A-Za-z]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))]
    return {(0, w) for w in words} | {(k, w[:k]) for w in words for k in (4, 5, 6) if len(w) >= k}


def test_word_features_by_loops():
    """The indicators of each text are those of its words: as many as there are distinct ones, the same for equal sets, and shared as words are."""
    texts = ["One two, ONE three-four!", "three four two one", "", None, "Größe 12345 größe", "x" * 3000, "four"]
    got = {}
    for first, n, text, bucket in word_features(pa.array(texts)):
        for t in range(n):
            got[first + t] = set(bucket[text == t].tolist())
    slow = [slow_words(t or "") for t in texts]
    for i, a in enumerate(slow):
        assert len(got[i]) == len(a)
        for j, b in enumerate(slow):
            assert len(got[i] & got[j]) == len(a & b)


def test_style_features_by_loops():
    """Words, pairs, shapes and repeats of a text, counted by loops."""
    texts = ["one two one two", "Big RED 12 big", "", "a a b", "one two"]
    got = {}
    for first, n, text, bucket in linear_text.style_features(pa.array(texts)):
        for t in range(n):
            got[first + t] = set(bucket[text == t].tolist())

    def slow(t):
        words = re.findall(r"[a-z0-9]+", t.lower())
        shapes = [(c[0], "".join("a" if x.islower() else "A" if x.isupper() else "0" if x.isdigit() else x for x in c)[-4:]) for c in t.split()]
        shapes = [("a" if f.islower() else "A" if f.isupper() else "0", s) for f, s in shapes]
        parts = [(0, w) for w in words] + [(1, p) for p in zip(words, words[1:])] + [(2, s) for s in shapes] + [(3, p) for p in zip(shapes, shapes[1:])] + [(4, p) for p in zip(shapes, shapes[1:], shapes[2:])]
        return set(parts) | {(5, g) for g in (1, 2) for a, b in zip(words, words[g:]) if a == b}

    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(got[i] & got[j]) == len(slow(a) & slow(b))


@pytest.mark.parametrize(("scores", "features", "module"), [(quality_nbsvm.quality_scores, linear_text.style_features, quality_nbsvm), (toxicity.toxicity_scores, word_features, toxicity)])
def test_scores_by_loops(spark, scores, features, module):
    """Every score is the model's sum over the text's features, text by text; the model is fitted on what a plain selection of rows gives."""
    name = "quality" if module is quality_nbsvm else "toxic"
    docs, labels = tables(spark)
    d, rows = docs.toPandas(), labels.toPandas()
    train = sorted(i for i in rows.doc_id if zlib.crc32(str(i).encode()) % 4 != 2)
    text, label = dict(zip(d.doc_id, d.text)), dict(zip(rows.doc_id, rows[name]))
    one = lambda t: np.unique(next(features(pa.array([t])))[3])
    lists = [one(text[i]) for i in train]
    model = module.fit(Sample(np.array(train), np.array([label[i] for i in train]), np.concatenate([[0], np.cumsum([len(x) for x in lists])]), np.concatenate(lists)))
    got = dict(scores(docs, labels).select("doc_id", "score").collect())
    for i in list(text)[:200]:
        at = one(text[i]) if text[i] else np.zeros(0, int)
        margin = sum(model.weights[k] for k in at) / (math.sqrt(max(1, len(at))) if model.scaled else 1) + model.bias
        assert abs(got[i] - 1 / (1 + math.exp(-max(-40, min(40, model.slope * margin + model.intercept))))) < 1e-9


def test_text_ids(spark):
    """Ids that are text."""
    docs = spark.createDataFrame([(f"d{i}", "good text here" if i % 2 else "bad bad words") for i in range(80)] + [(None, None)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2, i % 2) for i in range(80)], "doc_id string, quality int, toxic int")
    for f in (quality_nbsvm.quality_scores, toxicity.toxicity_scores):
        assert f(docs, labels).count() == 81


def test_fit_goes_on_to_its_tolerance():
    """At the query's own settings a tighter tolerance moves no weight by more than a little; too few passes are an error."""
    s = biased(200, 5)
    values = np.ones(len(s.columns)) * 0.3
    loose, tight = (quality_nbsvm.dual_coordinate_descent(s, values, **o) for o in ({}, {"tolerance": 1e-9}))
    assert np.abs(loose - tight).max() < 1e-2
    with pytest.raises(ValueError):
        quality_nbsvm.dual_coordinate_descent(s, values, tolerance=1e-9, passes=1)
