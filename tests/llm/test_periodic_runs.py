import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from seismark.llm import periodic_runs as pr
from seismark.llm import queries, shared
from seismark.llm.periodic_runs import all_runs, periodic_runs
from tests.conftest import TINY
from tests.llm import cases


def brute(words):
    """All runs by comparing each word with the one a period on; of one stretch the smallest period."""
    w, out = np.unique(np.array(words, object), return_inverse=True)[1] if words else np.zeros(0), {}
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate([[False], w[:-q] == w[q:], [False]])
        if not same.any():
            continue
        edges = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edges[::2], edges[1::2] + q):
            if e - s >= max(6, 4 * q) and (s, e) not in out:
                out[int(s), int(e)] = q
    return sorted((s, e - s, q) for (s, e), q in out.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def changed(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_by_brute_force(spark):
    docs = {r.doc_id: changed(r.doc_id, words_of(r.text)) for r in shared.table(spark, TINY, "documents").collect()}
    rows = queries.op12_periodic_runs(spark, TINY).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        runs = brute(docs[r.doc_id])
        start, length, period = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        milli = None if period is None else 1000 * length // period
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), start, length, period, milli)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and r.collapsed_sha256 == sha(collapsed(docs[r.doc_id], runs))
    assert any(r.n_runs for r in rows) and any(not r.n_runs for r in rows)


def _random_text(rng):
    out = []
    while len(out) < rng.choice((5, 30, 120, 400)):
        block = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 12))]
        out += block * rng.choice((1, 1, 2, 4, 5, 9))
        if rng.random() < 0.2 and out:
            out = (out * 5)[:400]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_by_brute_force(seed, monkeypatch):
    """Many texts at once, of few letters and of nested repeats; small chunks change nothing."""
    rng = random.Random(seed)
    monkeypatch.setattr(pr, "CHUNK", rng.choice((1, 50, 1 << 19)))
    texts = [_random_text(rng) if rng.random() < 0.9 else [] for _ in range(150)]
    fib = ["a", "ab"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    texts += [list(fib[-1]), list("abcab" * 60), ["x"] * 257, list("ab" * 3 + "a" * 6)]
    codes = np.array([ord(c) for t in texts for c in t])
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    runs = all_runs(codes, bounds)
    for t, (first, last) in zip(texts, zip(bounds, bounds[1:])):
        own = runs[(runs[:, 0] >= first) & (runs[:, 0] < last)]
        assert [(s - first, e - s, q) for s, e, q in own.tolist()] == brute(t)


def test_wrong_fingerprints_are_noticed(monkeypatch):
    """With fingerprints of a tiny prime the first tries give wrong runs; the result is right all the same."""
    monkeypatch.setattr(pr.Fingerprints, "equal", _weak(pr.Fingerprints.equal))
    text = list("abcd" * 8 + "axyd" + "abcd" * 3 + "q" + "ef" * 9)
    codes = np.array([ord(c) for c in text])
    assert [(s, e - s, q) for s, e, q in all_runs(codes, np.array([0, len(codes)])).tolist()] == brute(text)


def _weak(equal):
    tries = []

    def of(self, i, j, length):
        if not any(t is self for t in tries):
            tries.append(self)
        return equal(self, i, j, np.maximum(1, length // 2) if tries[0] is self else length)

    return of


def test_large_texts():
    """One word a million times, and a random text repeated four times, in bounded time."""
    rng = np.random.default_rng(1)
    block = rng.integers(0, 5000, 50_000)
    codes = np.concatenate([np.zeros(1_000_000, np.int64), np.tile(block, 4), [7]])
    began = time.time()
    got = all_runs(codes, np.array([0, 1_000_000, 1_200_001])).tolist()
    assert [0, 1_000_000, 1] in got and [1_000_000, 1_200_000, 50_000] in got
    assert time.time() - began < 60


def test_cases(spark):
    rows = periodic_runs(cases.docs(spark)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in cases.ROWS)
    want = []
    for i, t in cases.ROWS:
        w = words_of(t)
        runs = brute(w) if len(w) < 1000 else [(0, len(w), 1)]
        want.append(repr((i, len(w), runs, collapsed(w, runs))))
    assert sorted(repr((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)) for r in rows) == sorted(want)
    assert periodic_runs(cases.empty(spark)).count() == 0
