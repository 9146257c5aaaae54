import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F
from seismark.llm import queries
from seismark.llm import vector_search as vs
from seismark.llm.vector_search import top_k
from tests.conftest import TINY, canonical


def brute(rows, asks, k):
    """rows: (id, vector)."""
    whole = [(i, [int(math.floor(1024 * x)) if abs(x) < 2**52 else 1024 * int(x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(whole):
        if q is not None and asks(q):
            found = [(-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), i is None, i or 0, i) for b, (i, w) in enumerate(whole) if a != b and len(v) == len(w)]
            out += [(q, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=str)


def held(spark, rows, asks, k=3):
    df = spark.createDataFrame([(i, v, "x", "x", "x") for i, v in rows], "vec_id long, embedding array<double>, row string, shard string, score string")
    got = top_k(df, F.col("vec_id") % asks == 0, k=k).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, lambda i: i % asks == 0, k)
    return got


def test_matches_sql(spark, oracle):
    assert canonical(queries.op13_exact_top_k(spark, TINY).toPandas()) == oracle(queries.OP13)


@pytest.mark.parametrize("seed", [1, 2])
def test_small_shards_and_tiles(spark, monkeypatch, seed):
    """Many shards, leaves and tiles; lines of few values have many ties, and half of the vectors are one and the same."""
    monkeypatch.setattr(vs, "LEAF_ROWS", 4)
    monkeypatch.setattr(vs, "SHARD_ROWS", (30, 40))
    monkeypatch.setattr(vs, "TILE_ROWS", 3)
    monkeypatch.setattr(vs, "TILES_A_COPY", 2)
    rng = random.Random(seed)
    rows = [(i, [rng.choice((-0.5, 0.25, 1.0)) for _ in range(3)] if i % 2 else [0.5, 0.5, -0.25]) for i in range(200)] + [(0, [1.0, 1.0, 1.0]), (0, [1.0, 1.0, 1.0])]
    held(spark, rows, 10)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (4, [1.0, None]), (6, [nan, 1.0]), (8, [inf, 1.0]), (10, []), (12, []), (14, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (None, [5.0, 5.0]),
        (16, [-0.0001, 0.0001]), (16, [-0.0001, 0.0001]), (18, [1e300, -1e300]), (20, [1e12, 1e12]), (-2, [-1.5, 0.7]),
    ]
    got = held(spark, rows, 2)
    assert {r.query_id for r in got} == {0, 10, 12, 16, 18, 20, -2}
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 2 == 0).count() == 0


def test_bounds_prune():
    """On clustered points the search ends after few leaves, with the results of a full scan."""
    rng = np.random.default_rng(3)
    x = np.floor(1024 * (rng.normal(0, 1, (64, 4)).repeat(256, axis=0) + rng.normal(0, 0.01, (64 * 256, 4)))).astype(np.int64)
    tree = vs.build(np.arange(len(x)), np.arange(len(x)), x)
    q = x[5]
    bound = np.maximum(q, 0) @ tree["high"].T + np.minimum(q, 0) @ tree["low"].T
    looked = []

    class Seen(np.ndarray):
        def __getitem__(self, at):
            looked.append(at)
            return np.asarray(super().__getitem__(at))

    got = vs.search({**tree, "vectors": tree["vectors"].view(Seen)}, q, bound, 5, 10, (vs.LEAST, vs.NO_ID))
    scores = x @ q
    assert got == sorted(((int(s), i) for i, s in enumerate(scores) if i != 5), key=lambda r: (-r[0], r[1]))[:10]
    assert len(looked) <= 8 < len(tree["lower"]) / 8
