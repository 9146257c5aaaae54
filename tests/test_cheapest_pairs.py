"""The cheapest located event of each public one, without all pairs, against all pairs; what is shuffled before a join."""

import numpy as np
import pytest

from seismark.operators import joins


@pytest.mark.parametrize("n", [40, 4000])
def test_cheapest_pairs_equal_lowest_cost_of_all(spark, n, monkeypatch):
    """Sparse and dense tables, ties of cost, public events far from all others and without a time; dense ones make few pairs."""
    rng = np.random.default_rng(n)
    at = lambda m: [(i, float(t), float(e), float(k)) for i, t, e, k in zip(range(m), rng.integers(0, 20000, m), rng.integers(-100, 100, m) * 50, rng.integers(-100, 100, m) * 50)]
    located = spark.createDataFrame(at(n) + [(n + r[0], *r[1:]) for r in at(5)] + [(2 * n, None, 0.0, 0.0)], "eventId long, t double, e double, n double")
    public = spark.createDataFrame(at(60) + [(60, 9e6, 0.0, 0.0), (61, None, 0.0, 0.0), (62, 21500.0, 9000.0, 0.0)], "catalogId long, t double, e double, n double")
    want = joins.lowest_cost(joins.with_cost(joins.pair_offsets(located, public, 1800.0, 6000.0), 1800.0, 6000.0))
    seen = []
    whole = joins.lowest_cost
    monkeypatch.setattr(joins, "lowest_cost", lambda pairs: (seen.append(pairs.count()), whole(pairs))[1])
    got = joins.cheapest_pairs(located, public, 1800.0, 6000.0)
    key = lambda d: sorted((r.catalogId, r.eventId, round(r.dtS, 9), round(r.distM, 9), round(r.cost, 12)) for r in d.collect())
    assert key(got) == key(want)
    assert sum(seen) < 60 * 20
    assert joins.cheapest_pairs(located.limit(0), public, 1800.0, 6000.0).count() == joins.cheapest_pairs(located, public.limit(0), 1800.0, 6000.0).count() == 0
