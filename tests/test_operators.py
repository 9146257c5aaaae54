"""Operators against brute force, closed forms and planted truth."""

import heapq
import itertools
import math
import os
import shutil
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seismark.functions.graphs import components
from seismark.functions.tables import ranked
from seismark.operators import association, diagnostics, geometry, intervals, iterative, joins, location, scenarios, signal, stats
from seismark.streaming.windows import LastGood, stream_counts

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LAYERS = location.Layers((2000.0, 1500.0, 800.0, -500.0), (2500.0, 3500.0, 4800.0, 5800.0), (1400.0, 2000.0, 2800.0, 3350.0))


def hungarian(cost):
    """Least complete assignment of a dense matrix with at most as many rows as columns, to test the sparse one."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            reduced = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            free = np.where(used[1:], np.inf, least[1:])
            j1 = int(np.argmin(free)) + 1
            step = free[j1 - 1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]


def best_assignment(frame):
    """(pairs, cost) of the best one-to-one set, by the dense method."""
    n, m = int(frame.catalogId.max()) + 1, int(frame.eventId.max()) + 1
    cost = np.full((n, m), 1e4)
    cost[frame.catalogId, frame.eventId] = frame.cost
    chosen = [cost[i, j] for i, j in hungarian(cost if n <= m else cost.T) for i, j in [(i, j) if n <= m else (j, i)]]
    return sum(c < 1e4 for c in chosen), sum(c for c in chosen if c < 1e4)


@pytest.mark.parametrize("density", [0.05, 0.1, 0.3])
def test_assignment_is_optimal(density):
    rng = np.random.default_rng(int(density * 100))
    for _ in range(20):
        n, m = rng.integers(3, 40, 2)
        at = np.argwhere(rng.random((n, m)) < density)
        if not len(at):
            continue
        pairs = pd.DataFrame({"catalogId": at[:, 0], "eventId": at[:, 1], "dtS": 0.0, "distM": 0.0, "cost": np.round(rng.random(len(at)), 3)})
        out = joins._assign(pairs)
        assert out.catalogId.is_unique and out.eventId.is_unique
        assert (len(out), out.cost.sum()) == pytest.approx(best_assignment(pairs))


def test_assignment_by_auction(spark):
    """One long component in several blocks, and small ones beside it: as good as the dense method."""
    rng = np.random.default_rng(2)
    a, b = np.sort(rng.uniform(0, 60, 30)), np.sort(rng.uniform(0, 60, 26))
    rows = [(i, j, float(b[j] - a[i]), 0.0, float(round(abs(b[j] - a[i]) / 5 + rng.random(), 2)), float(a[i])) for i in range(30) for j in range(26) if abs(b[j] - a[i]) < 5]
    rows += [(100, 200, 0.0, 0.0, 1.0, 5.0), (101, 200, 0.0, 0.0, 0.5, 5.0), (101, 201, 0.0, 0.0, 0.7, 5.0)]
    df = spark.createDataFrame(rows, "catalogId long, eventId long, dtS double, distM double, cost double, place double")
    want = best_assignment(pd.DataFrame(rows, columns=df.columns))
    assert (lambda out: (len(out), out.cost.sum()))(joins.assign_one_to_one(df).toPandas()) == pytest.approx(want)
    won = joins.auction(df, block_pairs=60, scale=100.0).toPandas().merge(pd.DataFrame(rows, columns=df.columns))
    assert won.catalogId.is_unique and won.eventId.is_unique and (len(won), won.cost.sum()) == pytest.approx(want)
    assert joins.auction(df.limit(0)).count() == 0


def test_auction_counts_every_digit(spark):
    """Costs that differ in the ninth place decide in blocks as they do in a task, also where all times are one."""
    rng = np.random.default_rng(5)
    rows = [(i, j, 0.0, 0.0, 0.5 + float(rng.integers(1, 90)) * 1e-9, 7.0) for i in range(6) for j in range(6) if abs(i - j) < 2]
    df = spark.createDataFrame(rows, "catalogId long, eventId long, dtS double, distM double, cost double, place double")
    local = joins.assign_one_to_one(df).toPandas()
    won = joins.auction(df, block_pairs=10).toPandas().merge(pd.DataFrame(rows, columns=df.columns))
    units = lambda t: int(np.rint(t.cost * 1e9).sum())
    assert won.catalogId.is_unique and won.eventId.is_unique and (len(won), units(won)) == (len(local), units(local))
    with pytest.raises(ValueError):
        joins.auction(df.withColumn("cost", F.lit(1e28)))


def test_band_join_is_complete(spark):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(-50, 50, 80).round(1), rng.uniform(-50, 50, 80).round(1)
    left = spark.createDataFrame([(float(x),) for x in a], "x double")
    right = spark.createDataFrame([(float(x),) for x in b], "y double")
    assert joins.band_join(left, right, "x", "y", 2.5).count() == sum(abs(x - y) <= 2.5 for x in a for y in b)


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (20, 19)] + [(i, i + 1) for i in range(100, 140)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got[3] == 1 and got[11] == 10 and got[20] == 19 and got[140] == 100


def test_ranked(spark):
    df = spark.range(1000).select((F.pmod(F.col("id") * 37, F.lit(101))).alias("k"), "id")
    rows = ranked(df.repartition(7), "k", "id", name="place").collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.place)] == [r.id for r in sorted(rows, key=lambda r: (r.k, r.id))] and {r.place for r in rows} == set(range(1, 1001))
    assert ranked(df.limit(0), "k", "id").count() == 0


def test_interval_algebra(spark):
    """Second by second on whole-number intervals."""
    rng = np.random.default_rng(2)
    make = lambda n: [(int(rng.integers(3)), float(s), float(s + rng.integers(1, 9))) for s in rng.integers(0, 60, n)]
    a, b = make(25), make(20)
    frame = lambda rows: spark.createDataFrame(rows, "k long, start double, stop double")
    cells = lambda rows: {(k, s) for k, x, y in rows for s in range(int(x), int(y))}
    got = lambda df: cells([(r.k, r.start, r.stop) for r in df.collect()])
    assert got(intervals.subtract(frame(a), frame(b), ["k"])) == cells(a) - cells(b)
    assert got(intervals.intersect(frame(a), frame(b), ["k"])) == cells(a) & cells(b)
    twice = {c for c in cells(a) if sum(k == c[0] and x <= c[1] < y for k, x, y in a) > 1}
    assert got(intervals.overlaps(frame(a), ["k"])) == twice
    holes = intervals.gaps(frame(a), ["k"], 0.0, 80.0).collect()
    assert cells([(r.k, r.gapStart, r.gapEnd) for r in holes]) == {(k, s) for k in {r[0] for r in a} for s in range(80)} - cells(a)
    assert [(r.k, r.start, r.stop) for r in intervals.tiles(spark, 5.0, 25.0, 10.0).collect()] == [(0, 5.0, 10.0), (1, 10.0, 20.0), (2, 20.0, 25.0)]


def test_travel_times():
    half = location.Layers((0.0, -1000.0), (2000.0, 4000.0), (1000.0, 2000.0))
    t = lambda r, a, b, layers=half, phase="P": float(location.first_arrival(layers, phase, np.array([r]), np.array([a]), np.array([b]))[0])
    assert t(1000, -500, 0) == pytest.approx(math.hypot(1000, 500) / 2000)
    assert t(0, -1500, 0) == pytest.approx(0.5 + 0.125)
    assert t(10_000, 0, 0) == pytest.approx(10_000 / 4000 + 2000 * math.sqrt(1 / 2000**2 - 1 / 4000**2))
    rng = np.random.default_rng(3)
    for _ in range(20):
        r, a, b = rng.uniform(0, 15_000), *rng.uniform(-4000, 1900, 2)
        assert t(r, a, b, LAYERS) == pytest.approx(t(r, b, a, LAYERS), rel=1e-9)
        assert t(r, a, b, LAYERS) <= t(r, a, b, LAYERS, "S") and t(r, a, b, LAYERS) <= math.hypot(r, a - b) / 2500 + 1e-9
    with pytest.raises(ValueError):
        t(1, 3000, 0, LAYERS)


def shortest_way(layers, phase, r, a, b, step=25.0):
    """First arrival over a net of points along every boundary, by Dijkstra's method."""
    v, tops = layers.speed(phase), list(layers.top)
    xs = np.arange(0, r + step / 2, step)
    points = [(0.0, a), (float(r), b)] + [(float(x), z) for z in tops[1:] for x in xs]
    inside = lambda p, q: [k for k in range(len(v)) if max(p[1], q[1]) <= tops[k] + 1e-9 and min(p[1], q[1]) >= (tops[k + 1] if k + 1 < len(v) else -1e9) - 1e-9]
    levels = {}
    for i, p in enumerate(points):
        levels.setdefault(p[1], []).append(i)
    best, done, heap = {0: 0.0}, set(), [(0.0, 0)]
    while heap:
        t, i = heapq.heappop(heap)
        if i == 1:
            return t
        if i in done:
            continue
        done.add(i)
        for z, own in levels.items():
            for k in inside(points[i], (0, z)):
                for j in own:
                    if j not in done and (z != points[i][1] or abs(points[i][0] - points[j][0]) <= step or j < 2 or i < 2):
                        d = t + math.hypot(points[i][0] - points[j][0], points[i][1] - z) / v[k]
                        if d < best.get(j, math.inf):
                            best[j] = d
                            heapq.heappush(heap, (d, j))
    return math.inf


@pytest.mark.parametrize("layers", [LAYERS, location.Layers((0.0, -500.0, -900.0, -2000.0), (3000.0, 2000.0, 4000.0, 3500.0), (1500.0, 1000.0, 2500.0, 2000.0))])
def test_travel_times_are_the_shortest(layers):
    """No way over a dense net is faster, and the best one is as fast but for the net's width; faster layers lie above and below."""
    rng = np.random.default_rng(11)
    for _ in range(8):
        r, (a, b) = float(rng.uniform(200, 5000)), layers.top[0] - rng.uniform(0, 3500, 2)
        t, net = float(location.first_arrival(layers, "P", r, a, b)[0]), shortest_way(layers, "P", r, float(a), float(b))
        assert t <= net + 1e-9 and net - t < 2e-3


def test_locator_finds_planted_events(spark):
    rng = np.random.default_rng(4)
    net = [(i, float(x), float(y), 1600.0) for i, (x, y) in enumerate(rng.uniform(-5000, 5000, (12, 2)))]
    truth, rows = {}, []
    for e in range(6):
        x, y, z, t0 = *rng.uniform(-2500, 2500, 2), rng.uniform(-1500, 0), 100.0 * e
        truth[e] = (x, y, z, t0)
        for s, sx, sy, elev in net:
            for phase, sigma in (("P", 0.01), ("S", 0.02)):
                tt = location.first_arrival(LAYERS, phase, np.array([math.hypot(x - sx, y - sy)]), np.array([z]), np.array([elev]))[0]
                rows.append((e, s, phase, float(t0 + tt + rng.normal(0, sigma) + (3.0 if s == 3 and phase == "P" else 0.0)), 0.9, sx, sy, elev))
    arrivals = spark.createDataFrame(rows, "eventId long, stationId long, phase string, t double, prob double, e double, n double, elevM double")
    v = location.Volume((-5000.0, 5000.0), (-5000.0, 5000.0), (-3000.0, 500.0), (1000.0, 250.0, 50.0))
    found = {r.eventId: r for r in location.locate_events(arrivals.repartition(5), LAYERS, v).collect()}
    for e, (x, y, z, t0) in truth.items():
        r = found[e]
        assert math.hypot(r.e - x, r.n - y) < 150 and abs(r.z - z) < 300 and abs(r.t - t0) < 0.1 and r.nPicks == 23


def merged_by_hand(p, within, share):
    events = {e: (set(g.pickId), g.eventT.iloc[0]) for e, g in p.groupby("eventId")}
    order = sorted(events, key=lambda e: (-len(events[e][0]), events[e][1], e))
    owner = {}
    for a in order:
        if a in owner:
            continue
        owner[a] = a
        for b in order:
            common = len(events[a][0] & events[b][0])
            if b not in owner and abs(events[a][1] - events[b][1]) <= within and common and common >= share * min(len(events[a][0]), len(events[b][0])):
                owner[b] = a
    return set(owner.values())


def test_merge_and_resolve(spark):
    rng = np.random.default_rng(5)
    rows = []
    for e in range(40):
        base = (e // 4) * 6
        for k in sorted(rng.choice(9, int(rng.integers(3, 8)), replace=False)):
            rows.append((e, float(e // 4 * 3 + rng.integers(3)), f"p{base + k}", int(base + k), "P" if k % 2 else "S", float(round(rng.normal(), 3))))
    p = pd.DataFrame(rows, columns=["eventId", "eventT", "pickId", "stationId", "phase", "residual"])
    p["eventT"] = p.groupby("eventId").eventT.transform("first")
    df = spark.createDataFrame(p)
    out = association.merge_duplicates(df, 2.0, 0.5).toPandas()
    assert set(out.eventId) == merged_by_hand(p, 2.0, 0.5) and not out.duplicated(["eventId", "stationId", "phase"]).any()
    least = {"nPicks": 3, "nP": 1}
    solved = association.resolve_with_minimums(df, least).toPandas()
    assert sorted(map(tuple, solved[["eventId", "pickId"]].values)) == sorted(resolved_by_hand(p, least))


def resolved_by_hand(p, least):
    """One event dropped at a time over all events, by plain loops."""
    held = {e: list(g.itertuples()) for e, g in p.groupby("eventId")}
    passes = lambda rows: len(rows) >= least["nPicks"] and len({r.stationId for r in rows if r.phase == "P"}) >= least["nP"]
    held = {e: rows for e, rows in held.items() if passes(rows)}
    while True:
        owner = {}
        for e, rows in held.items():
            for r in rows:
                key = (abs(r.residual), -len(rows), r.eventT, e)
                owner[r.pickId] = min(owner.get(r.pickId, key), key)
        own = {e: [r for r in rows if owner[r.pickId][3] == e] for e, rows in held.items()}
        bad = [(len(held[e]), -held[e][0].eventT, -e) for e in held if not passes(own[e])]
        if not bad:
            return [(e, r.pickId) for e, rows in own.items() for r in rows]
        del held[-min(bad)[2]]


def test_resolve_drops_in_order(spark):
    """Many small crowded worlds in one table, each with its own ids."""
    rng, rows = np.random.default_rng(13), []
    for world in range(60):
        for e in range(int(rng.integers(2, 6))):
            t = float(rng.integers(5))
            for k in sorted(rng.choice(8, int(rng.integers(2, 7)), replace=False)):
                rows.append((world * 10 + e, t, f"p{world}_{k}", world * 10 + int(k), "P" if k % 2 else "S", float(round(rng.normal(), 2))))
    p = pd.DataFrame(rows, columns=["eventId", "eventT", "pickId", "stationId", "phase", "residual"])
    least = {"nPicks": 3, "nP": 1}
    got = association.resolve_with_minimums(spark.createDataFrame(p), least).toPandas()
    assert sorted(map(tuple, got[["eventId", "pickId"]].values)) == sorted(resolved_by_hand(p, least))


def test_two_events_in_one_window(spark):
    """A lesser event close to a better one is found from the picks that are left."""
    times = [(0, s, "P", float(s)) for s in range(8)]
    picks = [(f"a{s}", s, "P", 100.0 + s, 0.9) for s in range(8)] + [(f"b{s}", s, "P", 130.0 + s, 0.9) for s in range(6)] + [(f"c{s}", s, "P", 3000.0 + s, 0.9) for s in range(2)]
    df = spark.createDataFrame(picks, "id string, stationId long, phase string, t double, prob double")
    tt = spark.createDataFrame(times, "node long, stationId long, phase string, seconds double")
    out = association.associate(df, tt, width=2.0, apart=500.0, tolerance=2.0, minimums={"nPicks": 4, "nStations": 4}, within=5.0, share=0.3).toPandas()
    assert sorted(tuple(sorted(g.pickId)) for _, g in out.groupby("eventId")) == [tuple(f"a{s}" for s in range(8)), tuple(f"b{s}" for s in range(6))]
    assert association.associate(df.limit(0), tt, width=2.0, apart=500.0, tolerance=2.0, minimums={"nPicks": 4, "nStations": 4}, within=5.0, share=0.3).count() == 0


def test_failing_slot_hides_no_event(spark):
    """Five stations in one slot, none of whose picks fit together, and four in a lesser slot near it that do."""
    picks = [(f"a{s}", s, "P", 100.0 + 4 * s, 0.9) for s in range(5)] + [(f"b{s}", s, "P", 130.0 + s / 10, 0.9) for s in range(4)]
    df = spark.createDataFrame(picks, "id string, stationId long, phase string, t double, prob double")
    tt = spark.createDataFrame([(0, s, "P", 0.0) for s in range(5)], "node long, stationId long, phase string, seconds double")
    out = association.associate(df, tt, width=10.0, apart=200.0, tolerance=2.0, minimums={"nPicks": 4, "nStations": 4}, within=5.0, share=0.3).toPandas()
    assert sorted(out.pickId) == ["b0", "b1", "b2", "b3"]


def test_scenarios_run_as_if_alone(spark):
    """Each scenario of one job against its own association; clocks that don't move change nothing, scrambled ones leave no event."""
    rng = np.random.default_rng(8)
    times = [(0, s, ph, s * k) for s in range(6) for ph, k in (("P", 1.0), ("S", 1.7))]
    picks = [(f"p{e}:{s}{ph}", s, ph, 1000.0 + 300 * e + tt, float(rng.choice([0.2, 0.9]))) for e in range(4) for _, s, ph, tt in times]
    df = spark.createDataFrame(picks, "id string, stationId long, phase string, t double, prob double")
    tt = spark.createDataFrame(times, "node long, stationId long, phase string, seconds double")
    least = {"nPicks": 4, "nStations": 3}
    options = {"width": 2.0, "apart": 100.0, "tolerance": 2.0, "within": 5.0, "share": 0.3}
    alone, sizes = {}, {}
    for k, prob in enumerate((0.0, 0.5)):
        rows = association.associate(df.where(F.col("prob") >= prob), tt, minimums=least, **options).toPandas()
        alone[k] = sorted((r.pickId, round(r.eventT, 4), round(r.residual, 4)) for r in rows.itertuples())
        sizes[k] = list(rows.groupby("eventId").stationId.nunique())
    both = df.withColumn("scenario", F.lit(0).cast("long")).unionByName(df.where("prob >= 0.5").withColumn("scenario", F.lit(1).cast("long")))
    rows = scenarios.associate_each(both, tt, minimums=least, **options).toPandas()
    for k, g in rows.groupby("scenario"):
        assert sorted((r.pickId, round(r.eventT, 4), round(r.residual, 4)) for r in g.itertuples()) == alone[k]
    still = scenarios.null_test(df, tt, reruns=2, seed=1, most=0.0, minimums=least, **options).toPandas()
    assert list(still.sort_values("scenario").picks) == [len(alone[0])] * 2
    assert scenarios.null_test(df, tt, reruns=2, seed=1, most=90.0, minimums={"nPicks": 8, "nStations": 6}, **options).toPandas().events.sum() == 0
    swept = {(r.minPickProb, r.minStations): r.candidates for r in scenarios.association_sweep(df, tt, probs=[0.0, 0.5], s_picks=[0], stations=[3, 6], minimums=least, **options).collect()}
    assert swept == {(prob, m): sum(n >= m for n in sizes[k]) for k, prob in enumerate((0.0, 0.5)) for m in (3, 6)}
    assert swept[0.0, 6] == 4


def test_associator_finds_planted_events(spark):
    rng = np.random.default_rng(6)
    net = [(i, *map(float, rng.uniform(-8000, 8000, 2))) for i in range(12)]
    nodes = [(j, x * 4000.0, y * 4000.0) for j, (x, y) in enumerate(itertools.product(range(-2, 3), repeat=2))]
    times = [(j, s, ph, math.hypot(x - sx, y - sy, 2000) / v) for j, x, y in nodes for s, sx, sy in net for ph, v in (("P", 5000.0), ("S", 2900.0))]
    picks, n = [], 0
    for e in range(10):
        j = int(rng.integers(25))
        for _, s, ph, tt in [t for t in times if t[0] == j]:
            picks.append((f"p{n}", s, ph, 1000.0 + 200 * e + tt + float(rng.normal(0, 0.05)), 0.9, e))
            n += 1
    for _ in range(60):
        picks.append((f"p{n}", int(rng.integers(12)), "P", float(rng.uniform(900, 3200)), 0.3, -1))
        n += 1
    owner = {p[0]: p[5] for p in picks}
    df = spark.createDataFrame([p[:5] for p in picks], "id string, stationId long, phase string, t double, prob double")
    tt = spark.createDataFrame(times, "node long, stationId long, phase string, seconds double")
    out = association.associate(df, tt, width=2.0, apart=100.0, tolerance=2.0, minimums={"nPicks": 12, "nStations": 8}, within=5.0, share=0.3).toPandas()
    found = [g.pickId.map(owner).mode().iloc[0] for _, g in out.groupby("eventId")]
    assert sorted(found) == list(range(10))


def test_statistics(spark):
    rng = np.random.default_rng(7)
    mags = np.round(0.5 + rng.exponential(1 / (1.0 * math.log(10)), 4000), 1)
    df = spark.createDataFrame([(float(m), 0.6) for m in mags], "m double, mc double")
    (r,) = stats.b_value(df, [], "m", "mc", 0.1).collect()
    assert abs(r.b - 1.0) < 0.1
    az = rng.uniform(0, 360, 300)
    rows = [(float(a), float(0.3 + 0.2 * math.cos(math.radians(a)) - 0.1 * math.sin(math.radians(a)))) for a in az]
    (f,) = stats.azimuth_fit(spark.createDataFrame(rows, "az double, r double"), [], "r", "az").collect()
    assert (f.a, f.b, f.c) == pytest.approx((0.3, 0.2, -0.1))
    obs = [(int(e), int(s), 0.0, 0.0, 0.0) for e in range(60) for s in range(6)]
    term = {s: 0.1 * (s - 2.5) for s in range(6)}
    obs = [(e, s, float(la), float(lr), float(la + 1.2 * lr + 0.4 + term[s] + (5 if rng.random() < 0.02 else 0))) for e, s, *_ in obs for la, lr in [rng.uniform(0, 3, 2)]]
    line, terms = stats.fit_calibration(spark.createDataFrame(obs, "eventId long, stationId long, logA double, logR double, mag double"))
    assert abs(line["b"] - 1.2) < 0.05 and all(abs(terms[s] - term[s]) < 0.1 for s in range(6))


def test_median_polish_and_folds(spark):
    rng = np.random.default_rng(8)
    term, shift = {s: s * 0.1 - 0.2 for s in range(5)}, rng.uniform(-3, 3, 40)
    rows = [(e, s, "P", float(shift[e] + term[s] + rng.normal(0, 0.005)), 1) for e in range(40) for s in range(5)]
    df = spark.createDataFrame(rows, "eventId long, stationId long, phase string, d double, w int")
    out = {r.stationId: r.term for r in iterative.median_polish(df, rounds=3, cap=1.0, least=5).collect()}
    assert all(abs((out[s] - out[2]) - (term[s] - term[2])) < 0.02 for s in range(5))


def test_coordinate_search():
    calls = []
    grid = [[0, 1, 2, 3], [0, 1, 2]]
    best, known = iterative.coordinate_search(grid, [0, 0], lambda p: calls.append(p) or -((p[0] - 2) ** 2) - (p[1] - 1) ** 2, 5)
    assert best == (2, 1) and len(calls) == len(set(calls)) == len(known)
    assert iterative.coordinate_search(grid, [1, 1], lambda p: 0, 5)[0] == (1, 1)


def test_projection(spark):
    df = spark.createDataFrame([(38.5, -112.9), (0.5, -110.0), (60.0, -109.0)], "lat double, lon double")
    e, n = geometry.utm(F.col("lat"), F.col("lon"), 12)
    lat, lon = geometry.geographic(F.col("e"), F.col("n"), 12)
    for r in df.withColumn("e", e).withColumn("n", n).withColumn("lat2", lat).withColumn("lon2", lon).collect():
        assert r.lat2 == pytest.approx(r.lat, abs=1e-8) and r.lon2 == pytest.approx(r.lon, abs=1e-8)
    (r,) = spark.createDataFrame([(0.0, -111.0)], "lat double, lon double").select(geometry.utm(F.col("lat"), F.col("lon"), 12)[0].alias("e")).collect()
    assert r.e == pytest.approx(500_000)


def test_well_path(spark):
    rows = [("v", 100.0 * i, 0.0, 0.0) for i in range(5)] + [("h", 100.0 * i, 90.0, 90.0) for i in range(5)]
    out = geometry.minimum_curvature(spark.createDataFrame(rows, "well string, md double, inc double, azi double"), "well").collect()
    last = {r.well: r for r in out if r.md == 400.0}
    assert last["v"].tvd == pytest.approx(400) and last["h"].east == pytest.approx(400) and last["h"].tvd == pytest.approx(0, abs=1e-9)


def test_signal(spark):
    rate, t = 100.0, np.arange(1000) / 100.0
    x = np.sin(2 * np.pi * 8 * t) + np.sin(2 * np.pi * 40 * t) + 5 + 0.3 * t
    y = signal.bandpassed(signal.tapered(signal.detrended(x)), rate, 4.0, 16.0)
    assert np.corrcoef(y[100:-100], np.sin(2 * np.pi * 8 * t)[100:-100])[0, 1] > 0.99
    burst = np.concatenate([np.full(200, 0.1), np.full(50, 2.0), np.full(200, 0.1)])
    seg = spark.createDataFrame([(1, burst.tolist()), (2, [])], "segmentId long, samples array<double>")
    rows = signal.triggers(signal.characteristic_function(seg, 5, 50), 3.0, 1.0).collect()
    assert [(r.segmentId, r.begin) for r in rows] == [(1, 200)] and rows[0].end > 210
    env = signal.look_ahead_envelope(burst, 5, 20)
    assert env[196] > env[190] and env.max() <= 2.0


def test_stream_counts(spark, tmp_path):
    """The stream's final windows are those of the batch."""
    src = str(tmp_path / "in")
    rows = [(i, "P" if i % 3 else "S", 1704067200 + i * 97) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, phase string, s long").select("id", "phase", F.timestamp_seconds("s").alias("time"))
    df.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = stream_counts(stream, "time", "7200 seconds", "600 seconds", "1 hour").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start, r.phase): r.n for r in spark.table("counts").collect()}
    want = {(r.start, r.phase): r.n for r in df.groupBy(F.window("time", "7200 seconds", "600 seconds").alias("w"), "phase").agg(F.count("*").alias("n")).select("w.start", "phase", "n").collect()}
    assert got == want and got


def test_last_good(spark):
    clock = iter(range(1000))

    def run(df):
        if df.where("id = 13").count():
            raise ValueError("bad window")
        return df

    live = LastGood(run, 2, 100, lambda: next(clock))
    live.process(spark.range(5), 0)
    live.process(spark.range(20), 1)
    assert live.served.count() == 5 and [a["outcome"] for a in live.attempts] == ["ok", "failed"]
    live.process(spark.range(3), 2)
    assert live.served.count() == 3 and len(live.attempts) == 2 and not live.stale(50)


def test_without_the_corpus_subpackage(tmp_path):
    """The entry module and its queries don't need it."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(n.startswith('op') for n in q); assert e.oracle_sql().keys() <= q.keys()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr


def test_nearest_stations_by_loops(spark):
    """Clusters, ties, equal places and far events; k beyond the network."""
    rng = np.random.default_rng(21)
    net = [(i, *map(float, rng.normal(0, 50, 2).round())) for i in range(40)] + [(40 + i, *map(float, rng.uniform(-9000, 9000, 2))) for i in range(20)] + [(60, 5.0, 5.0), (61, 5.0, 5.0)]
    events = [(i, *map(float, rng.uniform(-9000, 9000, 2))) for i in range(60)] + [(60, 5.0, 5.0), (61, 90_000.0, -3.0)]
    s, e = spark.createDataFrame(net, "stationId long, e double, n double"), spark.createDataFrame(events, "eventId long, e double, n double")
    for k in (1, 5, 100):
        got = {}
        for r in joins.nearest_station(e, s, k).collect():
            got.setdefault(r.eventId, []).append((r.place, r.stationId))
        for i, x, y in events:
            want = [j for _, j in sorted((math.hypot(x - a, y - b), j) for j, a, b in net)][:k]
            assert [j for _, j in sorted(got[i])] == want
    assert joins.nearest_station(e, s.limit(0), 2).count() == 0 == joins.nearest_station(e.limit(0), s, 2).count()


def test_quantiles(spark):
    rng = np.random.default_rng(22)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 400), rng.normal(size=400).round(1))] + [(1, None), (9, None), (8, 4.0)]
    got = {(r.k, r.q): r.value for r in stats.quantiles(spark.createDataFrame(rows, "k long, v double"), ["k"], "v", [0.0, 0.1, 0.5, 1.0]).collect()}
    for k in (0, 1, 2, 8):
        for q in (0.0, 0.1, 0.5, 1.0):
            assert got[k, q] == pytest.approx(np.quantile([v for i, v in rows if i == k and v is not None], q))
    assert not [1 for k, _ in got if k == 9]


def test_sta_lta_by_loops():
    rng = np.random.default_rng(23)
    rows = [rng.normal(size=n) for n in (50, 0, 7, 50, 120)]
    for x, got in zip(rows, signal._sta_lta(rows, 4, 16)):
        sta, lta, want = 0.0, 1e-99, []
        for i, v in enumerate(x):
            sta, lta = v * v / 4 + 0.75 * sta, v * v / 16 + 15 / 16 * lta
            want.append(sta / lta if i >= 16 else 0.0)
        assert np.allclose(got, want)


def test_intervals_across_days(spark, monkeypatch):
    """The same pieces however short the stretches are that running values are carried over."""
    rng = np.random.default_rng(24)
    a = [(int(rng.integers(2)), float(s), float(s + rng.choice([0, 1, 5, 40]))) for s in rng.integers(-30, 90, 60)]
    df = spark.createDataFrame(a, "k long, start double, stop double")
    every = lambda: [sorted(map(tuple, x.collect())) for x in (intervals.merged(df, ["k"]), intervals.gaps(df, ["k"], -40.0, 140.0), intervals.levels(df, ["k"]))]
    whole = every()
    monkeypatch.setattr(intervals, "STRETCH", 7.0)
    assert every() == whole and whole[0]


def test_statics_are_found(spark):
    """Terms planted at two stations come back, and events move to where they were."""
    rng = np.random.default_rng(25)
    net = [(i, float(x), float(y), 1600.0) for i, (x, y) in enumerate(rng.uniform(-5000, 5000, (12, 2)))]
    late, rows, truth = {3: 0.15, 7: -0.1}, [], {}
    for e in range(12):
        x, y, z = *rng.uniform(-2000, 2000, 2), rng.uniform(-1500, 0)
        truth[e] = (x, y)
        for s, sx, sy, elev in net:
            tt = float(location.first_arrival(LAYERS, "P", math.hypot(x - sx, y - sy), z, elev)[0])
            rows.append((e, s, "P", 100.0 * e + tt + late.get(s, 0.0), 0.9, sx, sy, elev))
    arrivals = spark.createDataFrame(rows, "eventId long, stationId long, phase string, t double, prob double, e double, n double, elevM double")
    v = location.Volume((-4000.0, 4000.0), (-4000.0, 4000.0), (-2500.0, 500.0), (1000.0, 250.0, 50.0), outlier_floor=1.0)
    terms, found = iterative.self_consistent_statics(arrivals, LAYERS, v, rounds=4, tolerance=0.02)
    got = {r.stationId: r.term for r in terms.collect()}
    assert all(abs(got[s] - late.get(s, 0.0)) < 0.05 for s in got)
    assert np.median([math.hypot(r.e - truth[r.eventId][0], r.n - truth[r.eventId][1]) for r in found.collect()]) < 150
    public = spark.createDataFrame([(e, 100.0 * e, float(x), float(y)) for e, (x, y) in truth.items() if e < 8], "catalogId long, t double, e double, n double")
    again, matches, _ = iterative.two_passes(arrivals, public, LAYERS, v, max_dt=1.0, max_dist=1000.0, rounds=1)
    assert {r.catalogId: r.eventId for r in matches.collect()} == {e: e for e in range(8)} and again.count() == 12


def test_flood_finds_the_region_around_the_best_node():
    rng = np.random.default_rng(11)
    for cutoff in (0.5, 2.0, 6.0):
        shape = np.array([9, 8, 7])
        field = sum(rng.uniform(0.2, 1) * np.abs(g - c) for g, c in zip(np.indices(shape), (4, 3, 5))) + rng.uniform(0, 2, shape)
        start = np.array(np.unravel_index(int(np.argmin(field)), shape))
        looked = []
        at, misfit, cut = location.flooded(start, shape, lambda k: looked.append(len(k)) or field[tuple(k.T)], location.Region(cutoff=cutoff))
        inside = {tuple(k) for k in np.argwhere(field - field.min() <= cutoff)}
        want, todo = {tuple(start)}, [tuple(start)]
        while todo:
            k = todo.pop()
            for step in np.vstack([np.eye(3, dtype=int), -np.eye(3, dtype=int)]):
                other = tuple(np.array(k) + step)
                if other in inside - want:
                    want.add(other)
                    todo.append(other)
        assert {tuple(k) for k in at} == want and not cut and np.allclose(misfit, field[tuple(at.T)])
        assert sum(looked) <= field.size
    # A better node that the flood meets lowers the level, and a small budget cuts it short.
    line = np.array([5.0, 4.0, 3.0, 2.0, 1.0, 0.0]).reshape(6, 1, 1)
    at, _, cut = location.flooded(np.array([0, 0, 0]), np.array(line.shape), lambda k: line[tuple(k.T)], location.Region(cutoff=1.5))
    assert {int(k[0]) for k in at} == {4, 5} and not cut
    assert location.flooded(np.array([0, 0, 0]), np.array(line.shape), lambda k: line[tuple(k.T)], location.Region(budget=3))[2]


def planted_arrivals(spark, places):
    rng = np.random.default_rng(12)
    net = [(i, float(x), float(y), 1600.0) for i, (x, y) in enumerate(rng.uniform(-5000, 5000, (10, 2)))]
    rows = []
    for e, (x, y, z) in enumerate(places):
        for s, sx, sy, elev in net:
            for phase in ("P", "S"):
                tt = location.first_arrival(LAYERS, phase, np.array([math.hypot(x - sx, y - sy)]), np.array([z]), np.array([elev]))[0]
                rows.append((e, s, phase, float(tt), 0.9, sx, sy, elev))
    return spark.createDataFrame(rows, "eventId long, stationId long, phase string, t double, prob double, e double, n double, elevM double"), net


def test_location_regions(spark):
    arrivals, _ = planted_arrivals(spark, [(500.0, -500.0, -1000.0), (0.0, 1000.0, -3000.0)])
    v, g = location.Volume((-3000.0, 3000.0), (-3000.0, 3000.0), (-3000.0, 500.0), (1000.0, 250.0)), location.Region(scale=0.2)
    got = location.location_regions(arrivals, LAYERS, v, g).toPandas().set_index("eventId")
    p = arrivals.where("eventId = 0").toPandas().sort_values(["t", "stationId", "phase"])
    axes = [np.arange(-3000, 3001, 250.0), np.arange(-3000, 3001, 250.0), np.arange(-3000, 501, 250.0)]
    x, y, z = (a.ravel() for a in np.meshgrid(*axes, indexing="ij"))
    misfit = location._weighted_misfits(p, LAYERS, v, x, y, z)[0]
    m = np.exp(-0.2 * (misfit - misfit.min())) * (0.2 * (misfit - misfit.min()) <= 12)
    m /= m.sum()
    r = got.loc[0]
    assert (r.e, r.n, r.z) == (500, -500, -1000) and r.nNodes == (m > 0).sum() and not r.truncated and not r.depthOnEdge
    assert r.meanZ == pytest.approx((m * z).sum()) and r.vErrM == pytest.approx(math.sqrt(-2 * math.log(0.1) * max((m * (z - (m * z).sum()) ** 2).sum(), 250**2 / 12)))
    assert got.loc[1].depthOnEdge
    assert location.location_regions(arrivals, LAYERS, v, location.Region(scale=0.2, budget=10)).where("truncated").count() == 2


def test_datum_check(spark):
    _, net = planted_arrivals(spark, [])
    stations = spark.createDataFrame(net, "stationId long, e double, n double, elevM double")
    points = spark.createDataFrame([(7, 250.0, -250.0, -500.0), (8, 0.0, 500.0, -1500.0)], "eventId long, e double, n double, z double")
    v = location.Volume((-3000.0, 3000.0), (-3000.0, 3000.0), (-3000.0, 500.0), (1000.0, 250.0, 50.0))
    rows = diagnostics.datum_check(points, stations, LAYERS, v, 8).collect()
    assert {r.eventId for r in rows} == {7, 8} and all(abs(r.dzM) <= 50 and r.dhM <= 50 for r in rows)


def test_assignment_asks_for_ids_from_0(spark):
    pairs = spark.createDataFrame([(-1, 2, 0.1, 10.0, 0.2)], "catalogId long, eventId long, dtS double, distM double, cost double")
    with pytest.raises(Exception, match="ids from 0"):
        joins.assign_one_to_one(pairs).collect()
