"""Joins that Spark lacks: bands, the next and the nearest in time, best in a window, neighbours, one-to-one assignment."""

from __future__ import annotations

import heapq
import math
from decimal import Decimal
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seismark.functions.graphs import components
from seismark.functions.tables import materialised, ranked, small


def band_join(left: DataFrame, right: DataFrame, left_t: str, right_t: str, width: float, on: list[str] = ()) -> DataFrame:
    """Pairs with |left_t - right_t| <= width, as an equi-join on buckets of that width.

    The right side is sent to its bucket and both neighbours, so no pair of rows is compared that
    isn't within two widths.
    """
    bucket = F.floor(F.col(left_t) / width)
    l = left.withColumn("_b", bucket)  # noqa: E741
    r = right.withColumn("_b", F.explode(F.array(*[F.floor(F.col(right_t) / width) + d for d in (-1, 0, 1)])))
    return l.join(r, [*on, "_b"]).where(F.abs(F.col(left_t) - F.col(right_t)) <= width).drop("_b")


def pair_offsets(located: DataFrame, public: DataFrame, max_dt: float, max_dist: float) -> DataFrame:
    """Public and located events within both limits (inclusive): dtS, distM.  located has eventId, t, e, n; public catalogId, t, e, n."""
    l = located.select("eventId", F.col("t").alias("lt"), F.col("e").alias("le"), F.col("n").alias("ln"))  # noqa: E741
    p = public.select("catalogId", F.col("t").alias("pt"), F.col("e").alias("pe"), F.col("n").alias("pn"))
    pairs = band_join(l, p, "lt", "pt", max_dt)
    return pairs.select("catalogId", "eventId", (F.col("lt") - F.col("pt")).alias("dtS"), F.hypot(F.col("le") - F.col("pe"), F.col("ln") - F.col("pn")).alias("distM")).where(F.col("distM") <= max_dist)


def with_cost(pairs: DataFrame, dt_scale: float, dist_scale: float) -> DataFrame:
    return pairs.withColumn("cost", F.abs("dtS") / dt_scale + F.col("distM") / dist_scale)


def lowest_cost(pairs: DataFrame) -> DataFrame:
    """The cheapest located event of each public one, not one to one; ties by eventId."""
    w = Window.partitionBy("catalogId").orderBy("cost", "eventId")
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: Located events of a cell, on average, when cheapest_pairs starts.
CELL_EVENTS = 1.0


def cheapest_pairs(located: DataFrame, public: DataFrame, max_dt: float, max_dist: float) -> DataFrame:
    """`lowest_cost` of the pairs within both limits, with costs scaled by them, without making all pairs.

    A public event meets the located ones of its cell of time and place and of the cells around.  Whoever
    is as cheap as a cell is wide, in parts of the limits, can't be beaten from outside; only pairs up to that cost are kept, and the rest
    goes on with cells twice as wide, at last with the limits themselves.  So dense tables make no more pairs an event than sparse ones.
    """
    l = materialised(located.select("eventId", F.col("t").alias("lt"), F.col("e").alias("le"), F.col("n").alias("ln")).dropna())  # noqa: E741
    left = materialised(public.select("catalogId", F.col("t").alias("pt"), F.col("e").alias("pe"), F.col("n").alias("pn")))
    box = l.agg(F.count(F.lit(1)).alias("m"), *[(F.max(c) - F.min(c)).alias(c) for c in ("lt", "le", "ln")]).first()
    cells = math.prod(max(1.0, (x or 0.0) / y) for x, y in ((box.lt, max_dt), (box.le, max_dist), (box.ln, max_dist)))
    share = min(1.0, (CELL_EVENTS * cells / max(box.m, 1)) ** (1 / 3))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    parts = []
    while True:
        last = share >= 1
        cell = lambda t, e, n: [F.floor(F.col(t) / (max_dt * share)).alias("_i"), F.floor(F.col(e) / (max_dist * share)).alias("_j"), F.floor(F.col(n) / (max_dist * share)).alias("_k")]
        here = left.select("*", *cell("pt", "pe", "pn")).withColumn("_d", F.explode(around)).withColumns({f"_{x}": F.col(f"_{x}") + F.col(f"_d.{x}") for x in "ijk"}).drop("_d")
        pairs = here.hint("merge").join(small(l.select("*", *cell("lt", "le", "ln"))), ["_i", "_j", "_k"]).where(F.abs(F.col("lt") - F.col("pt")) <= max_dt)
        pairs = with_cost(pairs.select("catalogId", "eventId", (F.col("lt") - F.col("pt")).alias("dtS"), F.hypot(F.col("le") - F.col("pe"), F.col("ln") - F.col("pn")).alias("distM")).where(F.col("distM") <= max_dist), max_dt, max_dist)
        if not last:
            pairs = pairs.where(F.col("cost") <= share * (1 - 1e-9))
        done = materialised(lowest_cost(pairs))
        parts.append(done)
        if last:
            break
        left = materialised(left.join(done.select("catalogId"), "catalogId", "left_anti"))
        if left.isEmpty():
            break
        share = min(1.0, share * 2)
    return reduce(DataFrame.unionByName, parts)


def sparse_assignment(near: list[list[tuple[int, int]]], n_columns: int, alone: int) -> list[int]:
    """The column of each row, or -1, in a set of most pairs and then the least total cost.

    near lists (column, cost >= 0) of each row; `alone`, what a row without a column costs, exceeds
    what all pairs together cost.  Rows enter one by one: each takes the cheapest way, over columns
    that others give up for their next ones, to a free column or to a row that stays alone.
    """
    u, v = [0] * len(near), [0] * n_columns
    owner, column = [-1] * n_columns, [-1] * len(near)
    for s in range(len(near)):
        reach: dict[int, int] = {}
        come: dict[int, int] = {}
        heap: list[tuple[int, int]] = []
        closed: list[tuple[int, int]] = []
        row, base, least, last = s, 0, None, s
        while True:
            start = base - u[row]
            for j, c in near[row]:
                d = start + c - v[j]
                if j not in reach or d < reach[j]:
                    reach[j], come[j] = d, row
                    heapq.heappush(heap, (d, j))
            if least is None or start + alone < least:
                least, last = start + alone, row
            while heap and heap[0][0] > reach[heap[0][1]]:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= least:
                end, j = least, column[last]  # `last` stays alone and gives its column up
                column[last] = -1
                break
            base, j = heapq.heappop(heap)
            if owner[j] < 0:
                end = base
                break
            closed.append((base, j))
            reach[j] = base - 1  # closed: no later way is shorter
            row = owner[j]
        u[s] += end
        for d, k in closed:
            v[k] -= end - d
            u[owner[k]] += end - d
        while j >= 0:
            row = come[j]
            owner[j], column[row], j = row, j, column[row]
    return column


#: Pairs of connected components that one task solves at most; larger components are auctioned in blocks.
LOCAL_PAIRS = 250_000
#: Pairs of a block of the auction, on average.
BLOCK_PAIRS = 50_000
#: Costs are whole numbers of this part, in a task as in an auction.
COST_UNITS = 10**9
#: By how much an auction's step falls from phase to phase.
FALL = 8
_PRICE = "decimal(38,0)"
_PAIRS = "catalogId long, eventId long, dtS double, distM double, cost double"


def _assign(pairs: pd.DataFrame) -> pd.DataFrame:
    """Most pairs first, then the least total cost; costs to 9 places."""
    pairs = pairs.sort_values(["catalogId", "eventId"])
    row, _ = pd.factorize(pairs.catalogId)
    column, names = pd.factorize(pairs.eventId)
    cost = np.rint(pairs.cost.to_numpy() * COST_UNITS).astype(np.int64)
    near: list[list[tuple[int, int]]] = [[] for _ in range(row.max() + 1)]
    for i, j, c in zip(row.tolist(), column.tolist(), cost.tolist()):
        near[i].append((j, c))
    alone = (int(cost.max()) + 1) * (min(len(near), len(names)) + 1)
    return pairs[np.array(sparse_assignment(near, len(names), alone))[row] == column]


def _bids(step: int):
    """An auction among the people of one block, until each of them holds something at the prices known here."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        offers: dict[int, list[tuple[int, int]]] = {}
        price: dict[int, int] = {}
        holder: dict[int, int] = {}
        for x, y, cost, p, own in zip(rows.x.tolist(), rows.y.tolist(), map(int, rows.c), map(int, rows.price), rows.own.tolist()):
            offers.setdefault(x, []).append((y, cost))
            price[y] = p
            if own:
                holder[y] = x
        held, changed = set(holder.values()), set()
        waiting = [x for x in sorted(offers) if x not in held]
        while waiting:
            x = waiting.pop()
            best = second = None
            for y, cost in offers[x]:
                value = -cost - price[y]
                if best is None or value > best[0]:
                    best, second = (value, y), best
                elif second is None or value > second[0]:
                    second = (value, y)
            y = best[1]
            price[y] += best[0] - (second[0] if second else best[0]) + step
            changed.add(y)
            if y in holder and holder[y] in offers:
                waiting.append(holder[y])
            holder[y] = x
        return pd.DataFrame([(y, Decimal(price[y]), holder[y]) for y in sorted(changed)], columns=["y", "price", "x"])

    return run


def auction(pairs: DataFrame, block_pairs: int = BLOCK_PAIRS, scale: float = COST_UNITS, fall: int = FALL) -> DataFrame:
    """(catalogId, eventId) of one of the best one-to-one sets, by auctions in blocks of time; for components of any size.

    Every event of both sides is a person and a thing; a pair links the one's person with the other's
    thing both ways, and staying alone is taking one's own.  All persons then hold a thing, and a
    fall of the bids' step by a factor a phase keeps bidding short.  In a round, each block bids
    for itself until its own persons hold something, at prices that may be too low by now; of several
    blocks that raised a price the highest stays, and whoever lost bids again in the next round, in
    blocks cut half-way between.  Prices only rise, so that whoever still holds a thing is content
    within the last step, and with integer costs times the number of persons a step of 1 makes the
    result optimal.

    pairs has catalogId, eventId, cost and place, the public event's time: blocks are stretches of
    block_pairs pairs in the order of it and of the ids.  Costs are rounded to 1 / scale, as in a task, at any
    size: prices are whole numbers of 38 digits, which some 10^9 events of costs near 1 fill; more are refused.
    """
    pairs = materialised(pairs.select("catalogId", "eventId", "cost", "place"))
    n, left, right, most = pairs.agg(F.count(F.lit(1)), F.countDistinct("catalogId"), F.countDistinct("eventId"), F.max("cost")).first()
    if not n:
        return pairs.select("catalogId", "eventId")
    people = left + right + 1
    alone = (min(left, right) + 1) * (int(most * scale) + 2) * people
    if alone * people >= 10**38:
        raise ValueError(f"prices of {people} events and costs of {most} don't fit 38 digits")
    whole = lambda x: F.lit(Decimal(x)).cast(_PRICE)
    at = ranked(pairs, "place", "catalogId", "eventId", name="at")
    a, b, c = F.col("catalogId") * 2, F.col("eventId") * 2 + 1, (F.rint(F.col("cost") * F.lit(float(scale))).cast("decimal(19,0)") * F.lit(Decimal(people))).cast(_PRICE)
    edges = materialised(at.select(F.inline(F.array(F.struct("at", a.alias("x"), b.alias("y"), c.alias("c")), F.struct("at", b.alias("x"), a.alias("y"), c.alias("c"))))))
    shift = block_pairs // 2 if n > block_pairs else 0
    block = lambda more: F.floor((F.min("at") - 1 + more) / block_pairs)
    home = materialised(edges.groupBy("x").agg(block(0).alias("even"), block(shift).alias("odd")))
    edges = materialised(edges.select("x", "y", "c").unionByName(home.select("x", F.col("x").alias("y"), whole(alone).alias("c"))).join(home, "x"))
    state = materialised(home.select(F.col("x").alias("y"), whole(0).alias("price"), F.lit(None).cast("long").alias("holder")))
    step, turn = alone // 4, 0
    while True:
        step = max(1, step // fall)
        state = state.withColumn("holder", F.lit(None).cast("long"))
        while True:
            turn += 1
            layout = ("even", "odd")[turn % 2]
            free = materialised(home.join(state.select(F.col("holder").alias("x")), "x", "left_anti").select(layout).distinct())
            if free.isEmpty():
                break
            rows = edges.join(free, layout, "left_semi").join(state, "y").select(layout, "x", "y", "c", "price", F.coalesce(F.col("holder") == F.col("x"), F.lit(False)).alias("own"))
            made = rows.groupBy(layout).applyInPandas(_bids(step), f"y long, price {_PRICE}, x long").groupBy("y").agg(F.max(F.struct("price", "x")).alias("bid"))
            state = materialised(state.join(made, "y", "left").select("y", F.coalesce("bid.price", "price").alias("price"), F.coalesce("bid.x", "holder").alias("holder")))
        if step == 1:
            break
    won = state.where("y % 2 = 1 AND holder % 2 = 0")
    return won.select(F.expr("holder DIV 2").alias("catalogId"), F.expr("y DIV 2").alias("eventId"))


def assign_one_to_one(pairs: DataFrame, local_pairs: int = LOCAL_PAIRS) -> DataFrame:
    """Of all one-to-one sets of admissible pairs, one with the most pairs and then the least total cost.

    Connected parts of the pairs share no event and are independent: those of at most local_pairs
    pairs are solved by shortest ways over their lists of neighbours, as many in a task as that bound
    holds; larger ones by `auction`.  pairs has catalogId, eventId (integers from 0), dtS, distM,
    cost (0 or more), and maybe place, the public event's time, which cuts large parts into blocks.
    """
    place = F.col("place").cast("double") if "place" in pairs.columns else F.col("catalogId").cast("double")
    from_0 = [F.when(F.col(c) < 0, F.raise_error(F.lit("ids from 0 are asked for"))).otherwise(F.col(c)).alias(c) for c in ("catalogId", "eventId")]
    pairs = materialised(pairs.select(*from_0, "dtS", "distM", "cost", place.alias("place")))
    part = components(pairs.select((F.col("catalogId") * 2).alias("a"), (F.col("eventId") * 2 + 1).alias("b")))
    named = materialised(pairs.withColumn("id", F.col("catalogId") * 2).join(part, "id").drop("id"))
    large = materialised(named.groupBy("component").count().where(F.col("count") > local_pairs).select("component"))
    tasks = max(pairs.sparkSession.sparkContext.defaultParallelism, -(-2 * named.count() // max(1, local_pairs)))
    rest = named.join(large, "component", "left_anti").withColumn("task", F.pmod(F.xxhash64("component"), F.lit(tasks)))
    out = rest.groupBy("task").applyInPandas(lambda k, df: _assign(df)[["catalogId", "eventId", "dtS", "distM", "cost"]], _PAIRS)
    if large.isEmpty():
        return out
    won = auction(named.join(large, "component", "left_semi"))
    return out.unionByName(named.drop("component", "place").join(won, ["catalogId", "eventId"]))


def match_catalog(located: DataFrame, public: DataFrame, max_dt: float, max_dist: float) -> DataFrame:
    """One row for each public event: its match, or why it has none and the cheapest candidate."""
    pairs = with_cost(pair_offsets(located, public, max_dt, max_dist), max_dt, max_dist)
    pairs = materialised(pairs.join(public.select("catalogId", F.col("t").alias("place")), "catalogId"))
    won = assign_one_to_one(pairs).select("catalogId", "eventId", "dtS", "distM")
    best = lowest_cost(pairs).select("catalogId", F.col("eventId").alias("bestId"))
    out = public.select("catalogId").join(won, "catalogId", "left").join(best, "catalogId", "left")
    reason = F.when(F.col("eventId").isNotNull(), "matched").when(F.col("bestId").isNotNull(), F.concat(F.lit("lostOneToOne: "), F.col("bestId").cast("string"))).otherwise("noCandidate")
    return out.select("catalogId", "eventId", "dtS", "distM", reason.alias("reason"))


def sensitivity(pairs: DataFrame, tolerances: list[tuple[float, float]]) -> DataFrame:
    """(dtS, distM, admissible): admissible pairs under each pair of limits."""
    grid = F.broadcast(pairs.sparkSession.createDataFrame(tolerances, "maxDt double, maxDist double"))  # one row a tolerance
    hit = (F.abs("dtS") <= F.col("maxDt")) & (F.col("distM") <= F.col("maxDist"))
    return pairs.join(grid, hit).groupBy("maxDt", "maxDist").agg(F.count(F.lit(1)).alias("admissible"), F.countDistinct("catalogId").alias("public"))


def s_after_p(p: DataFrame, s: DataFrame, least: float, most: float, on: str = "stationId") -> DataFrame:
    """For each P the earliest S of its station in [tP + least, tP + most]; without one, no row."""
    later = band_join(p.select(on, F.col("id").alias("pId"), F.col("t").alias("tP")), s.select(on, F.col("t").alias("tS")), "tP", "tS", most, [on])
    return later.where((F.col("tS") >= F.col("tP") + least) & (F.col("tS") <= F.col("tP") + most)).groupBy(on, "pId", "tP").agg(F.min("tS").alias("tS"))


def best_phases(windows: DataFrame, picks: DataFrame, width: float, on: str = "stationId") -> DataFrame:
    """In each window [a, b] the most probable P, and the most probable S strictly after it; ties earlier, then by id.

    `violated`: the best S of the window isn't after its best P.
    """
    inside = band_join(windows.select("windowId", on, "a", "b"), picks.select(on, "id", "phase", "t", "prob"), "a", "t", width, [on]).where("t BETWEEN a AND b")
    key = F.struct(F.col("prob").alias("prob"), (-F.col("t")).alias("early"), F.col("id").alias("id"), F.col("t").alias("t"))
    top = inside.groupBy("windowId").agg(F.max(F.when(F.col("phase") == "P", key)).alias("p"), F.max(F.when(F.col("phase") == "S", key)).alias("rawS"))
    s = inside.where("phase = 'S'").join(top.select("windowId", "p.t"). withColumnRenamed("t", "tP"), "windowId").where("t > tP").groupBy("windowId").agg(F.max(key).alias("s"))
    return top.join(s, "windowId", "left").select("windowId", F.col("p.id").alias("pId"), F.col("s.id").alias("sId"), (F.col("rawS.t") <= F.col("p.t")).alias("violated"))


def nearest_edge(picks: DataFrame, edges: DataFrame, on: str = "stationId") -> DataFrame:
    """Distance of each pick to the nearest edge of its station, from one pass over both in time order."""
    both = picks.select(on, "id", "t", F.lit(None).cast("double").alias("edge")).unionByName(edges.select(on, F.lit(None).cast("string").alias("id"), F.col("edge").alias("t"), "edge"))
    w = Window.partitionBy(on).orderBy("t", F.col("edge").isNull())
    back = F.last("edge", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("edge", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return both.withColumn("back", back).withColumn("ahead", ahead).where("id IS NOT NULL").select(on, "id", "t", F.least(F.col("t") - F.col("back"), F.col("ahead") - F.col("t")).alias("edgeS"))


def nearest_station(events: DataFrame, stations: DataFrame, k: int = 1) -> DataFrame:
    """(eventId, stationId, distM, place): the k nearest stations of each event by epicentral distance, ties by id; all of them if there are fewer.

    An event meets the stations of its cell and the eight around.  It is done when the k-th of them is
    nearer than a cell is wide, since no other can be; the rest goes on with cells twice as wide.
    """
    s = materialised(stations.select("stationId", F.col("e").alias("se"), F.col("n").alias("sn")))
    left = materialised(events.select("eventId", "e", "n"))
    box = s.select(F.col("se").alias("x"), F.col("sn").alias("y")).agg(F.count(F.lit(1)).alias("m"), F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d")).first()
    far = left.agg(F.min("e").alias("a"), F.max("e").alias("b"), F.min("n").alias("c"), F.max("n").alias("d")).first()
    out = left.join(s.limit(0), F.lit(False)).select("eventId", "stationId", F.hypot("e", "n").alias("distM"), F.lit(1).alias("place"))
    if not box.m or far.a is None:
        return out
    some = min(k, box.m)
    span = max(max(box.b, far.b) - min(box.a, far.a), max(box.d, far.d) - min(box.c, far.c), 1.0) * 1.001
    width, parts = max(max(box.b - box.a, box.d - box.c) * (some / box.m) ** 0.5, span / 2**20), []
    cell = lambda x, y: [F.floor(F.col(x) / width).alias("_i"), F.floor(F.col(y) / width).alias("_j")]
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    while True:
        here = s.select("stationId", "se", "sn", F.explode(around).alias("_d"), *cell("se", "sn")).select("stationId", "se", "sn", (F.col("_i") + F.col("_d.i")).alias("_i"), (F.col("_j") + F.col("_d.j")).alias("_j"))
        near = left.select("eventId", "e", "n", *cell("e", "n")).join(small(here), ["_i", "_j"]).select("eventId", "stationId", F.hypot(F.col("e") - F.col("se"), F.col("n") - F.col("sn")).alias("distM"))
        if some == 1:
            top = near.groupBy("eventId").agg(F.min(F.struct("distM", "stationId")).alias("x")).select("eventId", F.array("x").alias("near"))
        else:
            w = Window.partitionBy("eventId").orderBy("distM", "stationId")
            top = near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= some).groupBy("eventId").agg(F.array_sort(F.collect_list(F.struct("distM", "stationId"))).alias("near"))
        last = width >= span
        ready = F.lit(True) if last else (F.size("near") == some) & (F.element_at("near", -1)["distM"] < width)
        done = materialised(top.where(ready))
        parts.append(done)
        left = materialised(left.join(done.select("eventId"), "eventId", "left_anti"))
        if last or left.isEmpty():
            break
        width *= 2
    for done in parts:
        out = out.unionByName(done.select("eventId", F.posexplode("near").alias("_p", "x")).select("eventId", "x.stationId", "x.distM", (F.col("_p") + 1).alias("place")))
    return out


def neighbour_median(terms: DataFrame, stations: DataFrame, k: int, max_dist: float) -> DataFrame:
    """Median term of the k nearest other stations with a term within max_dist, per station."""
    known = materialised(stations.join(terms, "stationId").select("stationId", "e", "n", "term"))
    near = nearest_station(stations.select(F.col("stationId").alias("eventId"), "e", "n"), known, k + 1).where((F.col("eventId") != F.col("stationId")) & (F.col("distM") <= max_dist))
    w = Window.partitionBy("eventId").orderBy("distM", "stationId")
    near = near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).join(small(known.select("stationId", "term")), "stationId")
    return near.groupBy(F.col("eventId").alias("stationId")).agg(F.count(F.lit(1)).alias("neighbours"), F.expr("percentile(term, 0.5)").alias("medianTerm"))


def event_picks(events: DataFrame, picks: DataFrame) -> DataFrame:
    """One row for each id in an event's pickIds, in list order, with the pick."""
    return events.select("eventId", F.posexplode("pickIds").alias("pos", "id")).join(picks, "id")


def holders(assigned: DataFrame) -> DataFrame:
    """The events that hold each pick."""
    return assigned.groupBy("pickId").agg(F.array_sort(F.collect_set("eventId")).alias("events"))


def densified(events: DataFrame, stations: DataFrame, arrivals: DataFrame) -> DataFrame:
    """A row for every event, used station and phase; null observation where there is no pick."""
    phases = F.explode(F.array(F.lit("P"), F.lit("S"))).alias("phase")
    grid = events.select("eventId").join(small(stations.where("usedInRun").select("stationId"))).select("eventId", "stationId", phases)
    return grid.join(arrivals, ["eventId", "stationId", "phase"], "left")
