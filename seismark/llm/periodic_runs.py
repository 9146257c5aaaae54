"""Stretches of words that repeat with one period, found in a grammar of the texts.

A task takes a piece of about a megabyte of whole texts, numbers its words, and compresses them by
rounds of Re-Pair: in each round every pair of neighbouring symbols that is more frequent than the
pairs overlapping it becomes a nonterminal, wherever it stands in the piece.  What is left of each text
is halved down to its symbols.  Each nonterminal is then looked at once, at its first place: only
periods with two equal blocks on one side of its inner boundary can belong to a run of four periods
across the boundary, and those are extended to both sides within the nonterminal.  What is found is
moved to all places the nonterminal is derived at, and intervals of one period that overlap by a
period are one run.  The smallest nonterminal around a run holds it whole, so no run is missed.

Blocks are compared by two fingerprints modulo 31-bit primes; every run is then checked word by word,
and a piece with a wrong one is searched anew with other fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\x20\x09-\x0D]+"
PIECE_BYTES = 1 << 20
#: A run has so many words, and so many periods, at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Boundaries and periods looked at together.
CHUNK = 1 << 19
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def re_pair(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nonterminals as (start, boundary, end) of their first place, all places as (nonterminal, start), and the starts of the symbols left."""
    symbol, start, end = codes.astype(np.int64), np.arange(len(codes)), np.arange(1, len(codes) + 1)
    inside = doc[1:] == doc[:-1]
    live = inside.copy()
    nonterminals, places, known = [], [], 0
    fresh = int(codes.max(initial=-1)) + 1
    while True:
        # A pair that stands once, of symbols that no round has changed since, can't come to stand twice.
        at = np.flatnonzero(live)
        key, which, count = np.unique(symbol[at] << 32 | symbol[at + 1], return_inverse=True, return_counts=True)
        rank = np.empty(len(key), np.int64)
        rank[np.lexsort((key * 0x9E3779B1 >> 20, count))] = np.arange(len(key))
        weight = np.full(len(live) + 2, -1)
        weight[at + 1] = np.where(count[which] > 1, rank[which], -1)
        own = weight[1:-1]
        live = own >= 0
        top = live & (own >= weight[:-2]) & (own >= weight[2:])
        # Neighbours of one weight are a symbol repeated: every other pair of such a stretch.
        first = np.maximum.accumulate(np.where(top & ~np.concatenate([[False], top[:-1]]), np.arange(len(top)), 0))
        taken = np.flatnonzero(top & ((np.arange(len(top)) - first) % 2 == 0))
        kind = np.searchsorted(at, taken)
        kind = which[kind]
        often = np.bincount(kind, minlength=len(key)) > 1
        taken, kind = taken[often[kind]], kind[often[kind]]
        if not len(taken):
            return np.array(nonterminals, np.int64).reshape(-1, 3) if not nonterminals else np.concatenate(nonterminals), np.concatenate(places) if places else np.zeros((0, 2), np.int64), start
        number = np.cumsum(often) - 1
        place = np.unique(kind, return_index=True)[1]
        nonterminals.append(np.stack([start[taken[place]], start[taken[place] + 1], end[taken[place] + 1]], axis=1))
        places.append(np.stack([known + number[kind], start[taken]], axis=1))
        symbol[taken], end[taken] = fresh + known + number[kind], end[taken + 1]
        known += len(place)
        changed = np.zeros(len(symbol), bool)
        changed[taken] = True
        stays = np.ones(len(symbol), bool)
        stays[taken + 1] = False
        inside = np.concatenate([inside, [False]])
        live = np.concatenate([live, [False]])
        inside[taken] = inside[taken + 1]  # a symbol's flags are those of the pair that it begins
        symbol, start, end, doc, inside, live, changed = (x[stays] for x in (symbol, start, end, doc, inside, live, changed))
        inside, live = inside[:-1], live[:-1]
        live = inside & (live | changed[:-1] | changed[1:])


def halves(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(start, boundary, end) of the inner nodes of balanced trees over the symbols of each text."""
    edges = np.concatenate([starts, bounds[-1:]])
    i, j = np.searchsorted(edges, bounds[:-1]), np.searchsorted(edges, bounds[1:])
    out = [np.zeros((0, 3), np.int64)]
    while len(i):
        more = j - i > 1
        i, j = i[more], j[more]
        mid = (i + j) // 2
        out.append(np.stack([edges[i], edges[mid], edges[j]], axis=1))
        i, j = np.concatenate([i, mid]), np.concatenate([mid, j])
    return np.concatenate(out)


class Fingerprints:
    """Whether stretches of words a fixed distance apart are equal, up to a chance of about 2**-62 for a random base."""

    def __init__(self, codes: np.ndarray, seed: int):
        random = np.random.default_rng(seed)
        self.sides = []
        for prime in PRIMES:
            powers = np.ones(1, np.int64)
            step = int(random.integers(1 << 20, prime - 1))
            while len(powers) <= len(codes):
                powers = np.concatenate([powers, powers * step % prime])
                step = step * step % prime
            sums = np.zeros(len(codes) + 1, np.int64)
            np.cumsum((codes + 1) % prime * powers[: len(codes)] % prime, out=sums[1:])
            self.sides.append((prime, powers, sums % prime))

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """For i <= j: whether the words from i on and from j on are the same for that length."""
        same = np.ones(len(i), bool)
        for prime, powers, sums in self.sides:
            at = np.flatnonzero(same)
            a, b, n = i[at], j[at], length[at]
            same[at] = ((sums[a + n] - sums[a]) % prime * powers[b - a] - (sums[b + n] - sums[b])) % prime == 0
        return same

    def common(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from i on and from j on (back: before i and before j) are the same, at most `most`."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        while len(at := np.flatnonzero(low < high)):
            mid = (low[at] + high[at] + 1) // 2
            same = self.equal(i[at] - mid * back, j[at] - mid * back, mid)
            low[at[same]], high[at[~same]] = mid[same], mid[~same] - 1
        return low


def crossing(codes: np.ndarray, prints: Fingerprints, nodes: np.ndarray) -> np.ndarray:
    """(node, start, end, period) of the longest stretches across each node's boundary, within the node."""
    nodes_at = np.flatnonzero(nodes[:, 2] - nodes[:, 0] >= LEAST_WORDS)
    periods = np.maximum(1, (nodes[nodes_at, 2] - nodes[nodes_at, 0]) // LEAST_PERIODS)
    total = np.concatenate([[0], np.cumsum(periods)])
    out, first = [np.zeros((0, 4), np.int64)], 0
    while first < len(nodes_at):
        last = max(first + 1, int(np.searchsorted(total, total[first] + CHUNK, "right")) - 1)
        node = np.repeat(nodes_at[first:last], periods[first:last])
        q = np.arange(len(node)) - np.repeat(total[first:last] - total[first], periods[first:last]) + 1
        low, mid, high = nodes[node].T
        for left in (False, True):
            anchor = mid - q * left  # the first word of the first of two equal blocks is anchor, or a block before it
            block = anchor - q * left
            fits = np.flatnonzero((block >= low) & (block + 2 * q <= high))
            for probe in (0, 1):  # the first and last words of both blocks, and then their fingerprints
                b, p = block[fits], q[fits]
                fits = fits[codes[b + (p - 1) * probe] == codes[b + p + (p - 1) * probe]]
            fits = fits[prints.equal(block[fits], block[fits] + q[fits], q[fits])]
            i, p = anchor[fits], q[fits]
            end = i + p + prints.common(i, i + p, high[fits] - i - p)
            start = i - prints.common(i, i + p, i - low[fits], back=True)
            long = np.flatnonzero(end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p))
            out.append(np.stack([node[fits[long]], start[long], end[long], p[long]], axis=1))
        first = last
    found = np.concatenate(out)
    found = found[np.lexsort(found.T[::-1])]
    # Of one stretch the smallest period: the others are its multiples.
    smallest = np.ones(len(found), bool)
    smallest[1:] = (found[1:, :3] != found[:-1, :3]).any(axis=1)
    return found[smallest]


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """(start, end, period) of unions of intervals that share a period and overlap by it, by start and period."""
    if not len(start):
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    group = np.cumsum(np.concatenate([[0], period[1:] != period[:-1]]))
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * wide) - group * wide
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (start[1:] > reach[:-1] - period[1:])])
    first = np.flatnonzero(new)
    runs = np.stack([start[first], np.maximum.reduceat(end, first), period[first]], axis=1)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _holds(codes: np.ndarray, runs: np.ndarray) -> bool:
    """Whether each run repeats with its period, word by word."""
    size = runs[:, 1] - runs[:, 0] - runs[:, 2]
    total = np.concatenate([[0], np.cumsum(size)])
    first = 0
    while first < len(runs):
        last = max(first + 1, int(np.searchsorted(total, total[first] + CHUNK, "right")) - 1)
        own = slice(first, last)
        at = np.arange(total[last] - total[first]) + np.repeat(runs[own, 0] - total[own] + total[first], size[own])
        if (codes[at] != codes[at + np.repeat(runs[own, 2], size[own])]).any():
            return False
        first = last
    return True


def all_runs(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs in texts that lie one after the other; text t has the words bounds[t]..bounds[t+1]-1."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    nonterminals, places, left = re_pair(codes, doc)
    nodes = np.concatenate([nonterminals, halves(left, bounds)])
    places = places[np.argsort(places[:, 0], kind="stable")]
    n_places = np.concatenate([np.bincount(places[:, 0], minlength=len(nonterminals)), np.ones(len(nodes) - len(nonterminals), np.int64)]).astype(np.int64)
    starts = np.concatenate([places[:, 1], nodes[len(nonterminals) :, 0]])
    first_place = np.concatenate([[0], np.cumsum(n_places)])
    seed = 0
    while True:
        found = crossing(codes, Fingerprints(codes, seed), nodes)
        times = n_places[found[:, 0]]
        which = np.repeat(np.arange(len(found)), times)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        node = found[which, 0]
        moved = starts[first_place[node] + nth] - nodes[node, 0]
        runs = merged(found[which, 1] + moved, found[which, 2] + moved, found[which, 3])
        if _holds(codes, runs):
            return runs
        seed += 1


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PIECE_BYTES, "right")))
        yield batch.slice(first, last - first)
        first = last


def _of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in _pieces(batch):
            parts = pc.split_pattern_regex(pc.fill_null(piece["text"], ""), pattern=SPACE)
            words = pc.list_flatten(parts)
            full = pc.not_equal(words, "")
            doc = pc.filter(pc.list_parent_indices(parts), full).to_numpy().astype(np.int64)
            words = words.filter(full)
            bounds = np.searchsorted(doc, np.arange(len(piece) + 1))
            codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
            runs = all_runs(codes, bounds)
            of_doc = np.searchsorted(runs[:, 0], bounds)
            own = np.searchsorted(bounds, runs[:, 0], "right") - 1
            again = np.zeros(len(codes) + 1, np.int64)
            np.add.at(again, runs[:, 0] + runs[:, 2], 1)
            np.add.at(again, runs[:, 1], -1)
            kept = np.cumsum(again)[:-1] == 0
            kept_bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept_bounds, pa.int32()), words.filter(pa.array(kept))), " ")
            rows = pa.StructArray.from_arrays([pa.array(runs[:, 0] - bounds[own]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], fields=list(RUN))
            yield pa.RecordBatch.from_arrays([piece["id"], pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(of_doc, pa.int32()), rows), collapsed], names=["id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_words, runs and collapsed text of each row of docs.

    Words are separated by ASCII white space and numbered from 0.  A run (start, length, period) is a stretch of
    at least six words and four periods that no neighbouring word extends; period is its smallest one.
    Runs are sorted by start, then period.  `collapsed` has the words that no run holds after its first
    period, joined by one space.  A null or empty text has no words, no runs and an empty collapsed
    text.  Each row is worked out by itself, so repeated rows and ids give repeated results; a null id stays null.  An empty
    table gives an empty result.  Other columns of docs, whatever their names, are not read.
    """
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([plain.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])
    return plain.mapInArrow(_of_batches, schema).withColumnRenamed("id", id_col)
