"""Self-join of documents on the Jaccard similarity of their word n-grams; exact, by prefixes, tiles and bitmaps.

1. Shingles that stand in a noticeable share of the documents are found, to be put last in the order
   of all shingles (any order gives the same links; this one keeps common passages out of prefixes).
2. Each document gets its set size, a 128-bit hash of its set, four min-hash keys, its prefix (the
   first shingles in that order, of which two linked sets share at least one) and two parity bitmaps
   of its set, one of 512 bits and one whose width follows the size of the set.
3. Identical sets, and sets with an equal min-hash key, are compared with the smallest id of their
   group only.  That finds most links of large groups of near copies with one comparison a document.
4. Prefix shingles that stand in one component only are dropped.  The rest form tiles by shingle,
   size band and, if the shingle is in very many documents, block of documents.  Inside a tile, pairs
   of different components pass if their sizes and the places of the shingle in both orders fit, and
   the bits in which their bitmaps differ (at most the elements in which the sets differ) leave room
   for the overlap that a link needs.  The wide bitmaps of the pairs that pass are compared likewise.
5. What is left is compared exactly: the sorted arrays of both sets are intersected.
6. Links make components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seismark.llm import shared
from seismark.llm.components import components
from seismark.llm.shared import bounded_batches, free_name, small, written
from seismark.llm.text_arrays import BASE, NOT_SPACE, Words, mix, split, window_hashes

#: A shingle in this share of the documents is put last in the order, at most HOT_SHINGLES of them (8 MB).
HOT_SHARE = 0.0005
HOT_SHINGLES = 1_000_000
#: Shingles are counted in chunks of so many before they are sent.
CHUNK = 2_000_000
#: A shingle in more live rows than this is split into blocks of documents.
TILE_ROWS = 20_000
#: Live shingles are broadcast up to so many rows of 12 bytes.
LIVE_ROWS = 1_000_000
BANDS, ROWS = 4, 3
BITMAP_BITS = 512

_ODD = (np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of the k-word shingles of a block, and the text of each; fewer words make one shingle."""
    hashes = words.hashes()
    g, at = window_hashes(hashes, words.text, k)
    parts, texts = [g], [words.text[at]]
    counts = np.diff(words.bounds())
    for c in range(1, k):
        short = counts[words.text] == c if len(words.text) else np.zeros(0, bool)
        if short.any():
            g, at = window_hashes(hashes[short], words.text[short], c)
            parts.append(g)
            texts.append(words.text[short][at])
    return np.concatenate(parts) >> np.uint64(1), np.concatenate(texts)


def _distinct(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) sorted and without repeats."""
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    return text[new], key[new]


def _common(k: int):
    def often(keys: list[np.ndarray]) -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(keys), return_counts=True)
        tokens, n = tokens[n > 2], n[n > 2]
        return pa.RecordBatch.from_arrays([pa.array(tokens.astype(np.int64)), pa.array(n, pa.int64())], ["token", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, size = [], 0
        for batch in batches:
            for words in split(batch.column(0), NOT_SPACE):
                key, text = shingles(words, k)
                keys.append(_distinct(text, key)[1])
                size += len(keys[-1])
                if size >= CHUNK:
                    yield often(keys)
                    keys, size = [], 0
        if keys:
            yield often(keys)

    return count


class Order:
    """Common shingles last: sets the top bit of their keys."""

    def __init__(self, hot: np.ndarray):
        self.hot = np.sort(hot.astype(np.uint64))
        self.table = np.zeros(1 << 24, bool)
        self.table[self.hot & np.uint64((1 << 24) - 1)] = True

    def keys(self, g: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[g & np.uint64((1 << 24) - 1)])
        if len(at):
            near = np.searchsorted(self.hot, g[at])
            near[near == len(self.hot)] = 0
            g = g.copy()
            g[at[self.hot[near] == g[at]]] |= np.uint64(1 << 63)
        return g


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Elements that a set of n shares with any set that it is linked with."""
    return (n * percent + 99) // 100


def _index(k: int, percent: int, hot):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(hot.value)
        for batch in batches:
            for words in split(batch.column(1), NOT_SPACE):
                g, text = shingles(words, k)
                text, key = _distinct(text, order.keys(g))
                m = words.n_texts
                n = np.bincount(text, minlength=m)
                full = np.flatnonzero(n)
                first = np.concatenate([[0], np.cumsum(n)])
                g = key & np.uint64((1 << 63) - 1)
                columns = np.zeros((2 + BANDS, m), np.uint64)
                bitmap = np.zeros((m, BITMAP_BITS // 8), np.uint8)
                if len(full):
                    starts = first[:-1][full]
                    columns[0, full] = np.add.reduceat(mix(g + np.uint64(1)), starts)
                    columns[1, full] = np.bitwise_xor.reduceat(mix(g * _ODD[0]), starts)
                    least = [np.minimum.reduceat(g * a, starts) for a in _ODD]
                    for b in range(BANDS):
                        h = np.full(len(full), b, np.uint64)
                        for r in range(ROWS):
                            h = mix(h * np.uint64(BASE) + least[b * ROWS + r])
                        columns[2 + b, full] = h
                    bit = (g * _ODD[1]) >> np.uint64(64 - 9)
                    parity = np.bincount(text * BITMAP_BITS + bit.astype(np.int64), minlength=m * BITMAP_BITS) & 1
                    bitmap = np.packbits(parity.astype(np.uint8).reshape(m, BITMAP_BITS), axis=1)
                # Twice the differences that a link allows fit in the wide bitmap's half that random sets fill.
                bits = np.maximum(BITMAP_BITS, 1 << np.ceil(np.log2(np.maximum(1, n) * (4 * (100 - percent) / (100 + percent) * 2))).astype(np.int64))
                base = np.concatenate([[0], np.cumsum(bits)])
                bit = base[text] + ((g * _ODD[2]) >> np.uint64(20)).astype(np.int64) % bits[text]
                wide = np.packbits((np.bincount(bit, minlength=base[-1]) & 1).astype(np.uint8))
                width = np.where(n > 0, n - least_overlap(n, percent) + 1, 0)
                head = np.arange(len(g)) - first[text] < width[text]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32()), pa.array(g[head].astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.first, m), pa.array(n, pa.int64()), *[pa.array(c.view(np.int64)) for c in columns], lists, pa.array([r.tobytes() for r in bitmap], pa.binary()), pa.array([wide[a // 8 : b // 8].tobytes() for a, b in zip(base[:-1], base[1:])], pa.binary())],
                    ["id", "n", "set1", "set2", *[f"key{b}" for b in range(BANDS)], "prefix", "bitmap", "wide"],
                )

    return index


_INDEX = "id long, n long, set1 long, set2 long, " + ", ".join(f"key{b} long" for b in range(BANDS)) + ", prefix array<long>, bitmap binary, wide binary"


def _sets(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in split(batch.column(1), NOT_SPACE):
                text, key = _distinct(*reversed(shingles(words, k)))
                first = np.searchsorted(text, np.arange(words.n_texts + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.first, words.n_texts), pa.array([key[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], ["id", "elements"])

    return sets


def _linked(percent: int):
    """Exact intersections of the sorted arrays of a and b."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                near = np.searchsorted(y, x)
                near[near == len(y)] = 0
                both = int(np.count_nonzero(y[near] == x)) if len(y) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return linked


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of ids whose sets are linked."""
    ids = small(written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    sets = written(texts.join(ids, "id", "left_semi").select("id", "text").mapInArrow(_sets(k), "id long, elements binary"))
    left, right = (sets.select(F.col("id").alias(x), F.col("elements").alias(f"of_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b").mapInArrow(_linked(percent), "a long, b long")


def _roomy(percent: int):
    """Pairs whose wide bitmaps leave room for a link; the wider one is folded to the other's width."""

    def roomy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, x, y in zip(batch.column(2).to_numpy(), batch.column(3), batch.column(4)):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                width = min(len(x), len(y))
                x, y = (np.bitwise_xor.reduce(v.reshape(-1, width), axis=0) for v in (x, y))
                keep.append((100 + percent) * (n - int(np.bitwise_count(x ^ y).sum())) >= 2 * percent * n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return roomy


def _tiles(percent: int):
    """Pairs of a tile that may be linked.  Rows come sorted by tile and size."""

    def pairs_of(tile: np.ndarray, n, pos, comp, ids, guest, block, lo, hi, bits) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at, d = np.arange(len(ids)), 0
        while len(at):
            d += 1
            at = at[at + d < len(ids)]
            other = at + d
            # Sizes ascend inside a tile: once the other is too large, or of another tile, all later ones are.
            fit = (tile[at] == tile[other]) & (100 * n[at] >= percent * n[other])
            at, other = at[fit], other[fit]
            want = (comp[at] != comp[other]) & ~(guest[at] & guest[other]) & ((lo[at] == hi[at]) | (block[at] != block[other]))
            x, y = at[want], other[want]
            # At their first common shingle, what stands before it isn't shared.
            want = (100 + percent) * np.minimum(n[x] - pos[x], n[y] - pos[y]) >= percent * (n[x] + n[y])
            x, y = x[want], y[want]
            if len(x):
                apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
                # overlap <= (n + m - apart) / 2, and a link needs (100 + percent) * overlap >= percent * (n + m)
                room = (100 + percent) * (n[x] + n[y] - apart) >= 2 * percent * (n[x] + n[y])
                yield ids[x[room]], ids[y[room]]

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "band", "lo", "hi", "n", "pos", "comp", "id", "guest", "block"]
        kept = None
        for batch in _with_end(batches):
            if batch is not None:
                rows = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
                rows["bits"] = np.frombuffer(b"".join(batch.column(len(names)).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
                kept = {c: np.concatenate([kept[c], rows[c]]) if kept else rows[c] for c in rows}
            if not kept or not len(kept["id"]):
                continue
            new = np.zeros(len(kept["id"]), bool)
            for c in names[:4]:
                new[1:] |= kept[c][1:] != kept[c][:-1]
            tile = np.cumsum(new)
            end = len(tile) if batch is None else int(np.searchsorted(tile, tile[-1]))
            done = {c: v[:end] for c, v in kept.items()}
            kept = {c: v[end:] for c, v in kept.items()}
            found = [np.stack(p) for p in pairs_of(tile[:end], *(done[c] for c in ("n", "pos", "comp", "id", "guest", "block", "lo", "hi", "bits")))]
            if found:
                a, b = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return tiles


def _with_end(batches):
    yield from batches
    yield None


def ngram_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """One row for each row of docs: its id, n_shingles and component_id.

    Words are runs of anything but ASCII white space, A-Z lower-cased.  A document's set holds its
    distinct shingles of `words` words; with fewer words the whole sequence is one; without words,
    or with a null text, it is empty and linked with nothing.  Two documents link when
    100 * intersection >= percent * union.  component_id is the smallest id reachable by links, the
    own id included.

    Repeated rows share their id and so their component; rows that share an id but not a text count
    as one node.  A row with a null id is linked with nothing and has a null component_id.  An empty
    table gives an empty result.  id_col holds integers; other types raise TypeError.  Shingles are
    compared by 63-bit hashes.
    """
    if not 0 < percent < 100 or words < 1:
        raise ValueError("percent is between 0 and 100, words at least 1")
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} is a column of integers: component_id is the smallest of them")
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))

    common = texts.select("text").mapInArrow(_common(words), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    least = max(3, math.ceil(docs.count() * HOT_SHARE))
    hot = common.where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(HOT_SHINGLES).select("token").toArrow()
    hot = spark.sparkContext.broadcast(hot["token"].to_numpy())
    index = written(texts.mapInArrow(_index(words, percent, hot), _INDEX))
    nodes = index.where("n > 0 AND id IS NOT NULL")

    kinds = [F.expr("named_struct('kind', -1, 'k1', set1, 'k2', set2)"), *[F.expr(f"named_struct('kind', {b}, 'k1', key{b}, 'k2', 0L)") for b in range(BANDS)]]
    keys = nodes.select("id", F.explode(F.array(*kinds)).alias("key")).select("id", "key.*")
    groups = keys.groupBy("kind", "k1", "k2").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").drop("last")
    stars = written(keys.join(groups, ["kind", "k1", "k2"]).where("id <> pivot").select("kind", "k1", "k2", "id", "pivot"))
    same = written(stars.where("kind = -1").select("id", "pivot", F.col("k1").alias("set1"), F.col("k2").alias("set2")).distinct())
    # An id that stands on several rows is a copy by one of its texts and none by another.
    copies = small(same.select("id", "set1", "set2"))
    ids = small(written(same.select("id").distinct()))
    alone = small(written(nodes.join(ids, "id", "left_semi").select("id", "set1", "set2").distinct().groupBy("id").count().where("count = 1").select("id")))
    near = stars.where("kind >= 0").join(alone, "id", "left_anti").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    links = verified(near, texts, words, percent).unionByName(same.select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct())
    links = written(links)
    known = small(written(components(links)))

    sets = nodes.join(copies, ["id", "set1", "set2"], "left_anti").join(known, "id", "left").withColumn("comp", F.coalesce("component", "id"))
    live = sets.select("comp", F.explode("prefix").alias("token")).groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("c")).where("low < high")
    live = written(live.select("token", F.ceil(F.col("c") / TILE_ROWS).cast("int").alias("blocks")))
    # The width is a little over 100 / percent, so that rounding puts no two linked sizes more than one band apart.
    band = F.floor(F.log(F.col("n").cast("double")) / (1.001 * math.log(100 / percent))).cast("int")
    rows = sets.select("id", "comp", "n", "bitmap", band.alias("own"), F.posexplode("prefix").alias("pos", "token")).join(small(live, min(LIVE_ROWS, 4 * shared.BROADCAST_ROWS)), "token")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("guest", F.explode(F.array(F.lit(False), F.lit(True))))
    rows = rows.select("token", (F.col("own") + F.col("guest").cast("int")).alias("band"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "n", F.col("pos").cast("long").alias("pos"), "comp", "id", "guest", "block", "bitmap")
    tile = ["token", "band", "lo", "hi"]
    maybe = rows.repartition(*tile).sortWithinPartitions(*tile, "n").mapInArrow(_tiles(percent), "a long, b long").distinct()
    wide = [nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"wide_{x}")) for x in "ab"]
    maybe = written(maybe).join(wide[0], "a").join(wide[1], "b").select("a", "b", F.expr("n_a + n_b"), "wide_a", "wide_b").mapInArrow(_roomy(percent), "a long, b long")
    more = verified(written(maybe), texts, words, percent)
    found = small(written(components(links.unionByName(more))))
    return index.select("id", "n").join(found, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs without those that have a smaller id in their component; rows with a null id stay."""
    joined = ngram_join(docs, id_col=id_col, **options)
    own = free_name(docs, "gone")
    gone = written(joined.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(own)).distinct())
    return docs.join(small(gone), F.col(f"`{id_col}`") == F.col(own), "left_anti")
