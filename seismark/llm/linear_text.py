"""Hashed n-gram indicators of whole texts, bounded labelled samples, and calibrated linear scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seismark.llm.shared import bounded_batches, small, written
from seismark.llm.text_arrays import BASE, LOWER, NOT_SPACE, WORD_CHARS, Words, mix, split, window_hashes

BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS

#: Shapes: lower-case letters, capitals, digits and non-ASCII characters each count as one symbol.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[0x61:0x7B], SHAPE[0x41:0x5B], SHAPE[0x30:0x3A], SHAPE[0x80:] = ord("a"), ord("A"), ord("0"), ord("a")

#: (text, bucket) of a block's distinct features, sorted
Features = Callable[[pa.Array], Iterator[tuple[int, int, np.ndarray, np.ndarray]]]


def _buckets(kind: int, hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes + np.uint64(kind * BASE & (1 << 64) - 1)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _indicators(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(np.concatenate([text << BUCKET_BITS | bucket for text, bucket in parts]))
    return key >> BUCKET_BITS, key & (BUCKETS - 1)


def word_features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Words, and the beginnings of words of 4, 5 and 6 bytes, lower-cased."""
    for w in split(texts, WORD_CHARS):
        parts = [(w.text, _buckets(0, w.hashes()))]
        for k in (4, 5, 6):
            long = w.ends - w.starts >= k
            parts.append((w.text[long], _buckets(k, w.range_hash(w.starts[long], w.starts[long] + k))))
        yield (w.first, w.n_texts, *_indicators(parts))


def style_features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Words and pairs of words, the shapes of tokens (their first byte and last four) and of pairs and triples of tokens, and whether a word comes again at once or after one other."""
    for w, s in zip(split(texts, WORD_CHARS), split(texts, NOT_SPACE, SHAPE)):
        hashes = w.hashes()
        pairs, at = window_hashes(hashes, w.text, 2)
        shape = s.range_hash(np.maximum(s.starts, s.ends - 4), s.ends) + (s.data[s.starts].astype(np.uint64) << np.uint64(8))
        two, at2 = window_hashes(shape, s.text, 2)
        three, at3 = window_hashes(shape, s.text, 3)
        parts = [(w.text, _buckets(0, hashes)), (w.text[at], _buckets(1, pairs)), (s.text, _buckets(2, shape)), (s.text[at2], _buckets(3, two)), (s.text[at3], _buckets(4, three))]
        for gap in (1, 2):
            again = np.flatnonzero((hashes[gap:] == hashes[:-gap]) & (w.text[gap:] == w.text[:-gap]))
            parts.append((w.text[again], _buckets(5, np.full(len(again), gap, np.uint64))))
        yield (w.first, w.n_texts, *_indicators(parts))


@dataclass
class Sample:
    """Rows of features in compressed form: row i has columns[offsets[i]:offsets[i+1]]."""

    ids: np.ndarray
    labels: np.ndarray
    offsets: np.ndarray
    columns: np.ndarray

    def __len__(self) -> int:
        return len(self.labels)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.offsets))

    def take(self, keep: np.ndarray) -> Sample:
        sizes = np.diff(self.offsets)
        return Sample(self.ids[keep], self.labels[keep], np.concatenate([[0], np.cumsum(sizes[keep])]), self.columns[np.repeat(keep, sizes)])

    def sums(self, weights: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(weights[self.columns])])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def held_out(doc_id, folds: int = 4, fold: int = 2):
    """Whether a row's label is never learnt from: by the CRC-32 of its id as text."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold


def labelled_sample(docs: DataFrame, labels: DataFrame, features: Features, *, label_col: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> Sample:
    """Features of about `limit` labelled rows that aren't held out, chosen by a hash of the id; all of them if there are fewer.

    Ids may be of any type that both tables share.  Rows without an id or a label are left out.  Of labels that repeat an id, the largest counts.
    """
    own = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).dropna().where(~held_out(F.col("id")))
    own = written(own.groupBy("id").agg(F.max("label").alias("label")))
    share = min(1.0, limit / max(1, own.count()))
    own = small(written(own.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, text, bucket in features(batch.column(2)):
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32()), pa.array(bucket.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), lists], ["id", "label", "features"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(own, "id").select("id", "label", "text")
    found = rows.mapInArrow(extract, f"id {rows.schema['id'].dataType.simpleString()}, label int, features array<int>").toArrow()
    found = found.sort_by("id").combine_chunks()
    if not found.num_rows:
        return Sample(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64))
    lists = found["features"].chunk(0)
    sizes = np.diff(lists.offsets.to_numpy())
    return Sample(np.array(found["id"].to_pylist()), found["label"].to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]), lists.flatten().to_numpy())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn margins into probabilities: Newton's method on Platt's smoothed targets."""
    up, down = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * margins + b)
        g = np.array([np.sum((p - target) * margins), np.sum(p - target)])
        d = p * (1 - p)
        h = np.array([[np.sum(d * margins**2), np.sum(d * margins)], [np.sum(d * margins), np.sum(d)]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


@dataclass
class LinearScore:
    """sigmoid(slope * (sum of the weights of a text's features, over norm) + intercept)"""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    intercept: float = 0.0
    #: divides the sum by the root of the number of features
    scaled: bool = True

    def margins(self, sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return sums / np.sqrt(np.maximum(1, sizes)) + self.bias if self.scaled else sums + self.bias

    def of(self, sample: Sample) -> np.ndarray:
        return self.margins(sample.sums(self.weights), np.diff(sample.offsets))

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * margins + self.intercept)


def under(docs: DataFrame, model: LinearScore, features: Features, *, text_col: str = "text", threshold: float) -> DataFrame:
    """The rows of docs whose whole text scores under threshold."""
    bounded_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            low = np.zeros(batch.num_rows, bool)
            for first, n, text, bucket in features(batch.column(at)):
                sums = np.bincount(text, weights=model.weights[bucket], minlength=n)
                low[first : first + n] = model.probability(model.margins(sums, np.bincount(text, minlength=n))) < threshold
            yield batch.filter(pa.array(low))

    return docs.mapInArrow(keep, docs.schema)


def scored(docs: DataFrame, model: LinearScore, features: Features, *, id_col: str = "doc_id", text_col: str = "text", threshold: float) -> DataFrame:
    """docs's ids with held_out, score and predicted; every whole text, null as empty."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for first, n, text, bucket in features(batch.column(2)):
                sums = np.bincount(text, weights=model.weights[bucket], minlength=n)
                value = model.probability(model.margins(sums, np.bincount(text, minlength=n)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(value), pa.array((value >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    key = F.col(f"`{id_col}`")
    rows = docs.select(key.alias("id"), F.coalesce(held_out(key), F.lit(False)).alias("held"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType
    return rows.mapInArrow(score, StructType.fromDDL(f"`{id_col}` {kind.simpleString()}, held_out boolean, score double, predicted int"))
