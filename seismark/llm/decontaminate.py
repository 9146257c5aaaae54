"""Benchmark decontamination: word windows of test items, found in whole training texts.

The windows of the benchmark are hashed, sorted and broadcast in blocks of a fixed size.  A task
hashes the words of its texts, looks every window of words up in the block, and compares the bytes
of each hit, so that no hash collision counts.  A benchmark of several blocks takes one scan of the
texts a block; the driver never holds more than one block.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seismark.llm.shared import bounded_batches, free_name, written
from seismark.llm.text_arrays import WORD_CHARS, Words, split, window_hashes

#: Windows in one broadcast block: 8 bytes of hash and about 100 bytes of words each.
BLOCK_WINDOWS = 200_000

#: Blocks that one scan of the texts takes at most; a task holds as many in its Python workers.
BLOCKS_A_SCAN = 4
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _item_windows(text: str, size: int) -> list[bytes]:
    """The windows of one item, each as its words with a zero byte between."""
    (words,) = split(pa.array([text or ""]), WORD_CHARS) if text else (None,)
    if words is None or not len(words.starts):
        return []
    all_words = [words.word(i) for i in range(len(words.starts))]
    k = min(size, len(all_words))
    return [b"\0".join(all_words[i : i + k]) for i in range(len(all_words) - k + 1)]


def _blocks(items: Iterable[tuple[str, str]], size: int, limit: int) -> Iterator[dict[bytes, list[str]]]:
    block: dict[bytes, list[str]] = defaultdict(list)
    for item, text in items:
        for window in dict.fromkeys(_item_windows(text, size)):
            block[window].append(item)
            if len(block) >= limit:
                yield dict(block)
                block.clear()
    if block:
        yield dict(block)


class Index:
    """The windows of a block by their length in words: sorted hashes, and the items of each window."""

    def __init__(self, block: dict[bytes, list[str]]):
        self.items = block
        by_length: dict[int, list[bytes]] = defaultdict(list)
        for window in block:
            by_length[window.count(b"\0") + 1].append(window)
        self.hashes = {}
        for k, windows in by_length.items():
            texts = pa.array([w.replace(b"\0", b" ").decode() for w in windows])
            self.hashes[k] = np.unique(np.concatenate([window_hashes(w.hashes(), w.text, k)[0] for w in split(texts, WORD_CHARS)]))

    def hits(self, words: Words) -> Iterator[tuple[int, int, list[str]]]:
        """First word, length and items of every window of the block that stands in the texts."""
        hashes = words.hashes()
        for k, known in self.hashes.items():
            found, at = window_hashes(hashes, words.text, k)
            if not len(found):
                continue
            near = np.searchsorted(known, found)
            near[near == len(known)] = 0
            for i in at[known[near] == found]:
                if items := self.items.get(b"\0".join(words.word(j) for j in range(i, i + k))):
                    yield int(i), k, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(text: bytes, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and what stands between them."""
    (words,) = split(pa.array([text.decode()]), WORD_CHARS)
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : words.starts[a]])
        last = int(words.ends[b - 1])
    return b"".join([*out, text[last:]]).decode()


def _scan(shared, at: int, final: str | None):
    """A pass over batches whose last two columns are the spans and items found so far."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value) if shared is not None else None
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros(n, np.int64)
            spans: dict[int, list] = {i: [(s["start"], s["end"]) for s in v] for i, v in enumerate(batch.column(-2).to_pylist()) if v}
            items: dict[int, set] = {i: set(v) for i, v in enumerate(batch.column(-1).to_pylist()) if v}
            for words in split(batch.column(at), WORD_CHARS):
                bounds = words.bounds()
                counts[words.first : words.first + words.n_texts] = np.diff(bounds)
                for start, k, names in index.hits(words) if index else ():
                    text = int(words.text[start])
                    row, place = words.first + text, start - int(bounds[text])
                    spans.setdefault(row, []).append((place, place + k))
                    items.setdefault(row, set()).update(names)
            own, names = batch.columns[:-2], batch.schema.names
            if final == "documents":
                keep = np.ones(n, bool)
                keep[list(spans)] = False
                yield pa.RecordBatch.from_arrays(own, names[:-2]).filter(pa.array(keep))
            elif final == "spans":
                if spans:
                    texts = own[at].to_pylist()
                    for row, found in spans.items():
                        texts[row] = _cut(texts[row].encode(), _merged(found))
                    own[at] = pa.array(texts, own[at].type)
                yield pa.RecordBatch.from_arrays(own, names[:-2])
            else:
                found = [
                    pa.array([[{"start": a, "end": b} for a, b in _merged(spans[i])] if i in spans else [] for i in range(n)], pa.list_(_SPAN)),
                    pa.array([sorted(items[i]) if i in items else [] for i in range(n)], pa.list_(pa.string())),
                ]
                if final == "report":
                    yield pa.RecordBatch.from_arrays([own[0], pa.array(counts), *found], ["id", "n_words", "spans", "items"])
                else:
                    yield pa.RecordBatch.from_arrays([*own, *found], names)

    return scan


def _scanned(docs: DataFrame, benchmark: DataFrame, at: int, final: str, schema, *, item_col: str, item_text_col: str, window: int, block_windows: int) -> DataFrame:
    """docs after all passes; each looks for one block of the benchmark's windows in the texts as they came."""
    spark = docs.sparkSession
    bounded_batches(spark)
    names = free_name(docs, "spans"), free_name(docs, "items")
    docs = docs.withColumns({names[0]: F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"), names[1]: F.expr("cast(array() as array<string>)")})
    items = benchmark.select(F.col(f"`{item_col}`").cast("string"), F.col(f"`{item_text_col}`")).dropna().toLocalIterator()
    last, n = None, 0
    for block in _blocks(((r[0], r[1]) for r in items), window, block_windows):
        if last is not None:
            docs = docs.mapInArrow(_scan(last, at, None), docs.schema)
            n += 1
            if n % BLOCKS_A_SCAN == 0:
                docs = written(docs)
        last = spark.sparkContext.broadcast(block)
    return docs.mapInArrow(_scan(last, at, final), schema)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """One row for each row of docs: id, n_words, spans (word ranges inside occurrences) and items (sorted ids as strings).

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.  A window is
    `window` consecutive words of an item; an item of fewer words is one window, an item without
    words (or null) is none.  A null or empty text has no words and no hits; items with a null id
    are left out.  Repeated rows give repeated results.  Without benchmark items nothing is hit.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"id {texts.schema['id'].dataType.simpleString()}, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
    found = _scanned(texts, benchmark, 1, "report", schema, item_col=item_col, item_text_col=item_text_col, window=window, block_windows=block_windows)
    return found.withColumnRenamed("id", id_col)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of what contamination() found."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    remove: str = "documents",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """docs without contaminated documents (remove="documents") or without the words hit and what stands between them (remove="spans").

    Clean rows, those with a null id or a null text included, come through unchanged, with the
    columns of docs; rows are judged by their own text, whatever their ids.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    return _scanned(docs, benchmark, docs.columns.index(text_col), remove, docs.schema, item_col=item_col, item_text_col=item_text_col, window=window, block_windows=block_windows)
