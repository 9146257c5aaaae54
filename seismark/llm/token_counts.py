"""Token counts of whole texts, without their ids.

No piece crosses the start of a pre-token, so the count of a text is the sum over its pre-tokens.
The pieces of frequent pre-tokens are counted once for the whole corpus and broadcast: a pre-token
is frequent if it makes up 1 / HEAD of all, so that there are at most HEAD of them.  The others
leave each document with their frequencies, are gathered by pre-token, counted once for each
distinct one, joined with those frequencies and summed by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seismark.llm.piece_model import load, pretokens, slices
from seismark.llm.shared import bounded_batches, written

#: Frequent pre-tokens at most, and what they have in bytes together at most, however long they are.
HEAD = 1 << 20
HEAD_BYTES = 64 << 20


def frequent(texts: DataFrame, limit: int = HEAD) -> DataFrame:
    """(word, n) of the pre-tokens that make up 1 / limit of all; texts has one column.

    What is frequent by that share has at most limit times the mean length in bytes; where pre-tokens
    are so long that this exceeds HEAD_BYTES, the share is raised.  A line of dashes that a third of
    all texts hold is frequent like any short word, so no pre-token leaves many rows to one task.

    A slice of the corpus reports those that are frequent in it by half; which words are called
    frequent decides where they are handled, never the result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices(batch.column(0)):
                words, _ = pretokens(part)
                n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                size = pc.binary_length(words.dictionary).to_numpy()
                own = least_share(len(words), int((n * size).sum()), limit)
                keep = (n > 1) & (n >= own / 2)
                out = words.dictionary.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([out, pa.nulls(1, pa.string())]), pa.array(np.concatenate([n[keep], [len(words)]]), pa.int64()), pa.array(np.concatenate([n[keep] * 0, [int((n * size).sum())]]), pa.int64())], ["word", "n", "bytes"])

    counted = written(texts.mapInArrow(count, "word string, n long, bytes long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")))
    total = counted.where("word IS NULL").select("n", "bytes").first()
    return counted.where(F.col("word").isNotNull() & (F.col("n") >= (least_share(*total, limit) if total else 1))).select("word", "n")


def least_share(words: int, size: int, limit: int) -> float:
    """The count that makes a pre-token frequent, of so many with so many bytes."""
    return max(words / limit, size / HEAD_BYTES)


def piece_counter(path: str):
    """Counts the pieces of pre-tokens with the model's library."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(words: list[str]) -> np.ndarray:
        # The library puts a space before each text: it stands for the pre-token's own.  One without
        # a space goes behind a line feed, which is cut off as two pieces, that space and the feed.
        inner = [w[1:] if w[:1] == " " else "\n" + w for w in words]
        n = np.fromiter(map(len, library.encode(inner, num_threads=1)), np.int64, len(words))
        return n - np.fromiter((0 if w[:1] == " " else 2 for w in words), np.int64, len(words)) + np.fromiter((w == " " for w in words), np.int64, len(words))

    return count


def token_counts(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row for each row of docs: its id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    n_tokens is the number of pieces that the library gives for the whole text, without begin, end
    or added special tokens; strings of special tokens inside a text are ordinary text.  A null or
    empty text has 0 bytes and 0 tokens.  Repeated rows give repeated results, a null id stays null,
    an empty table gives an empty result, and other columns are not read.  model is the path of a
    .model file on the driver and on every executor.
    """
    if not model.endswith(".model"):
        raise ValueError("model is a SentencePiece .model file")
    load(model)  # checks that pre-tokens can be counted by themselves
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piece_counter(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 50_000):
                part = batch.slice(start, 50_000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count(part.column(0).to_pylist()))], ["word", "pieces"])

    head = frequent(texts.select("text")).select("word").mapInArrow(counted, "word string, pieces long").toArrow()
    shared = spark.sparkContext.broadcast((pa.concat_arrays(head["word"].chunks) if head.num_rows else pa.array([], pa.string()), head["pieces"].to_numpy()))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pieces = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, part in slices(batch.column(1)):
                words, bounds = pretokens(part)
                where = pc.index_in(words.dictionary, value_set=known).fill_null(-1).to_numpy()
                n = np.concatenate([pieces, [0]])[where]
                at = words.indices.to_numpy()
                sums = np.concatenate([[0], np.cumsum(n[at])])[bounds]
                text = np.repeat(np.arange(len(part)), np.diff(bounds))
                rest = np.flatnonzero(where[at] < 0)
                pair, freq = np.unique(text[rest] * np.int64(max(1, len(n))) + at[rest], return_counts=True)
                lists = np.searchsorted(pair, np.arange(len(part) + 1) * np.int64(max(1, len(n))))
                offsets = pa.array(lists, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(len(part))), batch.column(0).slice(first, len(part)),
                        pc.binary_length(part.fill_null("")).cast(pa.int64()), pa.array(np.diff(sums)),
                        pa.ListArray.from_arrays(offsets, words.dictionary.take(pa.array(pair % max(1, len(n))))), pa.ListArray.from_arrays(offsets, pa.array(freq, pa.int64())),
                    ],
                    ["row", "id", "n_bytes", "known", "words", "freqs"],
                )
                row += len(part)

    kind = texts.schema["id"].dataType.simpleString()
    parts = written(texts.mapInArrow(summed, f"row long, id {kind}, n_bytes long, known long, words array<string>, freqs array<long>"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piece_counter(model)
        for batch in batches:
            words = batch.column(0).dictionary_encode()
            n = count(words.dictionary.to_pylist())[words.indices.to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n * batch.column(2).to_numpy())], ["row", "more"])

    rest = parts.select("row", F.explode(F.arrays_zip("words", "freqs")).alias("x")).select(F.col("x.words").alias("word"), "row", F.col("x.freqs").alias("freq"))
    rest = rest.repartition("word").sortWithinPartitions("word").mapInArrow(joined, "row long, more long").groupBy("row").agg(F.sum("more").alias("more"))
    n_tokens = F.col("known") + F.coalesce("more", F.lit(0))
    return parts.select("row", "id", "n_bytes", "known").join(rest, "row", "left").select(F.col("id").alias(id_col), "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
