"""SentencePiece encoding by relational lattices, and decoding.

The frequent words of the corpus (pre-tokens, see piece_model) are encoded once, in Spark: their
bounded-length substrings are exploded and equi-joined to the piece table, the edges found are
grouped by word, and a higher-order aggregate folds them.  For a unigram model that fold is
Viterbi's.  A BPE model's library gives other cuts than Viterbi's over the same scores, so for
those the fold applies the edges as merges, best score first.  The table of frequent words is
bounded and broadcast.  All other words are folded where they stand, each distinct word of a batch
once, by the same rules over numpy arrays of all words of the batch.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seismark.llm.piece_model import BPE, META, PieceModel, load, pretokens, slices
from seismark.llm.shared import bounded_batches, written
from seismark.llm.token_counts import frequent

#: Words that the relational lattice encodes, at most, and their longest length in characters.
HEAD = 1 << 17
HEAD_CHARS = 60
UNKNOWN_PENALTY = 10.0


def piece_table(spark: SparkSession, model: PieceModel) -> DataFrame:
    """(piece, piece_id, score) of the pieces that text can be cut into."""
    rows = pa.table({"piece": list(model.pieces), "piece_id": [i for i, _ in model.pieces.values()], "score": [float(s) for _, s in model.pieces.values()]})
    return spark.createDataFrame(rows)


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, edges): the pieces that stand in each word, as (score, at, size, piece_id) with `at` from 0.

    words has one column of distinct words; each keeps a row, with no edges if no piece stands in it.
    """
    at = words.select("word", F.posexplode(F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1)))).alias("at", "start"))
    cut = at.select("word", "at", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.greatest(F.length("word") - F.col("at"), F.lit(1))))).alias("size"))
    cut = cut.select("word", "at", "size", F.substring("word", F.col("start"), F.col("size")).alias("piece"))
    edge = F.when(F.col("piece_id").isNotNull(), F.struct("score", "at", "size", "piece_id"))
    return cut.join(F.broadcast(pieces), "piece", "left").groupBy("word").agg(F.collect_list(edge).alias("edges"))  # a model has a fixed number of pieces


def merge_fold(edges: Column, length: Column) -> Column:
    """Starts of the pieces of a word of at most 62 characters: merges by best score, then leftmost, until none is left.

    The state is a bit mask of the places where pieces start, and its end.  An edge is a merge of two
    neighbours while exactly one piece starts inside it.
    """
    one = F.lit(1).cast("long")

    def bit(at: Column) -> Column:
        return F.call_function("shiftleft", one, at.cast("int"))

    def inside(e: Column) -> Column:
        return bit(e["at"] + e["size"]) - bit(e["at"] + 1)

    def valid(mask: Column):
        def f(e: Column) -> Column:
            ends = bit(e["at"]).bitwiseOR(bit(e["at"] + e["size"]))
            return (mask.bitwiseAND(ends) == ends) & (F.bit_count(mask.bitwiseAND(inside(e))) == 1)

        return f

    def step(mask: Column, _: Column) -> Column:
        best = F.array_min(F.transform(F.filter(edges, valid(mask)), lambda e: F.struct((-e["score"]).alias("cost"), e["at"].alias("at"), e["size"].alias("size"))))
        return F.coalesce(mask.bitwiseAND(F.bitwise_not(inside(best))), mask)

    mask = F.aggregate(F.sequence(F.lit(1), F.greatest(length - 1, F.lit(1))), bit(length + 1) - 1, step)
    return F.filter(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0))), lambda i: mask.bitwiseAND(bit(i)) != 0)


def viterbi_fold(edges: Column, length: Column, unknown: float) -> Column:
    """Starts of the pieces of the best cut of a word: the largest sum of scores, a character without a piece scoring `unknown`.

    The state is, for each end so far, the best score and the start of its last piece; of equal
    scores the longer last piece stays.
    """
    empty = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("start")))

    def step(best: Column, end: Column) -> Column:
        here = F.transform(F.filter(edges, lambda e: e["at"] + e["size"] == end), lambda e: F.struct((F.element_at(best, e["at"] + 1)["score"] + e["score"]).alias("score"), (-e["at"]).alias("back")))
        lone = F.struct((F.element_at(best, end)["score"] + F.lit(unknown)).alias("score"), (F.lit(1) - end).alias("back"))
        top = F.array_max(F.concat(here, F.when(F.exists(edges, lambda e: (e["at"] + 1 == end) & (e["size"] == 1)), F.filter(F.array(lone), lambda _: F.lit(False))).otherwise(F.array(lone))))
        return F.concat(best, F.array(F.struct(top["score"].alias("score"), (-top["back"]).alias("start"))))

    best = F.aggregate(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), empty, step)
    back = F.aggregate(
        F.sequence(F.lit(1), F.greatest(length, F.lit(1))),
        F.array(length),
        lambda path, _: F.when(F.element_at(path, 1) > 0, F.concat(F.array(F.element_at(best, F.element_at(path, 1) + 1)["start"]), path)).otherwise(path),
    )
    return F.slice(back, F.lit(1), F.size(back) - 1)


def encode_words(words: DataFrame, model: PieceModel) -> DataFrame:
    """(word, ids) of distinct words of at most HEAD_CHARS characters, spaces as U+2581."""
    length = F.length("word")
    edges = F.col("edges")
    starts = merge_fold(edges, length) if model.kind == BPE else viterbi_fold(edges, length, min(s for _, s in model.pieces.values()) - UNKNOWN_PENALTY)
    cut = lattice(words, piece_table(words.sparkSession, model), model.longest).where(length > 0).withColumn("starts", starts)
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(length))

    def unknown(text: Column) -> Column:
        if model.byte_ids is None:
            return F.array(F.lit(model.unk_id))
        code = F.hex(F.encode(text, "UTF-8"))
        ids = F.array(*map(F.lit, model.byte_ids))
        return F.transform(F.sequence(F.lit(1), F.length(code).cast("int"), F.lit(2)), lambda i: F.element_at(ids, F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("int") + 1))

    def ids(start: Column, end: Column) -> Column:
        own = F.filter(edges, lambda e: (e["at"] == start) & (e["size"] == end - start))
        return F.when(F.size(own) > 0, F.array(F.element_at(own, 1)["piece_id"].cast("int"))).otherwise(unknown(F.substring("word", start + 1, end - start)))

    return cut.select("word", F.flatten(F.zip_with("starts", ends, ids)).alias("ids"))


class WordFold:
    """Cuts many words at once by a model's rules, and long ones one by one."""

    LONG = 64

    def __init__(self, model: PieceModel):
        self.model = model
        by_id = {i: p for p, (i, _) in model.pieces.items()}
        self.char = {p: i for p, (i, _) in model.pieces.items() if len(p) == 1}
        self.score = np.zeros(max(by_id) + 1)
        for i, p in by_id.items():
            self.score[i] = model.pieces[p][1]
        # Every way in which two pieces make a third.
        left, right, made = [], [], []
        for p, (i, _) in model.pieces.items():
            for k in range(1, len(p)):
                a, b = model.pieces.get(p[:k]), model.pieces.get(p[k:])
                if a and b:
                    left.append(a[0]), right.append(b[0]), made.append(i)
        pairs = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(pairs)
        self.pairs, self.made = pairs[order], np.array(made, np.int64)[order]
        # Merges compare by place in the order of scores.
        self.rank = np.zeros(len(self.score), np.int64)
        self.rank[np.lexsort((np.arange(len(self.score)), -self.score))] = np.arange(len(self.score))

    @cached_property
    def known(self) -> dict[int, int]:
        return dict(zip(self.pairs.tolist(), self.made.tolist()))

    def unknown(self, char: str) -> list[int]:
        return [self.model.byte_ids[b] for b in char.encode()] if self.model.byte_ids else [self.model.unk_id]

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        near = np.searchsorted(self.pairs, key)
        near[near == len(self.pairs)] = 0
        return np.where((a >= 0) & (b >= 0) & (self.pairs[near] == key), self.made[near], -1)

    def __call__(self, words: list[str]) -> pa.Array:
        """The ids of each word; spaces stand for U+2581."""
        words = [w.replace(" ", META) for w in words]
        if self.model.kind != BPE:
            return pa.array([self.best_cut(w) for w in words], pa.list_(pa.int32()))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        short, long = np.flatnonzero(sizes <= self.LONG), np.flatnonzero(sizes > self.LONG)
        parts = [self.merge_many([words[i] for i in short]), pa.array([self.merge_long(words[i]) for i in long], pa.list_(pa.int32()))]
        return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate([short, long]))))

    def merge_many(self, words: list[str]) -> pa.ListArray:
        text = "".join(words)
        unknown = {c: -2 - i for i, c in enumerate(sorted(set(text) - self.char.keys()))}
        table = self.char | unknown
        ids = np.fromiter((table[c] for c in text), np.int64, len(text))
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        done_ids, done_word = [], []
        while len(ids):
            made = self._merged(ids[:-1], ids[1:])
            made[word[:-1] != word[1:]] = -1
            can = np.flatnonzero(made >= 0)
            busy = np.zeros(len(words), bool)
            busy[word[can]] = True
            rest = ~busy[word]
            done_ids.append(ids[rest]), done_word.append(word[rest])
            if not len(can):
                break
            # The best merge of each word, leftmost of equals.
            first = np.ones(len(can), bool)
            first[1:] = word[can][1:] != word[can][:-1]
            at = np.minimum.reduceat(self.rank[made[can]] << 32 | can, np.flatnonzero(first)) & 0xFFFFFFFF
            ids[at] = made[at]
            keep = ~rest
            keep[at + 1] = False
            ids, word = ids[keep], word[keep]
        ids, word = np.concatenate([*done_ids, ids[:0]]), np.concatenate([*done_word, word[:0]])
        order = np.argsort(word, kind="stable")
        ids, word = ids[order], word[order]
        if unknown:
            names = [self.unknown(c) for c in sorted(unknown)]
            kind = np.where(ids < 0, -2 - ids, -1)
            sizes = np.where(kind < 0, 1, np.array([*map(len, names), 1])[kind])
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            ids, word = np.repeat(ids, sizes), np.repeat(word, sizes)
            for k, name in enumerate(names):
                for j, i in enumerate(name):
                    ids[starts[kind == k] + j] = i
        offsets = np.searchsorted(word, np.arange(len(words) + 1))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))

    def merge_long(self, word: str) -> list[int]:
        """Merges one word with a heap of its candidate merges."""
        ids: list[int | None] = [self.char.get(c, -1) for c in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i] if 0 <= i < len(ids) else len(ids)
            if i >= 0 and j < len(ids) and ids[i] >= 0 and ids[j] >= 0 and (m := self.known.get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (int(self.rank[m]), i, j, ids[i], ids[j], m))

        for i in range(len(ids) - 1):
            offer(i)
        while heap:
            _, i, j, a, b, m = heapq.heappop(heap)
            if ids[i] != a or ids[j] != b or after[i] != j:
                continue
            ids[i], ids[j] = m, None
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return [x for c, i in zip(word, ids) if i is not None for x in ([i] if i >= 0 else self.unknown(c))]

    def best_cut(self, word: str) -> list[int]:
        lone = float(self.score.min()) - UNKNOWN_PENALTY
        best: list[tuple[float, int, int | None]] = [(0.0, 0, None)]
        for end in range(1, len(word) + 1):
            top = None
            for start in range(max(0, end - self.model.longest), end):
                p = self.model.pieces.get(word[start:end])
                value = (p[1], p[0]) if p else (lone, None) if end - start == 1 else None
                if value and (top is None or best[start][0] + value[0] > top[0]):
                    top = (best[start][0] + value[0], start, value[1])
            best.append(top)
        out, end = [], len(word)
        while end:
            _, start, piece = best[end]
            out.append([piece] if piece is not None else self.unknown(word[start:end]))
            end = start
        return [x for ids in reversed(out) for x in ids]


def decode_lists(lists: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """The text of each list of ids; pieces are the model's, as bytes."""
    parts = pc.take(pieces, lists.flatten().fill_null(1))
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy()
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), parts), b"")
    try:
        texts = joined.cast(pa.string())
    except pa.ArrowInvalid:
        texts = pa.array([t.decode("utf-8", "replace") for t in joined.to_pylist()], pa.string())
    return pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)


def encode(docs: DataFrame, model_path: str, *, text_col: str = "text", ids_col: str = "ids", check_col: str | None = None, head: int = HEAD) -> DataFrame:
    """docs with ids_col added (replaced if there): the ids of each whole text, without begin or end tokens.

    With check_col, that column says whether the ids decode to the text (U+2581 is a space to the model).

    A null or empty text has no ids.  Repeated rows give repeated results; other columns pass
    unchanged; an empty table gives an empty result.  Texts and words of any length are encoded
    whole.  model_path is the same on the driver and on every executor.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model = load(model_path)
    words = frequent(docs.select(F.col(f"`{text_col}`").alias("text")), head).select(F.translate("word", " ", META).alias("word")).where(F.length("word") <= HEAD_CHARS)
    known = encode_words(written(words.distinct()).repartition(max(8, spark.sparkContext.defaultParallelism), "word"), model).select(F.translate("word", META, " ").alias("word"), "ids").toArrow()
    shared = spark.sparkContext.broadcast((known["word"].combine_chunks().cast(pa.string()), known["ids"].combine_chunks()) if known.num_rows else (pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))))
    added = [ids_col, check_col] if check_col else [ids_col]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {x.lower() for x in added}])
    at, schema = docs.columns.index(text_col), f"{ids_col} array<int>" + (f", {check_col} boolean" if check_col else "")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        fold, pieces = WordFold(model), pa.array(model.decoded, pa.binary())
        words, ids = (v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for v in shared.value)
        for batch in batches:
            for first, part in slices(batch.column(at), 1 << 20):
                found, bounds = pretokens(part)
                where = pc.index_in(found.dictionary, value_set=words)
                new = np.flatnonzero(where.is_null().to_numpy(zero_copy_only=False))
                own = fold(found.dictionary.take(pa.array(new)).to_pylist())
                where = where.fill_null(0).to_numpy().copy()
                where[new] = len(words) + np.arange(len(new))
                lists = pa.concat_arrays([ids.cast(pa.list_(pa.int32())), own])
                sizes = pc.list_value_length(lists).fill_null(0).to_numpy()
                at_word = where[found.indices.to_numpy()]
                ends = np.concatenate([[0], np.cumsum(sizes[at_word])])[bounds]
                flat = lists.take(pa.array(at_word)).flatten()
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                rows = batch.slice(first, len(part))
                more = [column]
                if check_col:
                    more.append(pc.equal(decode_lists(column, pieces), pc.replace_substring(part.fill_null(""), META, " ")))
                yield pa.RecordBatch.from_arrays([*rows.columns, *more], [*batch.schema.names, *added])
            pa.default_memory_pool().release_unused()

    from pyspark.sql.types import StructType

    return docs.mapInArrow(encoded, StructType([*docs.schema.fields, *StructType.fromDDL(schema).fields]))


def decode(docs: DataFrame, model_path: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs with text_col added (replaced if there): the text of each list of ids.

    Byte pieces make characters together; bytes that are no UTF-8 become U+FFFD.  The space that
    encoding puts before a text is taken off.  A null or empty list is an empty text; begin, end and
    null ids are no text; an id outside the model fails.
    """
    from pyspark.sql.types import StructType

    docs = docs.drop(*[c for c in docs.columns if c.lower() == text_col.lower()])
    at = docs.columns.index(ids_col)
    bounded_batches(docs.sparkSession)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(load(model_path).decoded, pa.binary())
        for batch in batches:
            texts = decode_lists(batch.column(at), pieces)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, text_col])

    return docs.mapInArrow(decoded, StructType([*docs.schema.fields, *StructType.fromDDL(f"{text_col} string").fields]))
