"""How much the sources of a language differ in their words: an audit over Arrow tables.

Each task lower-cases, splits, dictionary-encodes and counts its texts with Arrow's kernels
(mapInArrow) and hands on one row for each language, source and term that it has seen since it last
emptied its table.  Spark adds these rows up and keeps the terms of enough documents.  The kept terms
of a language are dealt out by hash into columnar shards; a shard is a matrix of sources by terms, from
which the sums of absolute differences of all pairs of sources and each source's leading terms come.
All numbers are integers: a share is 1 + floor(1e9 * (count + 5) / (total + 5 * terms)).

The rows that leave a shard are the pairs of a language's sources, which the result has too, and at most
`top` terms a source.  The matrix of a shard holds at most CELLS numbers, however many sources there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seismark.llm.shared import small, written

#: Whatever isn't an ASCII letter or a character beyond ASCII separates terms.
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: A task adds up its counts when it holds so many rows, and hands them on if half as many are left.
HELD_ROWS = 400_000
PIECE_BYTES = 1 << 20
#: A shard has at most so many cells, and so many terms.
CELLS = 1 << 22
MOST_TERMS = 4096
SCALE_STEP, SCALE_STEPS = 1000, 3  # 1e9 in steps, so that totals of up to 9e15 stay within 64 bits

COUNTS = "lang string, source string, term string, n long, docs long"
FIGURES = "lang string, source string, part string, item string, value long"


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, about PIECE_BYTES of text at a time; a longer text is a piece of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + PIECE_BYTES, "right")))
        yield batch.slice(first, last - first)
        first = last


def _piece_counts(piece: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents of each term by language and source."""
    text, lang, source = (pc.fill_null(piece[c], "") for c in ("text", "lang", "source"))
    terms = pc.split_pattern_regex(pc.ascii_lower(text), pattern=SEPARATORS)
    codes = pc.list_flatten(terms).dictionary_encode()
    found = pa.table({"row": pc.list_parent_indices(terms), "code": codes.indices})
    rows = found.group_by(["row", "code"]).aggregate([([], "count_all")])
    rows = pa.table({"lang": pc.take(lang, rows["row"]), "source": pc.take(source, rows["row"]), "code": rows["code"], "n": rows["count_all"]})
    sums = rows.group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ([], "count_all")])
    table = pa.table({"lang": sums["lang"], "source": sums["source"], "term": pc.take(codes.dictionary, sums["code"]), "n": sums["n_sum"], "docs": sums["count_all"]})
    return table.filter(pc.not_equal(table["term"], ""))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        for piece in _pieces(batch):
            held.append(_piece_counts(piece))
            rows += held[-1].num_rows
            if rows > HELD_ROWS:
                held = [_added(held)]
                rows = held[0].num_rows
                if rows > HELD_ROWS // 2:
                    yield from held.pop().to_batches()
                    rows = 0
    if held:
        yield from _added(held).to_batches()


def _added(tables: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return sums.rename_columns(["lang", "source", "term", "n", "docs"]).combine_chunks()


def shares(counts: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(1e9 * (counts + 5) / (total + 5 * terms)), by long division."""
    whole, rest, out = total + 5 * terms, counts + 5, np.zeros_like(counts)
    for _ in range(SCALE_STEPS):
        rest = rest * SCALE_STEP
        out = out * SCALE_STEP + rest // whole
        rest = rest % whole
    return out + 1


def _figures(top: int):
    def of_shard(counts: pa.Table, groups: pa.Table) -> pa.Table:
        """Partial sums for each pair of sources, and the shard's leading terms of each source."""
        sources = groups["source"].combine_chunks()
        sources = pc.take(sources, pc.sort_indices(sources))
        groups = groups.take(pc.sort_indices(groups["source"]))
        terms = pc.unique(counts["term"])
        terms = pc.take(terms, pc.sort_indices(terms))
        n = np.zeros((len(sources), len(terms)), np.int64)
        at = [pc.index_in(counts[c], value_set=v).to_numpy().astype(np.int64) for c, v in (("source", sources), ("term", terms))]
        n[at[0], at[1]] = counts["n"].to_numpy()
        total, of_lang, v = (groups[c].to_numpy() for c in ("total", "lang_total", "v"))
        p = shares(n, total[:, None], v[:, None])
        q = shares(n.sum(axis=0), of_lang[0], v[0])
        one, other, value, leading = [], [], [], []
        for i in range(len(sources)):
            apart = np.abs(p[i + 1 :] - p[i]).sum(axis=1)
            one.append(np.full(len(apart), i))
            other.append(np.arange(i + 1, len(sources)))
            value.append(apart)
            own = np.flatnonzero((n[i] > 0) & (p[i] > q))
            own = own[np.lexsort((own, q[own] - p[i][own]))[:top]]
            leading.append((i, own, (p[i] - q)[own]))
        one, other = np.concatenate(one), np.concatenate(other)
        of = np.concatenate([np.full(len(own), i) for i, own, _ in leading])
        item = pa.concat_arrays([pc.take(sources, pa.array(other)), pc.take(terms, pa.array(np.concatenate([x[1] for x in leading])))])
        rows = len(one) + len(of)
        lang = pa.array([groups["lang"][0].as_py()]).take(pa.array(np.zeros(rows, np.int64)))
        part = pa.array(["pair"] * len(one) + ["term"] * len(of), pa.string())
        return pa.table({"lang": lang, "source": pc.take(sources, pa.array(np.concatenate([one, of]))), "part": part, "item": item, "value": np.concatenate([*value, *(x[2] for x in leading)])})

    return of_shard


def source_divergence(
    docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 30, top: int = 50
) -> DataFrame:
    """lang, source, part, item, value, rank: what sets each source of a language apart.

    Part `pair` has a row for each other source of the language: the sum over all kept terms of the
    absolute difference of both shares.  Part `term` has the at most `top` terms of the source whose
    share exceeds that of the whole language by most.  Ranks start at 1 by value, ties by item in
    UTF-8 order.  A term is kept in a language if at least min_docs rows of it hold the term.

    Null text, language and source are empty ones.  Each row of docs is a document, whatever its id.
    A group without terms takes part with counts of 0; a language without kept terms gives pairs of
    value 0 and no terms; one of a single source gives terms alone, if any.  An empty table gives an
    empty result.  Other columns of docs, whatever their names, are not read.
    """
    docs = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    partial = docs.mapInArrow(_counted, COUNTS)
    # One shuffle by term: sums by source, and then documents over all sources, are both where the term is.
    by_source = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    everywhere = by_source.withColumn("in_docs", F.sum("docs").over(Window.partitionBy("lang", "term")))
    kept = written(everywhere.where(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n"))

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang").agg(F.countDistinct("term").alias("v"), F.sum("n").alias("lang_total"))
    groups = docs.select("lang", "source").distinct()
    sources = F.count(F.lit(1)).over(Window.partitionBy("lang"))
    groups = groups.join(totals, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    a_shard = F.greatest(F.lit(1), F.least(F.lit(MOST_TERMS), F.floor(F.lit(CELLS) / sources)))
    groups = written(groups.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("v") / a_shard)).cast("int")))
    of_lang = small(groups.select("lang", "shards").distinct())
    dealt = kept.join(of_lang, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int")).select("lang", "shard", "source", "term", "n")
    seats = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select("lang", "shard", "source", "total", "lang_total", "v")
    figures = dealt.groupBy("lang", "shard").cogroup(seats.groupBy("lang", "shard")).applyInArrow(_figures(top), FIGURES)
    summed = figures.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # A shard gives each pair once; the other way round it has the same value.
    turned = F.when(F.col("part") == "pair", F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).otherwise(F.array(F.struct("source", "item")))
    both = summed.select("lang", "part", "value", F.explode(turned).alias("to")).select("lang", "to.source", "part", "to.item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = both.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
