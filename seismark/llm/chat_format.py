"""Chat formatting by columnar byte assembly, and reading the result back.

Turns are dealt out by ranges of (conversation, turn), so that a very long conversation is split
over tasks.  A task takes the turns of a batch as columns: it escapes roles and texts, computes the
length of every segment, their cumulative offsets and the source of every byte of the result, and
copies headers and contents into one buffer that the output column uses as it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seismark.llm.text_arrays import buffers


@dataclass(frozen=True)
class ChatTemplate:
    """Turns are open + role + middle + text + close.  Strings of `controls` are escaped inside roles and texts.

    Escaping puts a backslash behind the first character of a control string, one more than stand
    there already, so that it can be taken back exactly.  In roles, line feeds and backslashes are
    escaped too.
    """

    open: str = "<|im_start|>"
    middle: str = "\n"
    close: str = "<|im_end|>\n"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    #: roles whose texts are under the loss mask
    learnt: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if self.open not in self.controls or self.close.rstrip("\n") not in self.controls or any(len(c) < 2 for c in self.controls):
            raise ValueError("the marks of turns are control strings, of two characters at least")
        for a in self.controls:
            for b in self.controls:
                if any(a.endswith(b[:k]) for k in range(1, len(b)) if (a, len(a)) != (b, k)):
                    raise ValueError(f"the end of {a} begins {b}")

    def _pattern(self, escaped: str) -> str:
        first = "|".join(sorted({re.escape(c[0]) for c in self.controls}))
        rest = "|".join(re.escape(c[1:]) for c in sorted(self.controls, key=len, reverse=True))
        return rf"({first}){escaped}(\\*)({rest})"

    def escape(self, texts: pa.Array) -> pa.Array:
        return pc.replace_substring_regex(texts, self._pattern(""), r"\1\\\2\3")

    def escape_roles(self, roles: pa.Array) -> pa.Array:
        return self.escape(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))

    def unescape(self, text: str) -> str:
        return re.sub(self._pattern(r"\\"), r"\1\2\3", text)

    def unescape_role(self, role: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(role), flags=re.DOTALL)

    def turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn, unescaped."""
        for m in re.finditer(f"{re.escape(self.open)}(.*?){re.escape(self.middle)}(.*?){re.escape(self.close)}", formatted, re.DOTALL):
            yield self.unescape_role(m[1]), self.unescape(m[2])


def assemble(segments: list[pa.Array | str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all rows, each the segments in order; where each segment of each row starts in them; and the rows' offsets."""
    sources, starts, sizes, base = [], np.zeros((n, len(segments)), np.int64), np.zeros((n, len(segments)), np.int64), 0
    for j, s in enumerate(segments):
        if isinstance(s, str):
            data = np.frombuffer(s.encode(), np.uint8)
            starts[:, j], sizes[:, j] = base, len(data)
        else:
            data, offsets = buffers(s)
            starts[:, j], sizes[:, j] = base + offsets[:-1], np.diff(offsets)
        sources.append(data)
        base += len(data)
    ends = np.cumsum(sizes.ravel())
    places = np.concatenate([[0], ends])[:-1]
    total = int(ends[-1]) if n else 0
    out = np.empty(total, np.uint8)
    np.take(np.concatenate(sources), np.arange(total) + np.repeat(starts.ravel() - places, sizes.ravel()), out=out)
    return out, places.reshape(n, len(segments)), np.concatenate([[0], ends[len(segments) - 1 :: len(segments)]])


SPANS = "array<struct<start:long,length:long>>"


def _pieces(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of about `limit` bytes of text."""
    sizes = np.cumsum(pc.binary_length(batch.column(2).fill_null("")).fill_null(0).to_numpy())
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + limit, "right"))
        last = min(batch.num_rows, max(last, first + 1))
        yield batch.slice(first, last - first)
        first = last


def format_conversations(turns: DataFrame, template: ChatTemplate = ChatTemplate(), *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, n_turns, formatted, loss_spans): formatted conversations, long ones in several parts.

    The parts of a conversation, in the order of `part`, joined without anything between, are its
    whole text.  loss_spans are the code points of the part's texts that are learnt.  Turns come in
    the order of turn (null first), then role, then text.  A null text or role is empty; turns with
    a null conversation make one conversation of their own; repeated rows are repeated turns; other
    columns are not read; an empty table gives an empty result.
    """
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.col(f"`{turn_col}`").alias("turn"))
    rows = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in _pieces(whole, 4 << 20):
                n = batch.num_rows
                roles, texts = template.escape_roles(batch.column(1)), template.escape(batch.column(2))
                out, places, offsets = assemble([template.open, roles, template.middle, texts, template.close], n)
                conv = batch.column(0)
                new = np.ones(n, bool)
                if n > 1:
                    a, b = conv.slice(1), conv.slice(0, n - 1)
                    same = pc.or_kleene(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
                    new[1:] = ~same.to_numpy(zero_copy_only=False)
                first = np.flatnonzero(new)
                cuts = np.append(first, n)
                points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
                learnt = np.flatnonzero(pc.is_in(batch.column(1), value_set=pa.array(template.learnt)).to_numpy(zero_copy_only=False))
                begin, end = points[places[learnt, 3]], points[places[learnt, 4]]
                start = points[offsets[cuts]]
                owner = np.searchsorted(first, learnt, "right") - 1
                spans = pa.StructArray.from_arrays([pa.array(begin - start[owner]), pa.array(end - begin)], ["start", "length"])
                yield pa.RecordBatch.from_arrays(
                    [
                        conv.take(pa.array(first)), pa.array(part + np.arange(len(first))), pa.array(np.diff(cuts)),
                        pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets[cuts].astype(np.int32)), pa.py_buffer(out)),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(first) + 1)), pa.int32()), spans),
                    ],
                    ["conv_id", "part", "n_turns", "formatted", "loss_spans"],
                )
                part += len(first)

    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(formatted, f"conv_id {kind}, part long, n_turns long, formatted string, loss_spans {SPANS}")


def read_back(parts: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Digests of each conversation, from its formatted parts alone.

    Parts are read where they are; then the bytes to be hashed meet by conversation and stream
    through its hashes in order, one part at a time.
    """
    kind = parts.schema["conv_id"].dataType.simpleString()

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, turns, learnt, chars = [], [], [], []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found = list(template.turns(text))
                counts.append(len(found))
                turns.append("".join(f"{role}\n{said}\n" for role, said in found))
                learnt.append("".join(template.unescape(text[s["start"] : s["start"] + s["length"]]) for s in spans))
                chars.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(turns, pa.string()), pa.array(learnt, pa.string()), pa.array(chars, pa.int64())], ["conv_id", "part", "n", "turns", "learnt", "chars"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        out: list[tuple] = []

        def close() -> None:
            if state is not None:
                out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 6
            out.clear()
            types = [types_of, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        types_of = None
        for batch in batches:
            types_of = batch.column(0).type
            for conv, n, turns, learnt, chars in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += n
                state[1].update(turns.encode())
                state[2] += len(learnt)
                state[3].update(learnt.encode())
                state[4] += chars
            if out:
                yield flush()
        close()
        if out:
            yield flush()

    read = parts.select("conv_id", "part", "formatted", "loss_spans").mapInArrow(parsed, f"conv_id {kind}, part long, n long, turns string, learnt string, chars long")
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(hashed, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
