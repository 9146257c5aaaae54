"""A SentencePiece model as a table of pieces, and the split of texts into pre-tokens that no piece crosses."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from seismark.llm.text_arrays import buffers

META = "▁"
BPE, UNIGRAM = 2, 1


@dataclass
class PieceModel:
    path: str
    kind: int
    #: piece -> (id, score), the pieces that text can be cut into
    pieces: dict[str, tuple[int, float]] = field(repr=False)
    #: id of the piece for each byte value, or None without byte fallback
    byte_ids: list[int] | None = field(repr=False)
    unk_id: int = 0
    #: every piece by id, as the bytes it decodes to
    decoded: list[bytes] = field(default_factory=list, repr=False)

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces))


def load(path: str) -> PieceModel:
    """The model in a .model file.  Its normaliser must leave text alone but for the dummy prefix, as it does in byte-fallback models."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm, train = proto.normalizer_spec, proto.trainer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: the model changes text before it cuts it")
    normal, user, byte = 1, 4, 6
    pieces = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == normal}
    if any(p.type == user for p in proto.pieces) or any("\n" in p or META in p.lstrip(META) for p in pieces):
        raise ValueError(f"{path}: a piece crosses the start of a word")
    byte_ids = [i for i, p in enumerate(proto.pieces) if p.type == byte] if train.byte_fallback else None
    value = {i: v for v, i in enumerate(byte_ids or [])}
    decoded = [bytes([value[i]]) if i in value else p.piece.replace(META, " ").encode() if p.type == normal else b" \xe2\x81\x87 " if p.type == 2 else b"" for i, p in enumerate(proto.pieces)]
    return PieceModel(path, train.model_type, pieces, byte_ids, next(i for i, p in enumerate(proto.pieces) if p.type == 2), decoded)


def pretokens(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Pre-tokens of all texts, each with the dummy space before it, and the first pre-token of each text and the number of all.

    A pre-token starts at a space (or U+2581, which the model takes for one) behind another
    character, at the first of a run of line feeds, and behind such a run.
    """
    texts = texts.fill_null("")
    spaced = pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar(" ", texts.type))
    spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", texts.type), spaced)
    data, offsets = buffers(spaced)
    space, line = data == 0x20, data == 0x0A
    meta = np.zeros(len(data), bool)
    meta[2:] = (data[2:] == 0x81) & (data[1:-1] == 0x96) & (data[:-2] == 0xE2)
    blank = space | meta
    start = np.zeros(len(data), bool)
    start[1:] = (space[1:] & ~blank[:-1]) | (line[1:] != line[:-1])
    full = offsets[1:] > offsets[:-1]
    start[offsets[:-1][full]] = True
    at = np.flatnonzero(start)
    cuts = np.concatenate([at, [len(data)]])
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)) if len(data) < 1 << 31 else pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
    return words.dictionary_encode(), np.searchsorted(at, offsets)


def slices(texts: pa.Array, limit: int = 16 << 20):
    """(start, texts) slices of about `limit` bytes; a longer text is a slice of its own."""
    _, offsets = buffers(texts)
    first, n = 0, len(texts)
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, texts.slice(first, last - first)
        first = last
