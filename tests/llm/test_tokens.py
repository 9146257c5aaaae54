import itertools
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

from seismark.llm import sentencepiece_lattice as sp
from seismark.llm.piece_model import UNIGRAM, PieceModel, load
from seismark.llm.token_counts import token_counts
from tests.conftest import TINY
from tests.llm import cases

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["a▁ b▁▁c ▁d", "\n\nx\n y", " lead", "trail ", "<s> </s> <0x0A> <unk>", "a " * 30, "▁", "\t\r\n", "abcXYZ" * 40, "é́​﻿"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def docs(spark):
    more = spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    return spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").unionByName(more).unionByName(cases.docs(spark).select("doc_id", "text"))


def test_counts(spark, docs, library):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, PATH).collect())
    want = Counter()
    for r in docs.collect():
        n = len(library.encode(r.text or ""))
        want[r.doc_id, len((r.text or "").encode()), n, n > 4096] += 1
    assert got == want
    assert token_counts(cases.empty(spark), PATH).count() == 0
    with pytest.raises(ValueError):
        token_counts(docs, "words.json")


def test_counts_without_frequent_words(spark, docs, library, monkeypatch):
    from seismark.llm import token_counts as module

    monkeypatch.setattr(module, "HEAD", 1)
    monkeypatch.setattr(module.frequent, "__defaults__", (1,))
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts(docs, PATH).collect())
    assert got == Counter((r.doc_id, len(library.encode(r.text or ""))) for r in docs.collect())


@pytest.mark.parametrize("head", [1 << 17, 1])
def test_ids_and_round_trip(docs, library, head):
    """With a head of one word, all words are folded where they stand."""
    rows = sp.decode(sp.encode(docs, PATH, check_col="same", head=head), PATH).collect()
    for r in rows:
        assert r.ids == library.encode(r.text or "")
        assert r.decoded == (r.text or "").replace("▁", " ") and r.same


def test_clashing_columns_and_empty(spark):
    out = sp.decode(sp.encode(cases.docs(spark), PATH), PATH)
    assert out.columns == [c for c in cases.docs(spark).columns if c != "ids"] + ["ids", "decoded"] and out.count() == len(cases.ROWS)
    assert sp.encode(cases.empty(spark), PATH).count() == 0


def cuts(word):
    for k in range(len(word)):
        for at in itertools.combinations(range(1, len(word)), k):
            yield [word[a:b] for a, b in zip((0, *at), (*at, len(word)))]


def test_viterbi(spark):
    """A unigram model: the relational fold and the one in numpy give the best of all cuts."""
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "c": -4.0, "ab": -3.1, "abc": -5.0, "▁a": -2.2, "▁ab": -4.4, "ca": -3.3, "bca": -4.1}
    model = PieceModel("", UNIGRAM, {p: (i + 1, s) for i, (p, s) in enumerate(scores.items())}, None, 0)
    words = ["▁" + "".join(w) for n in range(1, 6) for w in itertools.product("abcx", repeat=n)][::7]
    lone = min(scores.values()) - sp.UNKNOWN_PENALTY
    value = lambda cut: sum(scores.get(p, lone if len(p) == 1 else -1e9) for p in cut)
    got = {r.word: r.ids for r in sp.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), model).collect()}
    fold = sp.WordFold(model)
    ids = {i: p for p, (i, _) in model.pieces.items()}
    for w in words:
        best = max(map(value, cuts(w)))
        for found in (got[w], fold.best_cut(w)):
            assert len(found) and abs(sum(scores[ids[i]] if i else lone for i in found) - best) < 1e-9


def test_lattice_words(spark, library):
    words = ["▁" + w for w in "merchantability unbelievable don't 12345 naïve 你好x 😀 e.g. ABCabc xyzzy".split()] + ["\n", "▁▁▁▁", "Then"]
    got = {r.word: r.ids for r in sp.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), load(PATH)).collect()}
    fold = dict(zip(words, sp.WordFold(load(PATH))([w.replace("▁", " ") for w in words]).to_pylist()))
    for w in words:
        want = library.encode(w[1:]) if w[0] == "▁" else library.encode("\n" + w)[2:]
        assert got[w] == want == fold[w]
        assert sp.WordFold(load(PATH)).merge_long(w) == want
