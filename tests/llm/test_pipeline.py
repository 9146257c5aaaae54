import re

import corpus_pipeline
from seismark.llm import toxicity
from tests.llm.test_exact_dedup import sha
from tests.llm.test_ngram_join import brute
from tests.conftest import TINY


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{TINY}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "decontamination", "sentencepiece"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.toxicity_scores(docs, labels).collect():
        if r.predicted:
            del rows[r.doc_id]
    first = {}
    for i in sorted(rows):
        first.setdefault(sha(rows[i]), i)
    rows = {i: rows[i] for i in first.values()}
    rows = {i: rows[i] for i, _, c in brute(sorted(rows.items()), 5, 80) if i == c}
    grams = set()
    for r in bench.collect():
        w = words(r.text)
        k = min(10, len(w))
        grams |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    sizes = {len(g) for g in grams}
    rows = {i: t for i, t in rows.items() if not any(tuple(w[j : j + k]) in grams for w in [words(t)] for k in sizes for j in range(len(w) - k + 1))}
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, TINY).collect()}
    assert got.keys() == rows.keys()
    assert all(r.ids == library.encode(rows[i]) and r.n_ids == len(r.ids) and r.round_trip for i, r in got.items())


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, TINY).columns == docs.columns
