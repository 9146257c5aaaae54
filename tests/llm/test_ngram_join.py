import random
import re

import pytest

from seismark.llm import ngram_join as join
from seismark.llm import queries
from seismark.llm.components import components
from tests.conftest import TINY, canonical
from tests.llm import cases


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def corpus(seed, n=220):
    """Families of near copies in chains, texts that share a passage, short and long ones."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopq") + str(rng.randrange(60))
    passage = [word() for _ in range(60)]
    out = []
    for family in range(n // 11):
        base = [word() for _ in range(rng.choice([3, 6, 12, 40, 150, 700]))]
        if family % 3 == 0:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(11):
            out.append(" ".join(base))
            base = list(base)
            for _ in range(max(1, len(base) // 45)):
                base[rng.randrange(len(base))] = word()
    rng.shuffle(out)
    return list(enumerate(out))


def test_matches_sql(spark, oracle):
    assert canonical(queries.op5_ngram_join(spark, TINY).toPandas()) == oracle(queries.OP5)


@pytest.mark.parametrize(("seed", "k", "percent", "tile"), [(1, 4, 85, 20_000), (2, 5, 80, 6), (3, 1, 50, 20_000)])
def test_brute_force(spark, monkeypatch, seed, k, percent, tile):
    """Small tiles split common shingles into blocks; no link is lost."""
    monkeypatch.setattr(join, "TILE_ROWS", tile)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = join.ngram_join(docs, words=k, percent=percent).collect()
    assert sorted(map(tuple, found)) == brute(rows, k, percent)


def test_without_first_comparisons(spark, monkeypatch):
    """Min-hash keys only save work: without them the tiles find every link."""
    monkeypatch.setattr(join, "BANDS", 0)
    monkeypatch.setattr(join, "_INDEX", "id long, n long, set1 long, set2 long, prefix array<long>, bitmap binary, wide binary")
    rows = corpus(4, 120)
    found = join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == brute(rows, 4, 85)


def test_cases(spark):
    found = join.ngram_join(cases.docs(spark)).collect()
    assert len(found) == len(cases.ROWS)
    want = {i: (n, c) for i, n, c in brute(cases.ROWS, 4, 85)}
    for r in found:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] if r.doc_id is not None else r.component_id is None
    assert join.ngram_join(cases.empty(spark)).count() == 0
    kept = join.one_of_each(cases.docs(spark))
    assert kept.columns == cases.docs(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "7", "7", "None", "None", "8", "10", "11"])
    with pytest.raises(ValueError):
        join.ngram_join(cases.docs(spark), percent=100)


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5100)] + [(None, 3), (4, 4)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
