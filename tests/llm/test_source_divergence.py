from collections import Counter, defaultdict

import pytest

from seismark.llm import queries
from seismark.llm import source_divergence as audit
from seismark.llm.source_divergence import source_divergence
from tests.conftest import TINY, canonical
from tests.llm import cases


def words(text):
    """Plain loops: letters and what is beyond ASCII; only A-Z become lower case."""
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalpha():
            out, word = out + [word] * bool(word), ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def brute(docs, min_docs, top):
    """docs: (lang, source, text)."""
    counts, seen, groups = defaultdict(Counter), Counter(), set()
    for lang, source, text in docs:
        lang, source, w = lang or "", source or "", words(text)
        groups.add((lang, source))
        counts[lang, source].update(w)
        seen.update((lang, x) for x in set(w))
    rows = set()
    for lang in {x for x, _ in groups}:
        kept = [t for (x, t), n in seen.items() if x == lang and n >= min_docs]
        v, sources = len(kept), [s for x, s in groups if x == lang]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        share = lambda n, all_: 1 + 10**9 * (n + 5) // (all_ + 5 * v)
        p = {s: {t: share(counts[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                rows |= {(lang, s, part, item, -f, i) for i, (f, _, item) in enumerate(found, 1)}
    return rows


def test_matches_sql(spark, oracle):
    assert canonical(queries.op11_source_divergence(spark, TINY).toPandas()) == oracle(queries.OP11)


ROWS = [
    ("en", "a", "One one two, THREE-four"), ("en", "b", "one two two"), ("en", "c", None), (None, None, "one Ünï ünï"), (None, "x", "Ünï 你好 one"), ("en", "a", "one"), ("en", None, "two\x00two _ 12 3"),
    ("de", "only", "eins zwei eins"), ("de", "only", "eins"), ("xx", "a", ""), ("xx", "b", "  "), ("en", "b", "tie tia tib " * 3), ("en", "b", "tie tia tib"), ("en", "a", "one " * 5000), ("en", "a", "a" * 100_000), ("EN", "a", "one"),
]


@pytest.mark.parametrize(("min_docs", "top", "terms", "held"), [(1, 50, 4096, 400_000), (2, 2, 4096, 400_000), (1, 1, 2, 3)])
def test_cases(spark, monkeypatch, min_docs, top, terms, held):
    """Shards of few terms and tasks that hand counts on early change nothing."""
    monkeypatch.setattr(audit, "CELLS", 2 * 4 if terms == 2 else 1 << 22)
    monkeypatch.setattr(audit, "MOST_TERMS", terms)
    monkeypatch.setattr(audit, "HELD_ROWS", held)
    docs = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in ROWS], "lang string, source string, text string, term string, n string, value string")
    got = [tuple(r) for r in source_divergence(docs, min_docs=min_docs, top=top).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(ROWS, min_docs, top)


def test_common_cases(spark):
    docs = cases.docs(spark).selectExpr("*", "'en' AS lang", "if(doc_id % 2 = 0, 'a', 'b') AS source")
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    assert {tuple(r) for r in source_divergence(docs, min_docs=2).collect()} == brute(rows, 2, 50)
    assert source_divergence(cases.empty(spark).selectExpr("*", "'en' AS lang", "'a' AS source")).count() == 0


def test_shares():
    import numpy as np

    n = np.array([0, 1, 10**14, 10**15])
    assert list(audit.shares(n, np.int64(10**15), np.int64(1000))) == [1 + 10**9 * (int(x) + 5) // (10**15 + 5000) for x in n]
