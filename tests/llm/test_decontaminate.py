import pytest

from seismark.llm import decontaminate as d
from seismark.llm import queries
from tests.conftest import TINY, canonical
from tests.llm import cases

ITEMS = [(1, "A b c d e f g h i j k"), (2, "short Item"), (3, None), (4, "!!"), (5, "größe naïve 你好"), (None, "one two three")]


def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_matches_sql(spark, oracle):
    assert canonical(queries.op10_decontamination(spark, TINY).toPandas()) == oracle(queries.OP10)


@pytest.mark.parametrize("block", [200_000, 1])
def test_blocks(spark, block):
    """One window a block takes a scan each and gives the same."""
    rows = d.report(d.contamination(cases.docs(spark), bench(spark), block_windows=block)).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items) for r in rows)
    words = {None: 0}
    want = []
    for i, t in cases.ROWS:
        hit = {7: (11, 1), 12: (11, 1), 10: (3, 1)}.get(i, (0, 0))
        n = {1: 0, 2: 0, 3: 0, 4: 1, 5: 3, 6: 3, 7: 13, 12: 13, 8: 30_000, 9: 30_000, 10: 6, 11: 1}.get(i, 5 if t else 0)
        want.append((str(i), n, *hit))
    assert got == sorted(want) and words


def test_remove(spark):
    docs, kept = cases.docs(spark), None
    kept = d.decontaminate(docs, bench(spark))
    assert kept.columns == docs.columns and kept.count() == len(cases.ROWS) - 4
    cut = {r.doc_id: r.text for r in d.decontaminate(docs, bench(spark), remove="spans").collect() if r.doc_id}
    assert cut[7] == " l m" and cut[10] == "über  😀 end" and cut[8] == cases.LONG
    many = {r.doc_id: r.text for r in d.decontaminate(docs, bench(spark), remove="spans", block_windows=2).collect() if r.doc_id}
    assert many[7] == " l m"
    assert d.decontaminate(cases.empty(spark), bench(spark)).count() == 0
    assert d.decontaminate(docs, bench(spark).limit(0)).count() == len(cases.ROWS)
    assert d.contamination(docs, bench(spark).limit(0)).count() == len(cases.ROWS)
