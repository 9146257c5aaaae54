import hashlib
import re
from collections import defaultdict

import pytest

from seismark.llm import exact_dedup as dedup
from seismark.llm import queries, shared
from seismark.llm.exact_dedup import exact_dedup, keep_first
from tests.conftest import TINY, canonical
from tests.llm import cases


def sha(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def test_matches_sql(spark, oracle):
    assert canonical(queries.op7_exact_dedup(spark, TINY).toPandas()) == oracle(queries.OP7)


@pytest.mark.parametrize(("bits", "broadcast"), [(16, 250_000), (1, 250_000), (1, 0)])
def test_cases(spark, monkeypatch, bits, broadcast):
    """With one bit a row nearly every row is suspected; with no broadcast groups are dealt out; results stay the same."""
    monkeypatch.setattr(shared, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(dedup, "GROUP_ROWS", 1)
    rows = exact_dedup(cases.docs(spark), bits_per_row=bits).collect()
    groups = defaultdict(list)
    for i, t in cases.ROWS:
        groups[sha(t)].append(i)
    assert sorted((str(r.doc_id), r.text_sha256) for r in rows) == sorted((str(i), sha(t)) for i, t in cases.ROWS)
    for h, ids in groups.items():
        own = [r for r in rows if r.text_sha256 == h]
        least = min((i for i in ids if i is not None), default=None)
        assert {r.group_size for r in own} == {len(ids)} and {r.keep_id for r in own} == {least}
        assert [r.doc_id for r in own if r.kept] == [least]


def test_keep_first(spark):
    kept = keep_first(cases.docs(spark))
    assert kept.columns == cases.docs(spark).columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(["1", "3", "4", "5", "6", "7", "None", "8", "10", "11"])
    assert keep_first(cases.empty(spark)).count() == 0 and exact_dedup(cases.empty(spark)).count() == 0


def test_column_names(spark):
    """An id column of any name, also one that the operator uses itself, and ids that are text."""
    for name in ("id", "keep_id", "row"):
        docs = cases.docs(spark).drop(name).withColumnRenamed("doc_id", name)
        assert keep_first(docs, id_col=name).count() == 10
    texts = spark.createDataFrame([("b", "x  y"), ("a", "x y"), ("c", "z")], "doc_id string, text string")
    assert sorted(r.doc_id for r in keep_first(texts).collect()) == ["a", "c"]


def test_a_hot_group(spark, monkeypatch):
    """Rows that repeat an id and a text: one of them stays."""
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    rows = exact_dedup(spark.range(3000).selectExpr("cast(7 as bigint) as doc_id", "if(id % 3 = 0, 'other', 'same') as text")).collect()
    assert len(rows) == 3000 and sum(r.kept for r in rows) == 2 and {r.group_size for r in rows} == {1000, 2000}
