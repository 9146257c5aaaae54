"""The mean of the others comes from sums by key, and tasks grow in number with the rows."""

from seismark.functions import tables
from seismark.operators import stats
from seismark.plans import adapters
from tests.conftest import TINY


def test_means_without_a_window(spark):
    rows = [(1, "a", 2.0), (2, "a", 4.0), (3, "a", None), (4, "b", 7.0), (5, None, 1.0), (6, None, 3.0)]
    out = stats.leave_one_out_mean(spark.createDataFrame(rows, "id long, s string, x double"), ["s"], "x")
    assert {r.id: r.others for r in out.collect()} == {1: 4.0, 2: 2.0, 3: None, 4: None, 5: 3.0, 6: 1.0}
    assert out.columns == ["id", "s", "x", "others"] and "Window" not in out._jdf.queryExecution().toString()


def test_tasks_by_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    seen = adapters.observations(spark, TINY)
    n = spark.read.parquet(f"{TINY}/lineitem.parquet").count()
    assert "REPARTITION_BY_NUM" in seen._jdf.queryExecution().toString() and tables.tasks_for(seen) >= n // 500 > 4
