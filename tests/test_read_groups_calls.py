"""Many short lists of windows share calls of Python."""

import inspect
import os
import uuid

from seismark.operators import chunks


def test_few_calls(spark, tmp_path, monkeypatch):
    made, folder = chunks._next_windows, str(tmp_path)

    def counted(span):
        run = made(span)

        def of(*args):
            open(os.path.join(folder, uuid.uuid4().hex), "w").close()
            return run(*args)

        return of if len(inspect.signature(run).parameters) != 1 else lambda rows: of(rows)

    monkeypatch.setattr(chunks, "_next_windows", counted)
    rows = [(3 * k + i, k, 100.0 * i + k % 7, 100.0 * i + k % 7 + 5) for k in range(300) for i in range(3)]
    got = {r.id: r.groupStart for r in chunks.read_groups(spark.createDataFrame(rows, "id long, stationId long, start double, stop double"), 120.0).collect()}
    assert got == {i: (s if i % 3 != 1 else rows[i - 1][2]) for i, _, s, _ in rows}
    assert len(os.listdir(folder)) == 1
