"""What several corpus operators need: the shared folder, tables written there, and bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it has at most this many rows of a few fixed-width columns.
BROADCAST_ROWS = 250_000

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a local one only where it is unset, as in tests."""
    global _own_folder
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="spark-shared-")
    return _own_folder


_open_scopes: list[list[str]] = []


def written(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read back: its lineage ends there, and a lost executor loses none of it.

    The table stays until the folder is cleared, or the `scratch` that it was written in ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    if _open_scopes:
        _open_scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that `written` makes inside it at its end: results must have been written elsewhere by then."""
    _open_scopes.append([])
    try:
        yield
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs
        for path in _open_scopes.pop():
            at = hadoop.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def outside() -> Iterator[None]:
    """What `written` makes inside it belongs to no `scratch`."""
    scopes, _open_scopes[:] = list(_open_scopes), []
    try:
        yield
    finally:
        _open_scopes[:] = scopes


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows, or BROADCAST_ROWS (it should be a written table: it is counted)."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if rows is None else rows) else df


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Texts reach Python in batches of that size at most, unless the session asks for another."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # the default
        spark.conf.set(key, size)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
