"""Tables that must be computed once, and ranks over whole tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where it is unset and the master is local."""
    global _own_folder
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="spark-shared-")
    return _own_folder


def materialised(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: reruns after a lost executor start from there."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A side is broadcast only when it has at most this many rows of a few columns.
BROADCAST_ROWS = 250_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if a count finds at most that many rows; beyond that the same join shuffles."""
    return F.broadcast(df) if df.limit((BROADCAST_ROWS if rows is None else rows) + 1).count() <= (BROADCAST_ROWS if rows is None else rows) else df


#: Rows that one task of a join or an aggregate over whole tables should have.
TASK_ROWS = 500_000


def tasks_for(df: DataFrame, rows: int | None = None) -> int:
    """Tasks to deal df out to, so that one's memory doesn't grow with the table: the session's number or more."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, -(-df.count() // (TASK_ROWS if rows is None else rows)))


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """df with its place in a total order, from 1, without bringing all rows to one task.

    Rows are dealt out by ranges of the order and sorted inside each; the only table that every task
    gets has one row a partition.  `order` must end in a unique key for a deterministic result.
    """
    place = F.monotonically_increasing_id()
    sorted_ = materialised(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place))
    part = F.shiftright("_place", 33)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size")).collect()
    total, before = 0, {}
    for row in sorted(sizes):
        before[row["_part"]] = total
        total += row["_size"]
    if not before:
        return sorted_.withColumn(name, F.lit(None).cast("long")).drop("_place")
    starts = F.broadcast(df.sparkSession.createDataFrame(sorted(before.items()), "_part long, _before long"))
    joined = sorted_.withColumn("_part", part).join(starts, "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_place", "_part", "_before")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
