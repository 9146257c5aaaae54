"""The engine's logical tables from the given ones, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seismark.functions.tables import table, tasks_for

#: 2024-01-01 and 30 days later, in epoch seconds.
T0, T1 = 1704067200.0, 1706659200.0


def epoch(c: str) -> Column:
    """Epoch seconds of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})") / F.lit(1e6)


def _east(c: str) -> Column:
    return (F.pmod(F.col(c) * 7919, F.lit(20001)) - 10000).cast("double")


def _north(c: str) -> Column:
    return (F.pmod(F.col(c) * 104729, F.lit(20001)) - 10000).cast("double")


def picks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type <> 'error'")
    w = F.pmod(F.col("event_id") * 37, F.lit(101))
    phase = F.when(F.col("event_type").isin("click", "view"), "P").otherwise("S")
    t = epoch("ts")
    return e.select("event_id", F.concat(F.lit("ev:"), F.col("event_id").cast("string")).alias("id"), F.col("user_id").alias("stationId"), phase.alias("phase"), t.alias("t"), w.alias("w"), (w.cast("double") / 100.0).alias("prob"), F.floor(t / 3600).alias("eventId"), "value")


def stations(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select(F.col("user_id").alias("c_custkey")).distinct()
    c = table(spark, d, "customer").join(users, "c_custkey", "left_semi")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("stationId"), _east("c_custkey").alias("e"), _north("c_custkey").alias("n"), (F.lit(1600) + F.pmod(F.col("c_custkey") * 31, F.lit(300))).cast("double").alias("elevM"), (F.col("c_acctbal") > 0).alias("usedInRun"))


def catalog(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'error'")
    return e.select(F.col("event_id").alias("catalogId"), epoch("ts").alias("t"), _east("user_id").alias("e"), _north("user_id").alias("n"), (F.col("value") / 100).alias("mag"), F.when(F.col("event_id") % 2 == 0, "ml").otherwise("md").alias("magType"))


def located(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'signup'")
    i = F.col("event_id")
    return e.select(
        i.alias("eventId"), epoch("ts").alias("t"), _east("user_id").alias("e"), _north("user_id").alias("n"), F.col("value"),
        (F.pmod(i * 13, F.lit(997)) / 10000.0).alias("rmsS"), F.pmod(i * 29, F.lit(361)).cast("double").alias("gapDeg"), (F.lit(4) + F.pmod(i * 7, F.lit(17))).cast("double").alias("nStations"),
        F.when(F.pmod(i, F.lit(17)) != 0, F.pmod(i * 53, F.lit(1009)).cast("double")).alias("hErrM"), (F.pmod(i, F.lit(23)) == 0).alias("depthOnEdge"),
        F.pmod(i * 11, F.lit(5000)).cast("double").alias("minEpiDistM"), (F.lit(500) + F.pmod(i * 19, F.lit(3000))).cast("double").alias("focalDepthM"),
        F.when(F.pmod(i, F.lit(3)) == 0, i * 2).alias("catalogId"), F.when(F.pmod(i, F.lit(2)) == 0, "full").otherwise("p_only").alias("profile"), F.when(F.pmod(F.floor(i / 2), F.lit(2)) == 0, "net").otherwise("classic").alias("method"),
    )


def segments(spark: SparkSession, d: str) -> DataFrame:
    t = epoch("ts")
    return table(spark, d, "events").select(F.col("user_id").alias("stationId"), F.col("event_type").alias("channel"), t.alias("start"), (t + F.col("value") * 600).alias("stop"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_quantity")  # noqa: E741
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    n = tasks_for(l)
    return l.repartition(n, "l_orderkey").join(o.repartition(n, "l_orderkey"), "l_orderkey").select(F.col("l_orderkey").alias("eventId"), F.col("l_suppkey").alias("stationId"), F.log10("l_extendedprice").alias("logA"), F.log10("l_quantity").alias("logR"), F.log10("o_totalprice").alias("mag"))


def surveys(spark: SparkSession, d: str) -> DataFrame:
    """A survey station for each order line, 25 m apart."""
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.select(F.col("l_orderkey").alias("well"), (F.col("l_linenumber") * 25.0).alias("md"), (F.col("l_discount") * 900).alias("inc"), F.pmod("l_partkey", F.lit(360)).cast("double").alias("azi"), F.col("l_suppkey").alias("tool")).groupBy("well", "md").agg(F.min("inc").alias("inc"), F.min("azi").alias("azi"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("segmentId"), F.col("embedding").cast("array<double>").alias("samples"))


#: The same tables for the oracle.
SQL = r"""
picks AS (
  SELECT event_id, 'ev:' || event_id AS id, user_id AS stationId, CASE WHEN event_type IN ('click', 'view') THEN 'P' ELSE 'S' END AS phase,
         epoch_us(ts) / 1e6 AS t, (event_id * 37) % 101 AS w, ((event_id * 37) % 101)::DOUBLE / 100.0::DOUBLE AS prob, floor(epoch_us(ts) / 1e6 / 3600)::BIGINT AS eventId, value
  FROM events WHERE event_type <> 'error'
), stations AS (
  SELECT c_custkey AS id, c_custkey AS stationId, ((c_custkey * 7919) % 20001 - 10000)::DOUBLE AS e, ((c_custkey * 104729) % 20001 - 10000)::DOUBLE AS n,
         (1600 + (c_custkey * 31) % 300)::DOUBLE AS elevM, c_acctbal > 0 AS usedInRun
  FROM customer WHERE c_custkey IN (SELECT user_id FROM events)
), catalog AS (
  SELECT event_id AS catalogId, epoch_us(ts) / 1e6 AS t, ((user_id * 7919) % 20001 - 10000)::DOUBLE AS e, ((user_id * 104729) % 20001 - 10000)::DOUBLE AS n,
         value / 100 AS mag, CASE WHEN event_id % 2 = 0 THEN 'ml' ELSE 'md' END AS magType
  FROM events WHERE event_type = 'error'
), located AS (
  SELECT event_id AS eventId, epoch_us(ts) / 1e6 AS t, ((user_id * 7919) % 20001 - 10000)::DOUBLE AS e, ((user_id * 104729) % 20001 - 10000)::DOUBLE AS n, value,
         ((event_id * 13) % 997) / 10000.0::DOUBLE AS rmsS, ((event_id * 29) % 361)::DOUBLE AS gapDeg, (4 + (event_id * 7) % 17)::DOUBLE AS nStations,
         CASE WHEN event_id % 17 <> 0 THEN ((event_id * 53) % 1009)::DOUBLE END AS hErrM, event_id % 23 = 0 AS depthOnEdge,
         ((event_id * 11) % 5000)::DOUBLE AS minEpiDistM, (500 + (event_id * 19) % 3000)::DOUBLE AS focalDepthM,
         CASE WHEN event_id % 3 = 0 THEN event_id * 2 END AS catalogId, CASE WHEN event_id % 2 = 0 THEN 'full' ELSE 'p_only' END AS profile,
         CASE WHEN (event_id // 2) % 2 = 0 THEN 'net' ELSE 'classic' END AS method
  FROM events WHERE event_type = 'signup'
), segments AS (
  SELECT user_id AS stationId, event_type AS channel, epoch_us(ts) / 1e6 AS start, epoch_us(ts) / 1e6 + value * 600 AS stop FROM events
), observations AS (
  SELECT l_orderkey AS eventId, l_suppkey AS stationId, log10(l_extendedprice) AS logA, log10(l_quantity) AS logR, log10(o_totalprice) AS mag
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
), surveys AS (
  SELECT l_orderkey AS well, l_linenumber * 25.0::DOUBLE AS md, min(l_discount * 900) AS inc, min((l_partkey % 360)::DOUBLE) AS azi FROM lineitem GROUP BY ALL
), samples AS (
  SELECT vec_id AS segmentId, embedding::DOUBLE[] AS samples FROM embeddings
)"""


def with_tables(sql: str, recursive: bool = False) -> str:
    """sql, which may go on with ', name AS (...)' before its SELECT."""
    return f"WITH {'RECURSIVE ' * recursive}{SQL.strip()}{sql}"
