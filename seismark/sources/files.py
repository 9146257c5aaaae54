"""Reading and writing the run's files: typed tables, catalogs, velocity and survey files, waveform segments, bundles."""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seismark.operators.location import Layers
from seismark.sources import schemas


def write_table(df: DataFrame, path: str, name: str) -> None:
    """Parquet with the declared types, and the table's name and version in its columns' metadata."""
    out = schemas.typed(df, name)
    first = out.columns[0]
    out.withMetadata(first, {"table": name, "version": schemas.VERSION}).write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table that write_table wrote; another table's file, or another version's, is an error."""
    df = spark.read.parquet(path)
    mark = df.schema[0].metadata
    if (mark.get("table"), mark.get("version")) != (name, schemas.VERSION):
        raise ValueError(f"{path} holds {mark or 'no marked table'}, not {name} of version {schemas.VERSION}")
    return schemas.typed(df, name)


def read_layers(spark: SparkSession, path: str) -> Layers:
    """A layered velocity file: '#' lines, then topElevM, vpMPerS, vsMPerS from the top down.  A model has a handful of layers."""
    rows = sorted(spark.read.csv(path, header=True, comment="#", schema="topElevM double, vpMPerS double, vsMPerS double").collect(), key=lambda r: -r[0])
    if not rows or any(not 100 < r.vsMPerS < r.vpMPerS < 10_000 for r in rows) or len({r[0] for r in rows}) < len(rows):
        raise ValueError(f"{path}: speeds in m/s with vs < vp and distinct tops are asked for")
    return Layers(*(tuple(r[i] for r in rows) for i in range(3)))


def read_surveys(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False).select(*[F.col(c).cast("double").alias(n) for c, n in (("md", "md"), ("incDeg", "inc"), ("aziDeg", "azi"))])


_EVENT = (
    "_publicID string, type string, preferredOriginID string, preferredMagnitudeID string, "
    "origin array<struct<_publicID:string,time:struct<value:string>,latitude:struct<value:double>,longitude:struct<value:double>,depth:struct<value:double>,creationInfo:struct<agencyID:string>>>, "
    "magnitude array<struct<_publicID:string,mag:struct<value:double>,type:string>>"
)


def read_quakeml(spark: SparkSession, path: str) -> DataFrame:
    """One row for each event: preferred origin and magnitude (else the first), kilometres of depth, epoch seconds."""
    e = spark.read.format("xml").option("rowTag", "event").schema(_EVENT).load(path)

    def preferred(items: str, key: str) -> Column:
        mine = F.filter(items, lambda x: x["_publicID"] == F.col(key))
        return F.coalesce(F.try_element_at(mine, F.lit(1)), F.try_element_at(F.col(items), F.lit(1)))

    e = e.withColumn("o", preferred("origin", "preferredOriginID")).withColumn("m", preferred("magnitude", "preferredMagnitudeID"))
    t = F.unix_micros(F.to_timestamp(F.concat(F.regexp_replace("o.time.value", "Z$", ""), F.lit("Z")))) / F.lit(1e6)
    return e.select(
        F.col("_publicID").alias("id"), "type", t.alias("t"), F.col("o.latitude.value").alias("latitude"), F.col("o.longitude.value").alias("longitude"),
        (F.col("o.depth.value") / 1000).alias("depthKm"), F.col("m.mag.value").alias("mag"), F.lower("m.type").alias("magType"), F.col("o.creationInfo.agencyID").alias("source"),
    )


_CHANNEL = (
    "_code string, _locationCode string, _startDate string, _endDate string, Latitude double, Longitude double, Elevation double, Depth double, SampleRate double, "
    "Response struct<InstrumentSensitivity:struct<Value:double,Frequency:double,InputUnits:struct<Name:string>>,Stage:array<struct<_number:int,PolesZeros:struct<PzTransferFunctionType:string,NormalizationFactor:double,Zero:array<struct<Real:double,Imaginary:double>>,Pole:array<struct<Real:double,Imaginary:double>>>,StageGain:struct<Value:double>>>>"
)
_NETWORK = f"_code string, Station array<struct<_code:string,Latitude:double,Longitude:double,Elevation:double,Channel:array<struct<{', '.join(f'{n}:{t}' for n, t in (c.split(' ', 1) for c in _CHANNEL.split(', ')))}>>>>"


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """One row for each channel epoch of a station file: codes, place, depth, rate, its days, and its response: sensitivity, unit, gains of the stages, and zeros and poles of the first stage that has any.

    zeros and poles are flat pairs of real and imaginary parts in radians a second, whatever the file
    counts in, and norm is the factor that goes with them; all three are null for a channel without them.
    """
    n = spark.read.format("xml").option("rowTag", "Network").schema(_NETWORK).load(path)
    s = n.select(F.col("_code").alias("network"), F.explode("Station").alias("s"))
    c = s.select("network", F.col("s._code").alias("station"), F.explode("s.Channel").alias("c"))
    day = lambda x: F.unix_micros(F.to_timestamp(F.concat(F.regexp_replace(x, "Z$", ""), F.lit("Z")))) / F.lit(1e6)
    sensitivity = F.col("c.Response.InstrumentSensitivity")
    pz = F.col("pz")
    turn = F.when(F.upper(pz["PzTransferFunctionType"]) == "LAPLACE (HERTZ)", 2 * math.pi).otherwise(1.0)
    flat = lambda x: F.when(pz.isNotNull(), F.coalesce(F.flatten(F.transform(pz[x], lambda r: F.array(r["Real"] * turn, r["Imaginary"] * turn))), F.expr("cast(array() as array<double>)")))
    more = F.coalesce(F.size(pz["Pole"]), F.lit(0)) - F.coalesce(F.size(pz["Zero"]), F.lit(0))
    c = c.withColumn("pz", F.expr("get(filter(c.Response.Stage.PolesZeros, x -> x IS NOT NULL), 0)"))
    return c.select(
        "network", "station", F.coalesce("c._locationCode", F.lit("")).alias("location"), F.col("c._code").alias("channel"), F.substring("c._code", 1, 2).alias("code"), F.substring("c._code", 3, 1).alias("component"),
        F.col("c.Latitude").alias("latitude"), F.col("c.Longitude").alias("longitude"), F.col("c.Elevation").alias("elevM"), F.col("c.Depth").alias("depthM"), F.col("c.SampleRate").alias("rateHz"),
        day(F.col("c._startDate")).alias("start"), day(F.col("c._endDate")).alias("stop"),
        sensitivity["Value"].alias("sensitivity"), F.upper(sensitivity["InputUnits"]["Name"]).alias("unit"), F.transform("c.Response.Stage", lambda x: x["StageGain"]["Value"]).alias("gains"),
        flat("Zero").alias("zeros"), flat("Pole").alias("poles"), (pz["NormalizationFactor"] * F.pow(turn, more)).alias("norm"),
    )


def active_at(channels: DataFrame, t0: float, t1: float) -> DataFrame:
    """Channel epochs that cover all of [t0, t1); an open end covers everything after its start."""
    return channels.where((F.col("start") <= t0) & (F.col("stop").isNull() | (F.col("stop") >= t1)))


def commit_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Several tables, all or none: each is written beside its place, and they move there only when all are written.

    They move in the order given, so a table that depends on others comes last; what was there
    before is moved aside first, and back if a move fails.
    """
    spark = next(iter(tables.values())).sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    at = lambda name: hadoop.Path(f"{folder.rstrip('/')}/{name}")
    fs = at("x").getFileSystem(conf)
    try:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/.part-{name}")
    except Exception:
        for name in tables:
            fs.delete(at(f".part-{name}"), True)
        raise
    done: list[str] = []
    try:
        for name in tables:
            fs.delete(at(f".old-{name}"), True)
            if fs.exists(at(name)) and not fs.rename(at(name), at(f".old-{name}")):
                raise OSError(f"{name} can't be moved aside")
            done.append(name)
            if not fs.rename(at(f".part-{name}"), at(name)):
                raise OSError(f"{name} can't be put into place")
    except Exception:
        for name in reversed(done):
            fs.delete(at(name), True)
            if fs.exists(at(f".old-{name}")):
                fs.rename(at(f".old-{name}"), at(name))
        for name in tables:
            fs.delete(at(f".part-{name}"), True)
        raise
    for name in tables:
        fs.delete(at(f".old-{name}"), True)


def with_elevation(catalog: DataFrame, datums: DataFrame) -> DataFrame:
    """catalog with elevM = the contributor's surface minus depth; a contributor without a datum is an error where it is met."""
    d = F.broadcast(datums.select("source", "surfaceElevM"))  # one row a contributor
    j = catalog.join(d, "source", "left")
    known = F.when(F.col("surfaceElevM").isNull(), F.raise_error(F.concat(F.lit("no depth datum for "), F.coalesce("source", F.lit("null"))))).otherwise(F.col("surfaceElevM"))
    return j.withColumn("elevM", known - F.col("depthKm") * 1000).drop("surfaceElevM")


def _day(number: Column) -> Column:
    """yyyyMMdd of a day counted from 1970, whatever the session's zone."""
    return F.date_format(F.date_from_unix_date(number.cast("int")), "yyyyMMdd")


def write_segments(segments: DataFrame, path: str) -> None:
    """Waveform segments by station and UTC day, so that a window reads only its days."""
    day = _day(F.floor(F.col("start") / 86400))
    segments.withColumn("day", day).repartition("stationId", "day").write.mode("overwrite").partitionBy("stationId", "day").parquet(path)


def read_window(spark: SparkSession, path: str, stations: list[str], t0: float, t1: float, headers: bool = False) -> DataFrame:
    """Segments with a sample in [t0, t1], both ends inside, cut to it; gaps stay between rows.

    The days follow from the window, so that partitions are pruned; with headers=True samples aren't read.
    A segment lies in the day of its start, and may reach into the next.
    """
    days = [r[0] for r in spark.range(int(t0 // 86400) - 1, int(t1 // 86400) + 1).select(_day(F.col("id"))).collect()]
    s = spark.read.option("basePath", path).parquet(path).where(F.col("day").cast("string").isin(days) & F.col("stationId").isin(stations))
    n = F.col("n") if "n" in s.columns else F.size("samples")
    s = s.withColumn("_n", n).where((F.col("start") <= t1) & (F.col("start") + (F.col("_n") - 1) * F.col("delta") >= t0))
    if headers:
        return s.select("stationId", "channel", "start", (F.col("start") + F.col("_n") * F.col("delta")).alias("stop"), "delta")
    first = F.greatest(F.lit(0), F.ceil((F.lit(t0) - F.col("start")) / F.col("delta"))).cast("int")
    last = F.least(F.col("_n") - 1, F.floor((F.lit(t1) - F.col("start")) / F.col("delta"))).cast("int")
    return s.select("stationId", "channel", (F.col("start") + first * F.col("delta")).alias("start"), "delta", F.slice("samples", first + 1, F.greatest(last - first + 1, F.lit(0))).alias("samples")).where(F.size("samples") > 0)


def download_plan(stations: DataFrame, t0: float, t1: float, chunk: float, fetched: DataFrame, now: float, provisional: float) -> DataFrame:
    """(stationId, start, stop) chunks on multiples of `chunk` still to be fetched.

    A chunk that was fetched less than `provisional` seconds after its end is fetched again.
    """
    k = F.explode(F.sequence(F.lit(int(t0 // chunk)), F.lit(int(-(-t1 // chunk)) - 1)))
    want = stations.select("stationId", k.alias("k")).select("stationId", F.greatest(F.col("k") * chunk, F.lit(t0)).alias("start"), F.least((F.col("k") + 1) * chunk, F.lit(t1)).alias("stop")).where(F.col("start") < now)
    trusted = fetched.where(F.col("fetchedAt") - F.col("stop") >= provisional).select("stationId", "start")
    return want.join(trusted, ["stationId", "start"], "left_anti")


def read_bundle(spark: SparkSession, path: str, version: str) -> DataFrame:
    """A bundle's JSON file; another schemaVersion fails where its rows are met."""
    b = spark.read.json(path, multiLine=True)
    ok = F.col("schemaVersion").cast("string") == version
    return b.where(F.coalesce(F.when(~F.coalesce(ok, F.lit(False)), F.raise_error(F.lit(f"{path} isn't of version {version}"))).cast("boolean"), F.lit(True)))


def sorted_json(df: DataFrame) -> DataFrame:
    """One compact JSON text a row, keys in order."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("json"))


def rate_profile(rate: Column, rules: list[tuple[str, float, float]]) -> Column:
    """The first profile whose range, ends inside, holds the rate."""
    out = F.lit(None).cast("string")
    for name, low, high in reversed(rules):
        out = F.when(rate.between(low, high), name).otherwise(out)
    return out


def window_coverage(daily: DataFrame, t0: float, t1: float) -> DataFrame:
    """Share of [t0, t1) that a channel's daily availability covers; null without any measurement.  A station needs three channels."""
    part = F.greatest(F.lit(0.0), F.least((F.col("dayNumber") + 1) * 86400.0, F.lit(t1)) - F.greatest(F.col("dayNumber") * 86400.0, F.lit(t0))) / (t1 - t0)
    per = daily.where(part > 0).groupBy("stationId", "channel").agg(F.sum(F.col("metric") * part).alias("coverage"))
    return per.groupBy("stationId").agg(F.when(F.count(F.lit(1)) == 3, F.min("coverage")).alias("coverage"))
