"""Declared schemas of the run's tables; dtypes never come from values, so an empty table is fully typed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, StructType

VERSION = "1"

DDL = {
    "stations": "id string, network string, station string, location string, latitude double, longitude double, surfaceElevM double, sensorDepthM double, sensorElevM double, kind string, channels array<string>, sampleRateHz double, enu_e double, enu_n double, enu_u double, preprocessProfile string, usedInRun boolean, staticsS string",
    "picks": "id string, stationId string, phase string, t double, prob double, picker string, eventId string, residualS double, weight double",
    "gaps": "stationId string, channel string, gapStart double, gapEnd double",
    "catalog": "id string, source string, t double, latitude double, longitude double, depthKm double, depthDatum string, elevM double, mag double, magType string, enu_e double, enu_n double, enu_u double, matchedEventId string",
    "assoc_events": "assocId string, t double, latitude double, longitude double, elevM double, nPicks bigint, nP bigint, nS bigint",
    "assoc_picks": "assocId string, pickId string",
    "arrivals": "eventId string, stationId string, phase string, tPred double, tObs double, residualS double, pickId string, usedInLocation boolean",
    "statics": "stationId string, phase string, staticS double, nEvents bigint",
    "matches": "catalogId string, eventId string, dtS double, distM double, reason string",
    "sweep": "params string, candidates bigint, recoveredPublic bigint, tierA bigint",
    "segments": "stationId string, channel string, day string, start double, delta double, samples array<double>",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])


def typed(df: DataFrame, name: str) -> DataFrame:
    """df with the table's columns, in order and cast; NaN is null; a missing column is an error."""
    want = schema(name)
    if missing := [f.name for f in want if f.name not in df.columns]:
        raise ValueError(f"{name}: missing columns {missing}")
    cast = lambda f: F.col(f"`{f.name}`").cast(f.dataType)
    return df.select(*[F.nanvl(cast(f), F.lit(None).cast(f.dataType)).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else cast(f).alias(f.name) for f in want])


def flattened(df: DataFrame) -> DataFrame:
    """Nested structs as parent_child columns."""
    out = []
    for f in df.schema:
        out += [F.col(f"`{f.name}`.`{c.name}`").alias(f"{f.name}_{c.name}") for c in f.dataType] if isinstance(f.dataType, StructType) else [F.col(f"`{f.name}`")]
    return df.select(*out)


def nested(df: DataFrame, parent: str) -> DataFrame:
    """The inverse for one parent: all children null make a null struct."""
    children = [c for c in df.columns if c.startswith(f"{parent}_")]
    none = None
    for c in children:
        none = F.col(c).isNull() if none is None else none & F.col(c).isNull()
    made = F.when(~none, F.struct(*[F.col(c).alias(c[len(parent) + 1 :]) for c in children]))
    return df.select(*[c for c in df.columns if c not in children], made.alias(parent))


def is_boolean(name: str, column: str) -> bool:
    return isinstance(schema(name)[column].dataType, BooleanType)
