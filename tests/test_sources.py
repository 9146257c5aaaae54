import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seismark.operators import inventory
from seismark.sources import files, schemas

QUAKEML = """<?xml version="1.0"?><q:quakeml xmlns:q="x"><eventParameters>
<event publicID="e1"><type>earthquake</type><preferredOriginID>o2</preferredOriginID>
<origin publicID="o1"><time><value>2024-01-01T00:00:00Z</value></time><latitude><value>1</value></latitude><longitude><value>2</value></longitude><depth><value>500</value></depth></origin>
<origin publicID="o2"><time><value>2024-01-01T00:00:10.250000Z</value></time><latitude><value>38.5</value></latitude><longitude><value>-112.9</value></longitude><depth><value>2500</value></depth><creationInfo><agencyID>UU</agencyID></creationInfo></origin>
<magnitude publicID="m1"><mag><value>0.7</value></mag><type>Ml</type></magnitude></event>
<event publicID="e2"><type>quarry blast</type></event></eventParameters></q:quakeml>"""


def test_typed_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", "p", "P", 1.0, float("nan"), "x", None, None, None)], schemas.DDL["picks"])
    files.write_table(rows, str(tmp_path / "p"), "picks")
    back = files.read_table(spark, str(tmp_path / "p"), "picks")
    assert back.schema == schemas.typed(rows, "picks").schema and back.first().prob is None
    with pytest.raises(ValueError):
        files.read_table(spark, str(tmp_path / "p"), "gaps")
    files.write_table(rows.limit(0), str(tmp_path / "e"), "picks")
    assert files.read_table(spark, str(tmp_path / "e"), "picks").count() == 0
    with pytest.raises(ValueError):
        schemas.typed(rows.drop("prob"), "picks")


def test_flatten(spark):
    df = spark.createDataFrame([(1, (2.0, 3.0)), (2, None)], "id int, enu struct<e:double,n:double>")
    flat = schemas.flattened(df)
    assert flat.columns == ["id", "enu_e", "enu_n"]
    assert sorted(map(tuple, schemas.nested(flat, "enu").collect())) == sorted(map(tuple, df.collect()))


def test_quakeml(spark, tmp_path):
    (tmp_path / "c.xml").write_text(QUAKEML)
    a, b = sorted(files.read_quakeml(spark, str(tmp_path / "c.xml")).collect(), key=lambda r: r.id)
    assert (a.t, a.latitude, a.depthKm, a.mag, a.magType, a.source) == (1704067210.25, 38.5, 2.5, 0.7, "ml", "UU") and b.type == "quarry blast" and b.t is None
    datums = spark.createDataFrame([("UU", 1700.0)], "source string, surfaceElevM double")
    one = files.with_elevation(files.read_quakeml(spark, str(tmp_path / "c.xml")).where("id = 'e1'"), datums).first()
    assert one.elevM == -800.0
    with pytest.raises(Exception, match="no depth datum"):
        files.with_elevation(files.read_quakeml(spark, str(tmp_path / "c.xml")), datums).collect()


def test_csv_sources(spark, tmp_path):
    (tmp_path / "v.csv").write_text("# unit: m\ntopElevM,vpMPerS,vsMPerS\n0,3000,1700\n1000,2000,1000\n")
    assert files.read_layers(spark, str(tmp_path / "v.csv")).top == (1000.0, 0.0)
    (tmp_path / "bad.csv").write_text("topElevM,vpMPerS,vsMPerS\n0,3,1.7\n")
    with pytest.raises(ValueError):
        files.read_layers(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "s.csv").write_text("md,incDeg,aziDeg\n0,0,0\n100,5,10\n")
    assert files.read_surveys(spark, str(tmp_path / "s.csv")).count() == 2


def test_segments(spark, tmp_path):
    path, day = str(tmp_path / "seg"), 1704067200.0
    rows = [("A", "Z", day + 86300.0, 1.0, [float(i) for i in range(200)]), ("A", "Z", day + 90000.0, 1.0, [1.0] * 10), ("B", "Z", day, 1.0, [0.0])]
    files.write_segments(spark.createDataFrame(rows, "stationId string, channel string, start double, delta double, samples array<double>"), path)
    w = files.read_window(spark, path, ["A"], day + 86390.5, day + 86410.0)
    (r,) = w.collect()
    assert r.start == day + 86391.0 and r.samples == [float(i) for i in range(91, 111)]
    assert "PartitionFilters: [" in w._jdf.queryExecution().toString() and files.read_window(spark, path, ["A"], day, day + 10).count() == 0
    (h,) = files.read_window(spark, path, ["A"], day + 90005, day + 90006, headers=True).collect()
    assert h.stop == day + 90010.0


def test_plan_and_coverage(spark):
    s = spark.createDataFrame([("A",)], "stationId string")
    done = spark.createDataFrame([("A", 0.0, 3600.0, 9000.0), ("A", 3600.0, 7200.0, 7300.0)], "stationId string, start double, stop double, fetchedAt double")
    plan = files.download_plan(s, 0.0, 10_000.0, 3600.0, done, 9_000.0, 600.0).orderBy("start").collect()
    assert [(r.start, r.stop) for r in plan] == [(3600.0, 7200.0), (7200.0, 10_000.0)]
    daily = spark.createDataFrame([("A", c, 0, 1.0) for c in "ZNE"] + [("A", c, 1, 0.5) for c in "ZNE"] + [("B", "Z", 0, 1.0)], "stationId string, channel string, dayNumber long, metric double")
    assert {r.stationId: r.coverage for r in files.window_coverage(daily, 43200.0, 129600.0).collect()} == {"A": 0.75, "B": None}
    assert [r[0] for r in spark.range(3).select(files.rate_profile(F.col("id") * 100.0, [("low", 0, 100), ("high", 100, 300)])).collect()] == ["low", "low", "high"]


def test_bundle(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"schemaVersion": 1, "b": 2, "a": null}')
    assert files.read_bundle(spark, str(tmp_path / "b.json"), "1").count() == 1
    with pytest.raises(Exception, match="version"):
        files.read_bundle(spark, str(tmp_path / "b.json"), "2").collect()
    assert files.sorted_json(spark.createDataFrame([(2, None)], "b int, a int")).first().json == '{"a":null,"b":2}'


STATIONS = """<FDSNStationXML xmlns="x"><Network code="FO"><Station code="A1"><Latitude>38.5</Latitude><Longitude>-112.9</Longitude><Elevation>1700</Elevation>
<Channel code="HHZ" locationCode="01" startDate="2024-01-01T00:00:00" endDate="2024-06-01T00:00:00"><Latitude>38.5</Latitude><Longitude>-112.9</Longitude><Elevation>1700</Elevation><Depth>2</Depth><SampleRate>100</SampleRate>
<Response><InstrumentSensitivity><Value>5E8</Value><Frequency>1</Frequency><InputUnits><Name>m/s</Name></InputUnits></InstrumentSensitivity><Stage number="1"><StageGain><Value>1200</Value></StageGain></Stage><Stage number="2"><StageGain><Value>4e5</Value></StageGain></Stage></Response></Channel>
<Channel code="HHE" startDate="2024-01-01T00:00:00"><Depth>2</Depth><SampleRate>100</SampleRate></Channel></Station></Network></FDSNStationXML>"""


def test_stations(spark, tmp_path):
    (tmp_path / "s.xml").write_text(STATIONS)
    c = files.read_stations(spark, str(tmp_path / "s.xml"))
    z, e = sorted(c.collect(), key=lambda r: r.channel, reverse=True)
    assert (z.network, z.station, z.location, z.channel, z.code, z.component, z.depthM, z.rateHz, z.sensitivity, z.unit, z.gains) == ("FO", "A1", "01", "HHZ", "HH", "Z", 2.0, 100.0, 5e8, "M/S", [1200.0, 4e5])
    assert e.location == "" and e.stop is None and e.unit is None and z.start == 1704067200.0
    assert [r.channel for r in files.active_at(c, z.start, z.stop + 1).collect()] == ["HHE"]
    assert z.zeros is None and z.norm is None


@pytest.mark.parametrize("kind, turn", [("LAPLACE (RADIANS/SECOND)", 1.0), ("LAPLACE (HERTZ)", 2 * math.pi)])
def test_zeros_and_poles(spark, tmp_path, kind, turn):
    """In radians a second whatever the file counts in; with norm and sensitivity, the gain at the normal frequency is the sensitivity."""
    roots = lambda name, values: "".join(f'<{name} number="{i}"><Real>{x.real / turn!r}</Real><Imaginary>{x.imag / turn!r}</Imaginary></{name}>' for i, x in enumerate(values))
    zeros, poles, s = [0j, 0j], [-4.4 + 4.5j, -4.4 - 4.5j, -900 + 0j], 2j * math.pi * 5
    norm = float(1 / abs(np.prod([(s - z) / turn for z in zeros]) / np.prod([(s - p) / turn for p in poles])))
    stage = f'<Stage number="1"><PolesZeros><PzTransferFunctionType>{kind}</PzTransferFunctionType><NormalizationFactor>{norm!r}</NormalizationFactor>{roots("Zero", zeros)}{roots("Pole", poles)}</PolesZeros><StageGain><Value>1200</Value></StageGain></Stage>'
    (tmp_path / "s.xml").write_text(STATIONS.replace('<Stage number="1"><StageGain><Value>1200</Value></StageGain></Stage>', stage))
    z, e = sorted(inventory.ground_responses(files.read_stations(spark, str(tmp_path / "s.xml"))).collect(), key=lambda r: r.channel, reverse=True)
    pairs = lambda v: [complex(*v[i : i + 2]) for i in range(0, len(v), 2)]
    assert pairs(z.zeros) == pytest.approx(zeros) and pairs(z.poles) == pytest.approx(poles) and z.integrations == 1 and z.gains == [1200.0, 4e5]
    assert abs(z.gain * np.prod([s - x for x in pairs(z.zeros)]) / np.prod([s - x for x in pairs(z.poles)])) == pytest.approx(5e8)
    assert e.zeros == e.poles == [] and e.gain is None and e.integrations is None


def test_commit_of_several_tables(spark, tmp_path):
    one, two = spark.range(3), spark.range(5)
    files.commit_tables({"a": one, "b": two}, str(tmp_path))
    read = lambda n: spark.read.parquet(str(tmp_path / n)).count()
    assert (read("a"), read("b")) == (3, 5)
    bad = two.select(F.raise_error(F.lit("stop")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        files.commit_tables({"a": two, "b": bad}, str(tmp_path))
    assert (read("a"), read("b")) == (3, 5) and sorted(p.name for p in tmp_path.iterdir() if p.name[0] == ".") == []
    files.commit_tables({"a": two}, str(tmp_path))
    assert (read("a"), read("b")) == (5, 5)
