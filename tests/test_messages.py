"""Message rules: every documented trap on literal text."""

import math

import pytest
from pyspark.sql import functions as F

from tagtrack.functions import text as X
from tagtrack.operators import ingest, quality

CASES = [
    ("A1=350;A2=420", {1: 350, 2: 420}),
    ("A2 D1=350", {2: 350, 1: 350}),
    ("A2D1=350", {2: 350}),
    ("anchor=2,d1=350", {2: 350, 1: 350}),
    ("anchor=2,valid=0,dist=350", {}),
    ("anchor=2,valid=0,d1=350", {1: 350}),
    ("anchor=2,valid=OFF,dist=350", {}),
    ("UWB,session=0x1003,src=0x1111,dst=0x2222,cb=1,status=0,lastDist=350,d1=350,ms=400", {1: 350}),
    ("UWB,session=0x1003,src=0x1111,dst=0x2222,cb=1,status=4,lastDist=65535,d1=-1,ms=400", {}),
    ("id=3 range=12,5 event=calib", {3: 12}),
    ("dist3: 12,5 type=probe", {3: 12.5}),
    ("heartbeat", {}),
    ("A1=123,4", {1: 123.4}),
    ("id=3 dist=-5", {3: -5}),
    ("id=x a=2 d1=9", {1: 9}),
    ("R0=5", {}),
    ("R7=5 range 12 = 6", {7: 5, 12: 6}),
    ("anchor=2 d1=bad dist=40", {2: 40}),
    ("anchor=1_0 dist=1_000", {10: 1000}),
    ("anchor=2 dist=5d", {}),
    ("a1=1,A1=2", {1: 2}),
    ("Anchor : 4 ; DIST : 77", {4: 77}),
    ("", {}),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(CASES)], "i int, message string")
    out = {i: {} for i in range(len(CASES))}
    for r in ingest.parse_ranges(df).collect():
        out[r.i][r.anchor_id] = r.distance_cm
    return out


@pytest.mark.parametrize("i", range(len(CASES)), ids=[m or "empty" for m, _ in CASES])
def test_distances(parsed, i):
    assert parsed[i] == CASES[i][1]


def test_not_a_number_is_a_keyed_value(spark):
    df = spark.createDataFrame([("id=3 dist=nan",), ("id=3 dist=-Infinity",)], "message string")
    got = [r.distance_cm for r in ingest.parse_ranges(df).collect()]
    assert math.isnan(got[0]) and got[1] == -math.inf


def test_fields_last_duplicate_wins(spark):
    df = spark.createDataFrame([("B=1 b=2, c : x=y",)], "message string")
    row = ingest.with_fields(df).select("fields", X.fields_json(F.col("fields")).alias("j")).first()
    assert row.fields == {"b": "2", "c": "x=y"}
    assert row.j == '{"b":"2","c":"x=y"}'


def test_event_label(spark):
    df = spark.createDataFrame([("event=go type=no",), ("type=probe",), ("hello",)], "message string")
    assert [r.event for r in ingest.with_event(df).collect()] == ["GO", "PROBE", "DISTANCE"]


def test_session_mode_and_sentinels(spark):
    lines = [
        "UWB,session=0x1003,src=0x1111,dst=0x2222,cb=7,status=0,lastDist=350,d1=350,ms=400",
        "UWB,session=0x1002,src=0x1111,dst=0x2222,cb=8,status=4,lastDist=65535,d1=-1,ms=500",
        "UWB,session=0x1002,src=0x1111,dst=0x2222,cb=x,status=4,lastDist=65535,d1=-1,ms=500",
        "XUWB,session=0x1002,src=0x1111,dst=0x2222,cb=8,status=4,lastDist=65535,d1=-1,ms=500",
        "A4=10",
    ]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(lines)], "i int, message string")
    got = {(r.i, r.anchor_id): r.distance_cm for r in ingest.parse_ranges(df, "session").collect()}
    # a line that is not a complete device record is read as plain text
    assert got == {(0, 3): 350.0, (4, 4): 10.0}
    tel = {r.i: r for r in ingest.telemetry(df).collect()}
    assert sorted(tel) == [0, 1]
    assert tel[1].d1 is None and tel[1].lastDist is None and tel[0].lastDist == 350
    assert sorted(r.i for r in ingest.telemetry_rejects(df).collect()) == [2, 3, 4]
    share = {r.session: r.failed_share for r in quality.failed_share(ingest.telemetry(df)).collect()}
    assert share == {"0x1003": 0.0, "0x1002": 1.0}


def test_bad_bytes_and_blanks(spark):
    df = spark.createDataFrame([(bytearray(b"  A1=5\xff\r\n"),)], "raw binary")
    assert df.select(X.clean_message(F.col("raw")).alias("m")).first().m == "A1=5�"


def test_long_message_is_read_whole(spark):
    text = "x" * 100000 + " A6=9"
    df = spark.createDataFrame([(text,)], "message string")
    assert [(r.anchor_id, r.distance_cm) for r in ingest.parse_ranges(df).collect()] == [(6, 9.0)]
