"""Canonical JSON, geodesic boxes, rounding and verdicts as column expressions."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtally.functions.canonical import canonical_json
from gridtally.operators import reconcile as rec
from gridtally.operators import summary
from gridtally.operators.filters import Box
from gridtally.sources import normalize as nz


def dumped(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


NESTED = "b string, a struct<z:int,y:array<string>,`É`:boolean>, m map<string,array<double>>, n long"
VALUES = [
    {"b": 'quote " back \\ slash / \x00\x1f\x7f\b\t\n\f\r', "a": {"z": 1, "y": ["", None, "é"], "É": True}, "m": {"b": [1.5], "a": [], "😀": [None]}, "n": -(2**63)},
    {"b": "naïve 日本 \U0001f600   ￿ \x80", "a": None, "m": {}, "n": None},
    {"b": "plain", "a": {"z": None, "y": None, "É": False}, "m": None, "n": 0},
    {"b": "", "a": {"z": -5, "y": [], "É": None}, "m": {"k": [0.0, -0.0, 1e16, 1e-5]}, "n": 7},
]


def test_nested_values(spark):
    df = spark.createDataFrame([tuple(v.values()) for v in VALUES], NESTED)
    kind = df.schema
    shown = [r[0] for r in df.select(canonical_json(F.struct(*df.columns), kind)).collect()]
    assert shown == [dumped(v) for v in VALUES]
    digests = [r[0] for r in df.select(nz.fingerprint(df)).collect()]
    assert digests == [hashlib.sha256(dumped(v).encode()).hexdigest() for v in VALUES]


def test_known_digests(spark):
    """Digests of fixed values, so that they never change."""
    df = spark.sql("SELECT 'café \U0001f600' AS name, 12 AS n, true AS f, array('x', NULL) AS parts")
    assert df.select(nz.fingerprint(df, ["n", "name", "f", "parts", "gone"])).first()[0] == hashlib.sha256(
        b'{"f":true,"gone":null,"n":12,"name":"caf\\u00e9 \\ud83d\\ude00","parts":["x",null]}'
    ).hexdigest()
    empty = spark.sql("SELECT CAST(NULL AS STRING) AS a")
    assert empty.select(nz.fingerprint(empty)).first()[0] == hashlib.sha256(b'{"a":null}').hexdigest()


def test_doubles(spark):
    draw = random.Random(4)
    values = [0.0, 1.0, -1.0, 100.0, 1e15, 9999999999999998.0, 1e16, 1.5e16, 123456789.125, 1e-4, 1e-5, 0.00012, 1e22, 1e300]
    values += [draw.choice([-1, 1]) * draw.randrange(10**6) / 10 ** draw.randrange(12) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    shown = [r[0] for r in df.select(canonical_json(F.col("v"), T.DoubleType())).collect()]
    assert shown == [json.dumps(v) for v in values]


def test_all_code_points(spark):
    text = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x11000), *range(0x1F000, 0x1F100), 0x10FFFF]]
    rows = ["".join(text[i : i + 64]) for i in range(0, len(text), 64)]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    assert [r[0] for r in df.select(canonical_json(F.col("v"), T.StringType())).collect()] == [dumped(r) for r in rows]


def arc(box, edge, lon):
    """The edge by vectors: the plane through both corners and the centre, cut with a meridian."""
    def point(lon, lat):
        a, b = math.radians(lon), math.radians(lat)
        return math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b)

    p, q = point(box.west, edge), point(box.east, edge)
    n = (p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])
    a = math.radians(lon)
    return math.degrees(math.atan(-(n[0] * math.cos(a) + n[1] * math.sin(a)) / n[2]))


@pytest.mark.parametrize("box", [(-88, 41.7, -87.5, 42.0), (-60, -50, 90, -10), (-10, -20, 30, 40), (100, 60, 179, 90)])
def test_geodesic_box(spark, box):
    box, plain = Box(*box, geodesic=True), Box(*box)
    draw = random.Random(1)
    points = []
    for _ in range(3000):
        lon = draw.uniform(box.west - 1, box.east + 1)
        edge = draw.choice([box.south, box.north, draw.uniform(box.south, box.north)])
        points.append((lon, max(-90.0, min(90.0, edge + draw.uniform(-1, 1) * draw.choice([1e-3, 0.1, 30])))))
    df = spark.createDataFrame(points, "lon double, lat double")
    inside = [r[0] for r in df.select(box.holds(F.col("lon"), F.col("lat"))).collect()]
    slow = [
        box.west <= x <= box.east and arc(box, box.south, x) <= y and (box.north == 90 or y <= arc(box, box.north, x))
        for x, y in points
    ]
    assert inside == slow and inside != [r[0] for r in df.select(plain.holds(F.col("lon"), F.col("lat"))).collect()]


def test_arcs_bow_and_bounds_reach_the_scan(spark, tmp_path):
    box = Box(-88.0, 41.7, -87.5, 42.0, geodesic=True)
    low, high = box.reach()
    assert low == 41.7 and 20 < (high - 42.0) * 111_195 < 40
    with pytest.raises(ValueError):
        Box(-100, 0, 90, 10, geodesic=True)
    spark.sql("SELECT -87.7D AS lon, 41.8D AS lat").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = df.where(box.holds(F.col("lon"), F.col("lat")))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(lat,41.7)" in plan.split("PushedFilters:")[1]


def test_one_rounding(spark):
    draw = random.Random(2)
    values = [2.25, 2.75, 0.15, 0.25, 0.35, -2.25, -0.05, 0.05, 1.05, 100.0, 0.0, -100.0, 33.35, 1e6 + 0.25, 0.1, 0.3]
    values += [(a - b) / b * 100 for a, b in ((draw.randrange(3000), draw.randrange(1, 3000)) for _ in range(4000))]
    values += [k / 20 for k in range(-400, 400)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(summary.one_decimal(F.col("v"))).collect()] == [round(v, 1) for v in values]


def test_verdicts_of_a_table(spark):
    draw, rows = random.Random(3), []
    for _ in range(400):
        pick = lambda *x: draw.choice(x)
        rows.append((
            draw.randrange(0, 120), pick(None, 50, 80, 100), pick(None, 0, 50, 100), pick(None, 40, 60),
            pick(None, 0.0, 20.0, 50.0), draw.random() < 0.1, draw.random() < 0.8, draw.random() < 0.9,
        ))
    names = "received long, reported long, baseline long, floor long, most_drop_percent double, manual_hold boolean, protected boolean, schema_valid boolean"
    found = rec.judged(spark.createDataFrame(rows, names)).select("status", "reason", "evidence", "change_percent").collect()
    for row, got in zip(rows, found, strict=True):
        received, reported, base, floor, drop, hold, guarded, valid = row
        config = rec.SourceConfig("s", base, hold, guarded, floor, drop)
        one = rec.judge_run(config, received, reported, valid)
        assert tuple(got) == (one.status, one.reason, one.evidence, one.change_percent)
