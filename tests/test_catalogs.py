"""Fixed values and rules of the catalogues, with literals written down apart from the code."""

import math

import pytest
from pyspark.sql import functions as F

from planfold.operators import catalogs


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("area,box,unit", [(0.3, None, "S"), (0.5, "S", "S"), (2.0, "S", "S"), (2.1, "M", "M"), (5.0, "M", "M"), (7.5, "L", "L"), (10.0, "L", "L"), (19.9, "XL", "XL"), (25.0, None, "XL"), (-1.0, None, "S")])
def test_templates(spark, area, box, unit):
    assert one(spark, catalogs.box_template(F.col("a")), a=area) == box
    assert one(spark, catalogs.unit_template(F.col("a")), a=area) == unit


TEMPLATES = {"S": (0.5, 2, 0.8, 1.5, 0.8, 2), "M": (2, 5, 1.2, 2.5, 1, 3), "L": (5, 10, 1.5, 3.5, 1.5, 4), "XL": (10, 20, 2, 5, 2, 5)}


def plain_dimensions(kind, area, dimension, step):
    if kind not in TEMPLATES:
        return 2.0, 1.5, 3.0
    lo, hi, w0, w1, d0, d1 = TEMPLATES[kind]
    a = max(lo, min(hi, area))
    near = lambda x, r: math.floor(x / r + 0.5) * r if r else x
    for ratio in (1.2, 1.5, 1.8, 2.0, 0.8, 0.6, 1.0):
        w = math.sqrt(a * ratio)
        w, d = near(w, dimension), near(a / w, dimension)
        if not (w0 <= w <= w1 and d0 <= d <= d1 and 0.48 <= w / d <= 1.68):
            continue
        if step:
            f = math.sqrt(near(w * d, step) / (w * d))
            w, d = near(w * f, dimension), near(d * f, dimension)
        if lo * 0.8 <= w * d <= hi * 1.2 and w0 * 0.8 <= w <= w1 * 1.1 and d0 * 0.8 <= d <= d1 * 1.1:
            return max(0.5, w), max(0.5, d), w * d
    use = min(a, w1 * d1 * 0.9)
    w, d = max(w0, min(w1, math.sqrt(use * 1.2))), max(d0, min(d1, use / math.sqrt(use * 1.2)))
    if w * d < use * 0.5:
        w, d = min(w1, w * 1.2), min(d1, d * 1.2)
    return max(0.5, w), max(0.5, d), w * d


@pytest.mark.parametrize("dimension,step", [(None, None), (0.1, None), (0.1, 0.5), (0.25, 1.0)])
def test_box_dimensions(spark, dimension, step):
    cases = [(k, a / 7) for k in ("S", "M", "L", "XL", "odd") for a in range(1, 180, 3)]
    df = spark.createDataFrame([(i, k, a) for i, (k, a) in enumerate(cases)], "i int, k string, a double")
    got = {r.i: (r.width, r.depth, r.box_area) for r in catalogs.box_dimensions(df, "k", "a", dimension, step).collect()}
    for i, case in enumerate(cases):
        assert got[i] == pytest.approx(plain_dimensions(*case, dimension, step)), case


@pytest.mark.parametrize("name,metres", [("Stairs main", 2.5), ("escalier", 2.5), ("LIFT 2", 2.0), ("poteau", 0.5), ("Radiateur", 0.8), ("sortie", 1.5), ("porte", 1.5), ("gaine", 1.0), ("other", 0.5), (None, 0.5), ("exit by the stairs", 2.5)])
def test_clearances(spark, name, metres):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(catalogs.clearance(F.col("n")).alias("x")).first().x == metres


@pytest.mark.parametrize("preset,expected", [("none", (9.0, 8.0, None, 7)), ("ibc_common", (1.2, 45.0, True, 1)), ("eurocode_style", (1.2, 40.0, True, 1)), ("storage_warehouse", (1.5, 60.0, False, 0)), ("what", (9.0, 8.0, None, 7))])
def test_presets(spark, preset, expected):
    own = spark.createDataFrame([(9.0, 8.0, None, 7)], "corridor_width double, egress_limit double, require_elevators boolean, accessible_entrances int")
    assert tuple(catalogs.with_preset(own, F.lit(preset)).first()) == expected


@pytest.mark.parametrize(
    "kind,length,w,h,expected",
    [
        ("ARC", 0.0, 1.0, 1.0, {"door": True, "door_type": "swing", "door_confidence": 0.9, "stair": False}),
        ("LINE", 1.0, 0.0, 1.0, {"door": True, "door_type": "single", "door_confidence": 0.8}),
        ("LINE", 1.3, 0.0, 1.0, {"door": True, "door_type": "standard", "door_confidence": 0.5}),
        ("LINE", 0.8, 0.0, 1.0, {"door": False, "door_type": None, "steps": 0}),
        ("LINE", 3.1, 0.0, 1.0, {"door": False, "stair": True, "steps": 10}),
        ("LWPOLYLINE", 9.0, 2.0, 2.0, {"elevator": True, "elevator_by_size": True, "column": False, "stair": False}),
        ("LWPOLYLINE", 9.0, 1.0, 1.5, {"elevator": True, "elevator_by_size": False}),
        ("LWPOLYLINE", 9.0, 0.4, 0.45, {"column": True, "elevator": False}),
        ("CIRCLE", 9.0, 5.0, 5.0, {"column": True, "elevator": False}),
    ],
)
def test_element_flags(spark, kind, length, w, h, expected):
    df = spark.createDataFrame([(kind, length, w, h)], "entity_type string, length double, width double, height double")
    row = df.select(*(c.alias(n) for n, c in catalogs.element_flags().items())).first()
    assert {k: row[k] for k in expected} == expected


def test_accessibility(spark):
    floors = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "plan_id long, floor_level int")
    connectors = spark.createDataFrame([(1, 0, "stair"), (1, 1, "escalator"), (1, 1, "stair"), (1, 1, "elevator")], "plan_id long, floor_level int, type string")
    entrances = spark.createDataFrame([(1, 0, 0.9), (1, 0, 1.2), (2, 0, 0.8)], "plan_id long, floor_level int, width double")
    got = {(r.plan_id, r.floor_level): (r.elevator, r.stairs, r.entrances, r.passes) for r in catalogs.accessibility(floors, connectors, entrances).collect()}
    assert got == {(1, 0): (False, 1, 2, True), (1, 1): (True, 2, 0, True), (1, 2): (False, 0, 0, False), (2, 0): (False, 0, 0, False)}
    relaxed = catalogs.accessibility(floors, connectors, entrances, require_elevators=False, entrances_least=0)
    assert {r.floor_level: r.passes for r in relaxed.where("plan_id = 1").collect()} == {0: True, 1: True, 2: False}


def test_confidence(spark):
    plans = spark.createDataFrame([(1, 0, 0, 100, 100), (2, 0, 0, 100, 100), (3, 0, 0, 10, 10)], "plan_id long, min_x int, min_y int, max_x int, max_y int")
    rect = "plan_id long, w int, h int"
    ids = lambda *k: spark.createDataFrame([(i,) for i in k], "plan_id long")
    got = catalogs.usable_area(plans, spark.createDataFrame([(1, 10, 10)], rect), spark.createDataFrame([(3, 20, 20)], rect), ids(1), ids(1), ids(2, 3))
    assert {r.plan_id: (r.usable, r.confidence, r.warnings) for r in got.collect()} == {1: (9900, 100, ""), 2: (10000, 55, "no walls; no exits"), 3: (0, 60, "no walls; no exits; no usable area")}


def test_junctions(spark):
    c = spark.createDataFrame([(1, 0, 0, 1000, 100), (1, 450, -400, 100, 900), (1, 1000, 0, 500, 100)], "plan_id long, x int, y int, w int, h int")
    got = {(r.x, r.y): (r.degree, r.kind) for r in catalogs.corridor_junctions(c).collect()}
    assert got == {(1000.0, 50.0): (2, "linear")}
    crossing = spark.createDataFrame([(1, 0, 0, 1000, 100), (1, 0, 5, 1000, 100), (1, 450, -400, 100, 900), (1, 450, -350, 100, 400)], "plan_id long, x int, y int, w int, h int")
    kinds = {r.kind: (r.degree, r.x) for r in catalogs.corridor_junctions(crossing).where("x = 500").collect()}
    assert kinds["cross"][0] >= 4


def test_valid_corridors(spark):
    rect = "plan_id long, x int, y int, w int, h int"
    c = spark.createDataFrame([(1, i, 200 * i, 0, 100, 100) for i in range(5)], "plan_id long, corridor_id long, x int, y int, w int, h int")
    zones, entrances = spark.createDataFrame([(1, 100, 0, 100, 50)], rect), spark.createDataFrame([(1, 290, 90, 20, 20)], rect)
    boxes = spark.createDataFrame([(1, 400, 0, 100, 80), (1, 600, 0, 100, 81)], rect)
    assert sorted(r.corridor_id for r in catalogs.valid_corridors(c, zones, entrances, boxes).collect()) == [0, 2, 4]


def test_density(spark):
    plans = spark.createDataFrame([(1, -100, 0, 220, 320)], "plan_id long, min_x int, min_y int, max_x int, max_y int")
    boxes = spark.createDataFrame([(1, -100, 0, 10, 10), (1, -95, 2, 4, 4), (1, 219, 319, 0, 0), (1, 500, 0, 10, 10)], "plan_id long, x int, y int, w int, h int")
    assert sorted(tuple(r) for r in catalogs.density_grid(plans, boxes).collect()) == [(1, 0, 0, 2), (1, 31, 31, 1)]
