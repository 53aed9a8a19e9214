"""Sanitised boxes, perimeters, envelopes, polygons' distances and components that stay, by hand."""

from pyspark.sql import functions as F

from planfold.functions import geometry
from planfold.operators import cleanup, shapes

PLAN = "plan_id long, min_x int, min_y int, max_x int, max_y int"
WALL = "plan_id long, wall_id long, x1 int, y1 int, x2 int, y2 int"


def test_sanitized_boxes(spark):
    plans = spark.createDataFrame([(1, 0, 0, 1000, 500)], PLAN)
    rows = [
        (1, 1, -50, 10, None, None, 200, 100),  # cut at the left
        (1, 2, 950, 450, None, None, 200, 200),  # cut to half a metre
        (1, 3, 951, 0, None, None, 200, 200),  # 49 cm are left
        (1, 4, None, 5, 300, 200, 100, 100),  # its centre stands for both
        (1, 5, None, None, None, 1, 100, 100),  # nowhere
        (1, 6, 1001, 0, None, None, 100, 100),  # outside
        (1, 7, 0, 0, None, None, None, 0),  # a metre each way
        (2, 8, 0, 0, None, None, 100, 100),  # no such plan
    ]
    df = spark.createDataFrame(rows, "plan_id long, box_id long, x int, y int, cx int, cy int, w int, h int")
    assert {r.box_id: (r.x, r.y, r.w, r.h) for r in shapes.sanitized(df, plans).collect()} == {1: (0, 10, 150, 100), 2: (950, 450, 50, 50), 4: (300, 200, 100, 100), 7: (0, 0, 100, 100)}


def test_perimeter_walls(spark):
    plans = spark.createDataFrame([(1, 0, 0, 1000, 500)], PLAN)
    walls = spark.createDataFrame([(1, 1, 49, 0, 0, 500), (1, 2, 50, 0, 50, 500), (1, 3, 990, 40, 1030, 300), (1, 4, 100, 20, 900, 20), (1, 5, 100, 480, 900, 520), (1, 6, 0, 0, 500, 250)], WALL)
    assert {r.wall_id: r.side for r in shapes.perimeter_walls(walls, plans).collect()} == {1: "left", 3: "right", 4: "bottom", 5: "top"}


def test_synthetic_envelopes(spark):
    plans = spark.createDataFrame([(i, 0, 0, 1000, 500) for i in range(1, 5)], PLAN)
    four = [(0, 0, 1000, 0), (1000, 0, 1000, 500), (1000, 500, 0, 500), (0, 500, 0, 0)]
    edges = [(1, *e) for e in four] + [(2, *e) for e in four[:3]] + [(3, *e) for e in four * 3] + [(4, *e) for e in four[:3]] + [(4, 0, 500, 21, 0)]
    got = {r.plan_id: (r.edges, r.aligned, r.synthetic) for r in shapes.synthetic_envelopes(spark.createDataFrame(edges, "plan_id long, x1 int, y1 int, x2 int, y2 int"), plans).collect()}
    assert got == {1: (4, 4, True), 2: (3, 3, False), 3: (12, 12, False), 4: (4, 3, False)}


def test_point_polygon_distance(spark):
    df = spark.createDataFrame([(5.0, 5.0, [(0.0, 0.0), (10.0, 0.0), (10.0, 20.0)]), (0.0, 0.0, [(3.0, 4.0), (9.0, 4.0), (9.0, 9.0)]), (0.0, 0.0, [(3.0, 4.0), (9.0, 4.0)])], "px double, py double, polygon array<struct<x: double, y: double>>")
    got = [r.d for r in df.select(geometry.point_polygon_squared(F.col("px"), F.col("py"), F.col("polygon")).alias("d")).collect()]
    assert abs(got[0] - 5.0) < 1e-9 and got[1:] == [25.0, None]


def test_components_that_stay(spark):
    rows = [(1, 1, 10, 1, True), (1, 2, 300, 1, False), (1, 3, 100, 5, False), (2, 4, 10, 1, False), (2, 5, 10, 2, False), (2, 6, 250, 1, False), (3, 7, 10, 1, False), (3, 8, 20, 1, False)]
    by = spark.createDataFrame(rows, "plan_id long, component long, length int, n long, seeded boolean")
    assert sorted(r.component for r in cleanup.kept_components(by, 200).collect()) == [1, 2, 5, 6, 8]


def arrows(spark, points, **more):
    df = spark.createDataFrame([(1, points)], "k long, points array<struct<x: double, y: double>>")
    return [(r.arrow, round(r.x, 6), round(r.y, 6), round(r.angle, 6)) for r in shapes.path_arrows(df, "k", **more).orderBy("arrow").collect()]


def test_arrows_along_paths(spark):
    assert arrows(spark, [(0.0, 0.0), (1000.0, 0.0)]) == [(0, 150, 0, 0), (1, 450, 0, 0), (2, 750, 0, 0)]
    bent = [(0.0, 0.0), (300.0, 0.0), (300.0, 0.0), (300.0, 700.0)]
    assert arrows(spark, bent) == [(0, 150, 0, 0), (1, 300, 150, 1.570796), (2, 300, 450, 1.570796)]
    assert arrows(spark, [(0.0, 0.0), (400.0, 0.0)]) == [(0, 200, 0, 0)]  # too short for two: one in the middle
    assert arrows(spark, [(0.0, 0.0), (0.0, 0.0)]) == arrows(spark, [(1.0, 2.0)]) == arrows(spark, []) == []
    assert len(arrows(spark, [(0.0, 0.0), (60_000.0, 0.0)])) == 200  # no cap


def test_text_labels(spark):
    from planfold.operators import classify

    said = ["7", "27", "0", "RM-300", "RM-x", "Ex50", "1.5m", "10 M", "To exit", "To exit", "ROOF THROUGH", "loading bay", "main access", "Sortie", "note", None]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(said)], "plan_id long, text_id long, text string")
    got = {(r.text_id, r.kind, r.label) for r in classify.text_labels(df).collect()}
    assert got == {
        (0, "number", "7"), (3, "room", "RM-300"), (5, "green_zone", "Ex50"), (6, "dimension", "1.5m"), (7, "dimension", "10 M"), (8, "notice", "To exit"), (8, "function", "EXIT DOOR"), (9, "function", "EXIT DOOR"),
        (10, "notice", "ROOF THROUGH"), (11, "function", "LOADING BAY"), (12, "function", "MAIN ACCESS"), (13, "function", "EXIT DOOR"),
    }


def test_line_classes(spark):
    from planfold.operators import classify

    df = spark.createDataFrame([("Door 1", 0), ("x", 1), ("x", 5), ("shaft", 3), ("MUR", 7), (None, 9), ("stair exit", 5)], "layer string, color int")
    assert [r.c for r in df.select(classify.line_class(F.col("layer"), F.col("color")).alias("c")).collect()] == ["entrance", "entrance", "forbidden", "forbidden", "wall", "wall", "entrance"]


def test_rings_are_computed_once(spark):
    """No part of a ring's clean-up or key is named twice in the expression, which would be computed as often."""
    df = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 0.0)],)], "ring array<struct<x: double, y: double>>")
    said = lambda c: df.select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert said(geometry.cleaned(F.col("ring"), 0.05)).count("aggregate(") == 1
    assert said(geometry.ring_key(F.col("ring"))).count("round(") == 2


def test_ring_keys_of_turned_rings(spark):
    ring = [(0.0, 0.0), (2.0, 0.0), (0.0, 0.0), (-1.0, 3.00004), (2.0, 0.0)]  # points come twice
    turns = [r[k:] + r[:k] for r in (ring, ring[::-1]) for k in range(5)]
    got = spark.createDataFrame([(t,) for t in [*turns, [], None, [(1.0, 2.0)]]], "ring array<struct<x: double, y: double>>").select(geometry.ring_key(F.col("ring")).alias("k"))
    keys = [r.k for r in got.collect()]
    rounded = [[(x, round(y, 4)) for x, y in t] for t in turns]
    assert set(keys[:10]) == {";".join(f"{x},{y}" for x, y in min(rounded))}
    assert keys[10:] == [None, None, "1.0,2.0"]
