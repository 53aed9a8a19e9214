"""Scores of small layouts by hand, and nearest neighbours against all pairs."""

import math
import random

from planfold.operators import scores, spatial
from planfold.functions.geometry import gap_squared

PLAN = "plan_id long, min_x int, min_y int, max_x int, max_y int"
BOX = "plan_id long, floor_level int, box_id long, x int, y int, w int, h int"
RECT = "plan_id long, x int, y int, w int, h int"
EXIT = "plan_id long, exit_id long, x int, y int"


def test_fitness_of_two_boxes(spark):
    plans = spark.createDataFrame([(1, 0, 0, 1000, 1000)], PLAN)
    boxes = spark.createDataFrame([(1, 0, 1, 0, 0, 800, 400), (1, 0, 2, 0, 600, 800, 400)], BOX)
    r = scores.fitness(plans, boxes, spark.createDataFrame([], RECT), spark.createDataFrame([(1, 1, 400, 900)], EXIT)).first()
    assert (r.utilization, r.circulation, r.aesthetics) == (64 / 64, 1.0, 1.0)  # 64 % used, a gap of 2 m, equal boxes on the half metre
    assert abs(r.accessibility - (7 + 1) / 2 / 5) < 1e-12  # 7 m and 1 m from the exit
    assert r.constraints == 0.9  # one box under the exit
    assert abs(r.total - (0.30 + 0.25 + 0.20 * 0.8 + 0.15 + 0.10 * 0.9)) < 1e-12
    none = scores.fitness(plans, boxes, spark.createDataFrame([], RECT), spark.createDataFrame([], EXIT)).first()
    assert (none.accessibility, none.constraints) == (1.0, 1.0)


def test_placement_score_by_hand(spark):
    plans = spark.createDataFrame([(1, 0, 0, 1000, 1000)], PLAN)
    boxes = spark.createDataFrame([(1, 0, 1, 0, 0, 200, 200), (1, 0, 2, 400, 0, 200, 200), (1, 1, 3, 900, 900, 200, 200)], BOX)
    zones = spark.createDataFrame([(1, 500, 100, 10, 10)], RECT)
    got = {r.floor_level: r for r in scores.placement_score(plans, boxes, zones, spark.createDataFrame([(1, 1, 100, 100)], EXIT)).collect()}
    assert (got[0].density, got[0].accessibility, got[0].distribution, got[0].validity) == (8.0, 98.0, 100.0, 50.0)
    assert (got[1].distribution, got[1].validity) == (100.0, 0.0)
    assert abs(got[0].total - (0.3 * 8 + 0.3 * 98 + 0.2 * 100 + 0.2 * 50)) < 1e-9


def test_nearest_other_against_all_pairs(spark):
    r = random.Random(4)
    rows = [(1, i % 3, i, r.choice([r.randrange(300), r.randrange(100_000)]), r.randrange(60_000), 2 * r.randrange(1, 50), 2 * r.randrange(1, 50)) for i in range(200)] + [(2, 0, 900, 5, 5, 10, 10)]
    got = {x.box_id: x.d2 for x in scores.nearest_other(spark.createDataFrame(rows, BOX)).collect()}
    centre = {b: (p, f, x + w / 2, y + h / 2) for p, f, b, x, y, w, h in rows}
    expected = {}
    for b, (p, f, x, y) in centre.items():
        near = [math.hypot(x - u, y - v) for c, (q, g, u, v) in centre.items() if c != b and (p, f) == (q, g)]
        if near:
            expected[b] = min(near) ** 2
    assert set(got) == set(expected)
    assert all(abs(got[b] - expected[b]) < 1e-6 * max(1, expected[b]) for b in got)


def test_nearest_looks_as_far_as_it_must(spark):
    sources = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 499, 0), (2, 3, 0, 0), (3, 4, 0, 0)], EXIT)
    shapes = spark.createDataFrame([(1, 500, 0, 10, 10), (2, 900_000, 0, 10, 10)], RECT)
    got = {r.exit_id: r.d2 for r in spatial.nearest(sources, "exit_id", shapes, ["plan_id"], gap_squared("a", "b")).collect()}
    assert got == {1: 250_000, 2: 1, 3: 810_000_000_000}
