"""Rows, columns and spans: literals of known layouts, and plain scans of random ones."""

import math
import random

import pytest
from pyspark.sql import functions as F

from planfold.operators import rows, spans

BOX = "plan_id long, floor_level int, box_id long, x int, y int, w int, h int"


def boxes(spark, found):
    return spark.createDataFrame([(1, 0, i, *b) for i, b in enumerate(found)], BOX)


TWO = [(x, y, 200, 100) for y in (0, 500) for x in (0, 300, 600)]


def test_two_rows_that_face(spark):
    r = rows.row_metrics(rows.running_rows(boxes(spark, TWO)))
    found = r.orderBy("row_no").collect()
    assert [(x.n, x.min_x, x.max_x, x.density, x.alignment) for x in found] == [(3, 0, 800, 3 / 8, 1.0)] * 2
    p = rows.facing_pairs(r).collect()
    assert [(x.row_a, x.row_b, x.distance, x.overlap_ratio) for x in p] == [(0, 1, 450.0, 1.0)]
    assert 0 < p[0].quality <= 1
    s = rows.facing_statistics(r, rows.facing_pairs(r)).collect()[0]
    assert (s.boxes, s.rows, s.pairs, s.facing_boxes, s.facing_coverage, s.mean_row_size) == (6, 2, 1, 6, 1.0, 3.0)
    c = rows.recommended_corridors(r).collect()
    assert [(x.x, x.y, x.width, x.height) for x in c] == [(0, 225.0, 800, 150.0)]


@pytest.mark.parametrize("found,n_rows,pairs", [([(0, 0, 200, 100)], 1, 0), ([(0, 0, 200, 100), (0, 1000, 200, 100)], 2, 0), ([(0, 0, 200, 100), (0, 2000, 200, 100)], 2, 0), ([(0, 0, 200, 100), (1000, 300, 200, 100)], 2, 0), ([(0, 0, 200, 100), (0, 300, 200, 100), (0, 600, 200, 100)], 3, 3), ([], 0, 0)])
def test_rows_of_few(spark, found, n_rows, pairs):
    r = rows.row_metrics(rows.running_rows(boxes(spark, found)))
    assert r.count() == n_rows
    assert rows.facing_pairs(r).count() == pairs


def test_two_rows_give_one_corridor(spark):
    r = rows.row_metrics(rows.running_rows(boxes(spark, [(x, y, 200, 100) for y in (0, 400) for x in (100, 400)])))
    c = rows.recommended_corridors(r, least=100, most=1000, share=0.3).collect()
    assert len(c) == 1 and c[0].y >= 100 and c[0].y + c[0].height <= 400


def plain_rows(found, tolerance=300):
    out, lo, hi, mark = {}, None, None, None
    for i, (x, y, w, h) in sorted(enumerate(found), key=lambda b: (b[1][1], b[0])):
        if mark is not None and abs(y + h / 2 - (lo + hi) / 2) < tolerance:
            hi = max(hi, y + h)
        else:
            lo, hi, mark = y, y + h, i
        out[i] = mark
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_rows_of_one_large_floor_over_many_tasks(spark, parts):
    """Each range of the floor goes on where the one before it ended, also where a row is longer than a range."""
    r = random.Random(parts)
    found = [(r.randrange(5000), r.choice([r.randrange(20_000), 700 + r.randrange(30)]), 100, r.randrange(50, 500)) for _ in range(800)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.box_id: x.row_id for x in rows.running_rows(boxes(spark, found)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_rows(found)


def test_anchors_are_those_of_a_scan(spark):
    r = random.Random(2)
    found = [(r.randrange(3000), r.randrange(5000), 80, 80) for _ in range(400)] + [(-40, 0, 5, 5), (-90, 0, 5, 5)]
    got = {x.x: x.anchor for x in rows.anchored(boxes(spark, found), rows.FLOOR, "x", 50).collect()}
    expected, anchor = {}, None
    for x in sorted({b[0] for b in found}):
        anchor = x if anchor is None or x >= anchor + 50 else anchor
        expected[x] = anchor
    assert got == expected


PLAN = "plan_id long, min_x int, min_y int, max_x int, max_y int"
WALL = "plan_id long, wall_id long, x1 int, y1 int, x2 int, y2 int"
RECT = "plan_id long, x int, y int, w int, h int"


def shadows(spark, plan, walls=(), obstacles=(), **more):
    p = spark.createDataFrame([(1, *plan)], PLAN)
    w = spark.createDataFrame([(1, i, *x) for i, x in enumerate(walls)], WALL)
    o = spark.createDataFrame([(1, *x) for x in obstacles], RECT)
    found = {}
    for x in spans.aisle_shadows(p, w, o, width=more.pop("width", 80), **more).orderBy("aisle", "lo").collect():
        found.setdefault(x.aisle, []).append(x)
    return found


def test_aisles_without_walls_span_the_plan(spark):
    found = shadows(spark, (0, 0, 2000, 1200))
    assert len(found) == 3
    assert all([(x.lo, x.hi) for x in s] == [(0, 2000)] for s in found.values())
    for (x,) in found.values():
        assert 0 <= x.below_y < x.y < x.above_y and abs(x.above_y + x.row_h - x.below_y - 400) < 1e-9
    assert len(shadows(spark, (0, 0, 3000, 1000))) < len(shadows(spark, (0, 0, 3000, 4000)))
    low = shadows(spark, (0, 0, 3000, 200))
    assert [(x.y, x.h, x.row_h, x.above_y) for x in low[0]] == [(80, 80, 60, 160)]


def test_walls_and_obstacles_cut_aisles(spark):
    found = shadows(spark, (0, 0, 2000, 1200), [(1000, 0, 1000, 1200)])
    assert all([(x.lo, x.hi) for x in s] == [(0, 995), (1005, 2000)] for s in found.values())
    found = shadows(spark, (0, 0, 3000, 2000), [], [(1200, 0, 600, 2000)], depth=200, width=120)
    assert found and all(len(s) == 2 for s in found.values())
    assert shadows(spark, (0, 0, 1000, 1200), [], [(-100, -100, 1200, 1400)]) == {}
    assert all(len(s) == 3 for s in shadows(spark, (0, 0, 2500, 1800), [(800, 0, 800, 1800), (1700, 0, 1700, 1800)]).values())
    beside = shadows(spark, (0, 0, 2000, 1200), [(20, 0, 20, 1200)], [(5000, 0, 10, 1200)])  # at the plan's side, outside of it
    assert all([(x.lo, x.hi) for x in s] == [(0, 2000)] for s in beside.values())


def test_corridors_split_by_walls_of_any_slope(spark):
    c = spark.createDataFrame([(1, 10, 0, 0, 1000, 100), (1, 11, 0, 0, 100, 1000), (1, 12, 0, 3000, 500, 100), (1, 13, 0, 5000, 200, 100)], "plan_id long, corridor_id long, x int, y int, w int, h int")
    w = spark.createDataFrame([(1, 1, 400, -100, 400, 200), (1, 2, 600, 0, 700, 100), (1, 3, -50, 520, 150, 480), (1, 4, 450, 3000, 450, 3200), (1, 5, 100, 5050, 150, 5050)], WALL)
    got = {(x.corridor_id, x.part): tuple(round(v, 3) for v in (x.x, x.y, x.w, x.h)) for x in spans.split_corridors(c, w).collect()}
    assert got == {(10, 1): (0, 0, 395.5, 100), (10, 2): (404.5, 0, 241, 100), (10, 3): (654.5, 0, 345.5, 100), (11, 1): (0, 0, 100, 495.5), (11, 2): (0, 504.5, 100, 495.5), (12, 1): (0, 3000, 445.5, 100), (13, 1): (0, 5000, 95.5, 100)}


def test_free_and_cover(spark):
    d = spark.createDataFrame([(1, 0.0, 100.0), (2, 0.0, 1.0)], "k long, lo double, hi double")
    b = spark.createDataFrame([(1, 20.0, 30.0), (1, 30.5, 40.0), (1, -50.0, 5.0), (1, 95.0, 300.0), (1, 500.0, 600.0), (2, 7.0, 9.0)], "k long, lo double, hi double")
    assert sorted((x.k, x.lo, x.hi) for x in spans.free(d, b, ["k"], 10, 1).collect()) == [(1, 5, 20), (1, 40, 95), (2, 0, 1)]
    e = spark.createDataFrame([(1, 1, 21.0, 29.0), (1, 2, 0.0, 100.0), (1, 3, 41.0, 43.0), (1, 4, 15.0, 35.0)], "k long, e long, lo double, hi double")
    got = {x.e: (x.covered, round(x.ratio, 3), x.partly) for x in spans.coverage(e, spans.merged(b, ["k"], 1), ["k"], "e").collect()}
    assert got == {1: (True, 1.0, True), 2: (False, 0.3, True), 3: (False, 0.0, True), 4: (False, 0.75, True)}


def plain_runs(walls):
    def line(w):
        return math.degrees(math.atan2(w[3] - w[1], w[2] - w[0]))

    def off(p, w):
        dx, dy = w[2] - w[0], w[3] - w[1]
        return abs((p[0] - w[0]) * dy - (p[1] - w[1]) * dx) / math.hypot(dx, dy)

    parent = list(range(len(walls)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i, a in enumerate(walls):
        for j in range(i + 1, len(walls)):
            b = walls[j]
            d = abs(line(a) - line(b)) % 180
            if min(d, 180 - d) < 5.73 and min(math.dist(p, q) for p in (a[:2], a[2:]) for q in (b[:2], b[2:])) < 30 and (off(a[:2], b) < 20 or off(b[:2], a) < 20):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    out = {}
    for i, w in enumerate(walls):
        out.setdefault(root(i), []).extend([w[:2], w[2:]])
    return {k: max(math.dist(p, q) for p in v for q in v) for k, v in out.items()}


def test_collinear_runs_against_all_pairs(spark):
    r, walls = random.Random(5), []
    for _ in range(40):
        x, y, t = r.uniform(0, 5000), r.uniform(0, 5000), r.choice([r.uniform(0, 2 * math.pi), math.pi, 0.0, math.pi / 2])
        for _ in range(r.randrange(1, 7)):
            n = r.uniform(50, 300)
            w = [x, y, x + n * math.cos(t), y + n * math.sin(t)]
            gap = r.choice([0, 10, 50])
            x, y = w[2] + gap * math.cos(t), w[3] + gap * math.sin(t)
            walls.append(tuple(round(v) for v in (w if r.random() < 0.5 else w[2:] + w[:2])))
    got = {x.run: math.hypot(x.x2 - x.x1, x.y2 - x.y1) for x in spans.collinear_runs(spark.createDataFrame([(1, i, *w) for i, w in enumerate(walls)], WALL)).collect()}
    expected = plain_runs(walls)
    assert set(got) == set(expected)
    assert all(abs(got[k] - expected[k]) < 1e-6 for k in got)


def test_level_walls_follow_the_mean(spark):
    w = spark.createDataFrame([(1, 1, 0, 0, 100, 0), (1, 2, 120, 15, 200, 15), (1, 3, 230, 25, 300, 25), (1, 4, 0, 60, 30, 60), (1, 5, 7, 0, 7, 90), (1, 6, 0, 0, 50, 50)], WALL)
    got = sorted((x.flat, round(x.c, 3), x.lo, x.hi) for x in spans.level_walls(w).collect())
    assert got == [(False, 7.0, 0, 90), (True, 13.333, 0, 200), (True, 13.333, 230, 300)]
    assert spans.level_walls(w.where(F.lit(False))).collect() == []
