"""Free regions, clean-up and page gates against plain versions."""

import math
import random
from collections import Counter

import pytest

from planfold import catalog
from planfold.operators import cleanup, pages, raster
from planfold.plans import rasters
from planfold.sources.fixtures import Views

PLAN = "plan_id long, min_x int, min_y int, max_x int, max_y int"
WALL = "plan_id long, wall_id long, x1 int, y1 int, x2 int, y2 int"
RECT = "plan_id long, x int, y int, w int, h int"


def plain_line(c1, r1, c2, r2):
    """Cells of a line, one step at a time by its error."""
    cells, c, r = [], c1, r1
    dc, dr, sc, sr = abs(c2 - c1), abs(r2 - r1), 1 if c1 < c2 else -1, 1 if r1 < r2 else -1
    err = dc - dr
    while True:
        cells.append((c, r))
        if (c, r) == (c2, r2):
            return cells
        twice = 2 * err
        if twice > -dr:
            err, c = err - dr, c + sc
        if twice < dc:
            err, r = err + dc, r + sr


def plain_regions(plan, walls, zones, exits, cell, buffers, least):
    x0, y0, x1, y1 = plan
    cols, rows = math.ceil((x1 - x0) / cell), math.ceil((y1 - y0) / cell)
    blocked = set()
    for a, b, c, d in walls:
        for col, row in plain_line((a - x0) // cell, (b - y0) // cell, (c - x0) // cell, (d - y0) // cell):
            n = math.ceil(buffers[0] / cell)
            blocked |= {(col + i, row + j) for i in range(-n, n + 1) for j in range(-n, n + 1)}
    for found, buffer in ((zones, buffers[1]), (exits, buffers[2])):
        n = math.ceil(buffer / cell)
        for x, y, w, h in found:
            blocked |= {(i, j) for i in range((x - x0) // cell - n, math.ceil((x + w - x0) / cell) + n + 1) for j in range((y - y0) // cell - n, math.ceil((y + h - y0) / cell) + n + 1)}
    open_ = {(i, j) for j in range(rows) for i in range(cols)} - blocked
    out = []
    for start in sorted(open_, key=lambda p: (p[1], p[0])):
        if start not in open_:
            continue
        region, work = [], [start]
        open_.discard(start)
        while work:
            i, j = work.pop()
            region.append((i, j))
            for p in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if p in open_:
                    open_.discard(p)
                    work.append(p)
        if len(region) * cell * cell / 10000 >= least:
            xs, ys = zip(*region, strict=True)
            out.append((len(region), x0 + min(xs) * cell, y0 + min(ys) * cell, x0 + (max(xs) + 1) * cell, y0 + (max(ys) + 1) * cell))
    return sorted(out, key=lambda r: -r[0])


@pytest.mark.parametrize("tile", [64, 5])
def test_free_regions(spark, monkeypatch, tile):
    monkeypatch.setattr(raster, "TILE", tile)
    r, plans, walls, zones, exits, expected = random.Random(tile), [], [], [], [], {}
    for plan in range(4):
        x0, y0 = r.choice([(0, 0), (-5000, 777), (40_000_000, -123)])
        bounds = (x0, y0, x0 + r.randrange(1500, 4000), y0 + r.randrange(1500, 3000))
        point = lambda: (r.randrange(bounds[0] - 200, bounds[2] + 200), r.randrange(bounds[1] - 200, bounds[3] + 200))  # noqa: B023, E731
        w = [(*point(), *point()) for _ in range(4)] + [(p[0], p[1], p[0] + 900, p[1]) for p in [point(), point()]] + [(*point(),) * 2]
        z = [(*point(), r.randrange(10, 400), r.randrange(10, 400)) for _ in range(2)]
        e = [(*point(), 0, 0)]
        plans.append((plan, *bounds))
        walls += [(plan, i, *x) for i, x in enumerate(w)]
        zones += [(plan, *x) for x in z]
        exits += [(plan, *x) for x in e]
        expected[plan] = plain_regions(bounds, w, z, e, 50, (30, 60, 100), 2.0)
    got = raster.free_regions(spark.createDataFrame(plans, PLAN), spark.createDataFrame(walls, WALL), spark.createDataFrame(zones, RECT), spark.createDataFrame(exits, RECT), zone=60, exit=100, least=2.0).collect()
    for plan, found in expected.items():
        mine = sorted((x for x in got if x.plan_id == plan), key=lambda x: x.region)
        assert [(x.cells, x.x1, x.y1, x.x2, x.y2) for x in mine] == found
        assert [x.region for x in mine] == list(range(1, len(found) + 1))


def test_small_regions_go(spark):
    none = spark.createDataFrame([], RECT)
    wall = spark.createDataFrame([(1, 1, 425, 0, 425, 1000)], WALL)
    got = raster.free_regions(spark.createDataFrame([(1, 0, 0, 1000, 450)], PLAN), wall, none, none).collect()
    assert [(x.cells, x.area, x.x1, x.x2) for x in got] == [(90, 22.5, 500, 1000)]  # the 15.75 square metres on the left are too few


@pytest.mark.parametrize("tile", [256, 3])
def test_regions_of_cells_have_their_least_name(spark, monkeypatch, tile):
    """Only regions that meet another tile's go through the components of a graph, by tile and not by cell."""
    monkeypatch.setattr(raster, "TILE", tile)
    real, seen = raster.graph.components, []
    monkeypatch.setattr(raster.graph, "components", lambda nodes, edges: seen.append(nodes.distinct().count()) or real(nodes, edges))
    size = spark.createDataFrame([(1, 12, 7, -1, 8), (2, 2, 2, 0, 0)], "plan_id long, cols long, rows long, c0 long, r0 long")
    wall = spark.createDataFrame([(1, 6, -4, 6, 5), (1, 6, 6, 6, 90), (1, 9, 3, 20, 3)] + [(2, 0, 0, 5, 5)], "plan_id long, c1 long, r1 long, c2 long, r2 long")
    open_ = {(c, r) for c in range(12) for r in range(7)} - {(6, r) for r in range(7)} - {(c, 3) for c in range(9, 12)}
    left, right = {p for p in open_ if p[0] < 6}, {p for p in open_ if p[0] > 6}
    name = lambda cells: min(f"{c - 1}/{r + 8}" for c, r in cells)
    got = {(r.plan_id, r.cells, r.c1, r.r1, r.c2, r.r2, r.first, r.name) for r in raster.joined_regions(size, wall, named=True).collect()}
    assert got == {(1, 42, 0, 0, 5, 6, 0, name(left)), (1, 32, 7, 0, 11, 6, 7, name(right))}
    assert seen == ([] if tile == 256 else [12])


def overlap(a, b, inset=0):
    return all(a[k] < b[k] + b[k + 2] - inset and a[k] + a[k + 2] > b[k] + inset for k in (0, 1))


def meets(s, x, y, x2, y2):
    low, high = 0.0, 1.0
    for p, q, a, b in ((s[0], s[2], x, x2), (s[1], s[3], y, y2)):
        d = q - p
        if abs(d) < 1e-8:
            if p < a or p > b:
                return False
            continue
        t, u = sorted(((a - p) / d, (b - p) / d))
        low, high = max(low, t), min(high, u)
    return low <= high


def centreline(c):
    x, y, w, h = c
    return (x, y + h / 2, x + w, y + h / 2) if w >= h else (x + w / 2, y, x + w / 2, y + h)


def crossing(p, s):
    rx, ry, sx, sy = p[2] - p[0], p[3] - p[1], s[2] - s[0], s[3] - s[1]
    d = rx * sy - ry * sx
    if abs(d) < 1e-6:
        return False
    t, u = ((s[0] - p[0]) * sy - (s[1] - p[1]) * sx) / d, ((s[0] - p[0]) * ry - (s[1] - p[1]) * rx) / d
    return 0.01 < t < 0.99 and 0.01 < u < 0.99


def distance(px, py, s):
    dx, dy = s[2] - s[0], s[3] - s[1]
    t = max(0, min(1, ((px - s[0]) * dx + (py - s[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
    return math.hypot(px - s[0] - t * dx, py - s[1] - t * dy)


def split(c, walls):
    flat = c[2] >= c[3]
    line, start, end, blocks = (c[1] + c[3] / 2 if flat else c[0] + c[2] / 2), (c[0] if flat else c[1]), (c[0] + c[2] if flat else c[1] + c[3]), []
    for x1, y1, x2, y2 in walls:
        (u1, v1), (u2, v2) = ((x1, y1), (x2, y2)) if flat else ((y1, x1), (y2, x2))
        if not min(v1, v2) - 4.5 <= line <= max(v1, v2) + 4.5:
            continue
        if v1 == v2:
            blocks.append((min(u1, u2) - 4.5, max(u1, u2) + 4.5))
        elif -1e-6 <= (t := (line - v1) / (v2 - v1)) <= 1 + 1e-6:
            blocks.append((u1 + (u2 - u1) * t - 4.5, u1 + (u2 - u1) * t + 4.5))
    blocks = sorted((max(start, a), min(end, b)) for a, b in blocks if min(end, b) > max(start, a))
    if not blocks:
        return [c]
    out, at = [], start
    for a, b in [*blocks, (end, end)]:
        if a - at >= 90:
            out.append((at, c[1], a - at, c[3]) if flat else (c[0], at, c[2], a - at))
        at = max(at, b)
    return out


def conflict(a, b):
    if (a[2] >= a[3]) != (b[2] >= b[3]):
        return False
    p, q, s, r = (1, 0, 3, 2) if a[2] >= a[3] else (0, 1, 2, 3)
    if abs(a[p] + a[s] / 2 - b[p] - b[s] / 2) > max(3, min(a[s], b[s]) * 0.45):
        return False
    common = min(a[q] + a[r], b[q] + b[r]) - max(a[q], b[q])
    return common > 0 and common >= min(a[r], b[r]) * 0.45


def plain_cleanup(bounds, boxes, corridors, walls, zones, entrances, retain):
    x0, y0, x1, y1 = bounds
    n, kept, parts = Counter(), [], 0
    for c in corridors:
        for p in split(c, walls):
            parts += 1
            if p[2] < 5 or p[3] < 5:
                n["corridor_small"] += 1
            elif p[0] < x0 or p[1] < y0 or p[0] + p[2] > x1 or p[1] + p[3] > y1:
                n["corridor_bounds"] += 1
            elif any(crossing(centreline(p), w) and meets(w, p[0], p[1], p[0] + p[2], p[1] + p[3]) for w in walls):
                n["corridor_wall"] += 1
            elif any(overlap(p, z) for z in zones):
                n["corridor_obstacle"] += 1
            elif any(conflict(p, k) for k in kept):
                n["corridor_conflict"] += 1
            else:
                kept.append(p)
    if not retain:
        label = list(range(len(kept)))
        for i, a in enumerate(kept):
            for j in range(i):
                b = kept[j]
                la, lb = centreline(a), centreline(b)
                if overlap(a, b) or any(distance(*e, s) <= 12 for s, o in ((lb, la), (la, lb)) for e in (o[:2], o[2:])):
                    x, y = label[i], label[j]
                    label = [min(x, y) if v in (x, y) else v for v in label]
        groups = {}
        for v, k in zip(label, kept, strict=True):
            groups.setdefault(v, []).append(k)
        length = {v: sum(max(k[2:]) for k in g) for v, g in groups.items()}
        seeded = {v for v, g in groups.items() if any(overlap(k, e) or meets(centreline(k), e[0], e[1], e[0] + e[2], e[1] + e[3]) for k in g for e in entrances)}
        stay = {v for v in groups if (v in seeded or length[v] >= 180) if seeded} or {v for v in groups if not seeded and (length[v] >= 180 or len(groups[v]) > 1)} or ({max(length, key=length.get)} if length else set())
        n["corridor_unreachable"] = sum(len(g) for v, g in groups.items() if v not in stay)
        kept = [k for v, k in zip(label, kept, strict=True) if v in stay]
    safe, guard = [], 21.6
    inner = [(k[0] + guard, k[1] + guard, k[2] - 2 * guard, k[3] - 2 * guard) if min(k[2:]) > 2 * guard else k for k in kept]
    for f, *b in boxes:
        x, y, w, h = b
        if x < x0 + 10 or y < y0 + 10 or x + w > x1 - 10 or y + h > y1 - 10:
            n["box_bounds"] += 1
        elif any(meets(s, x - 10, y - 10, x + w + 10, y + h + 10) for s in walls):
            n["box_wall"] += 1
        elif any(overlap(b, z) for z in zones) or any(overlap(b, e, -31.2) for e in entrances):
            n["box_obstacle"] += 1
        elif any(overlap(b, k, 2) for k in inner):
            n["box_corridor"] += 1
        elif any(g == f and overlap(b, k, 2) for g, *k in safe):
            n["box_overlap"] += 1
        else:
            safe.append((f, *b))
    return {**n, "parts": parts, "corridors_kept": len(kept), "boxes_kept": len(safe), "corridors": len(corridors), "boxes": len(boxes), "corridors_removed": max(0, len(corridors) - len(kept)), "boxes_removed": len(boxes) - len(safe)}


@pytest.mark.parametrize("retain", [False, True])
def test_cleanup_of_random_layouts(spark, retain):
    r, tables, expected = random.Random(retain), {k: [] for k in ("plans", "boxes", "corridors", "walls", "zones", "entrances")}, {}
    for plan in range(5):
        size = r.randrange(1500, 3000)
        at = lambda: r.randrange(-50, size)  # noqa: B023, E731
        corridors = [(at(), at(), *r.choice([(r.randrange(40, 900), r.randrange(30, 150)), (r.randrange(30, 150), r.randrange(40, 900))])) for _ in range(25)]
        corridors += [(x + 15, y + 2, w, h) for x, y, w, h in corridors[:6]]
        walls = [(x := at(), y := at(), x, y + 700) for _ in range(3)] + [(at(), at(), at(), at()) for _ in range(2)]
        boxes = [(r.randrange(2), at(), at(), r.randrange(20, 250), r.randrange(20, 250)) for _ in range(80)]
        zones = [(at(), at(), r.randrange(50, 300), r.randrange(50, 300)) for _ in range(2)]
        entrances = [(at(), at(), 66, 66) for _ in range(plan % 3)]
        bounds = (0, 0, size, size)
        expected[plan] = plain_cleanup(bounds, boxes, corridors, walls, zones, entrances, retain)
        tables["plans"].append((plan, *bounds))
        tables["boxes"] += [(plan, f, 1000 * plan + i, *b) for i, (f, *b) in enumerate(boxes)]
        tables["corridors"] += [(plan, 1000 * plan + i, *c) for i, c in enumerate(corridors)]
        tables["walls"] += [(plan, i, *w) for i, w in enumerate(walls)]
        tables["zones"] += [(plan, *z) for z in zones]
        tables["entrances"] += [(plan, *e) for e in entrances]
    schemas = {"plans": PLAN, "boxes": "plan_id long, floor_level int, box_id long, x int, y int, w int, h int", "corridors": "plan_id long, corridor_id long, x int, y int, w int, h int", "walls": WALL, "zones": RECT, "entrances": RECT}
    got = cleanup.cleaned_layout(*(spark.createDataFrame(tables[k], schemas[k]) for k in ("plans", "boxes", "corridors", "walls", "zones", "entrances")), retain=retain)
    for row in got.collect():
        said = row.asDict()
        plan = said.pop("plan_id")
        assert said == {**dict.fromkeys(said, 0), **expected[plan]}, plan


def test_cleanup_of_the_tables_heeds_all_zones(spark, sf):
    catalog.load()
    v = Views(spark, sf)
    of = lambda df, *columns: [tuple(r) for r in df.orderBy(*df.columns[1:2]).select("plan_id", *columns).collect()]
    plans, rect = of(v.plans, "min_x", "min_y", "max_x", "max_y"), ("x", "y", "w", "h")
    rows = {"boxes": of(v.boxes.select("plan_id", "box_id", "floor_level", *rect), "floor_level", *rect), "corridors": of(v.corridors.select("plan_id", "corridor_id", *rect), *rect), "walls": of(v.walls, "x1", "y1", "x2", "y2")}
    rows |= {"zones": of(v.zones.select("plan_id", "zone_id", *rect), *rect), "entrances": of(rasters.entrances(v), *rect)}
    got = {r.plan_id: r.asDict() for r in catalog.QUERIES["J24_layout_cleanup"](spark, sf).collect()}
    assert len(got) == len(plans)
    for plan, *bounds in plans:
        said = got[plan]
        expected = plain_cleanup(bounds, *([r[1:] for r in rows[k] if r[0] == plan] for k in ("boxes", "corridors", "walls", "zones", "entrances")), False)
        assert said == {**dict.fromkeys(said, 0), **expected, "plan_id": plan}, plan


def sheet(spark, change=lambda x, y, c: c, width=100, height=80):
    """A page with a green border, blue lines, black text in its blocks and a red mark; the other side is what change makes of it."""
    rows = []
    for y in range(height):
        for x in range(width):
            c = (255, 255, 255)
            if x in (0, width - 1) or y in (0, height - 1):
                c = (20, 180, 20)
            elif (x, y) == (50, 40):
                c = (200, 20, 20)
            elif x % 9 == 4 and x < 70:
                c = (30, 30, 200)
            elif (x + y) % 5 == 0:
                c = (10, 10, 10)
            rows.append((7, "reference", x, y, *c))
            if (d := change(x, y, c)) is not None:
                rows.append((7, "generated", x, y, *d))
    return spark.createDataFrame(rows, "doc long, side string, x int, y int, r int, g int, b int"), spark.createDataFrame([(7, width, height, 0.0, True)], "doc long, width int, height int, aspect_difference double, same_page_count boolean")


def test_a_page_passes_against_itself(spark):
    (r,) = pages.page_gates(*sheet(spark)).collect()
    assert r.passed and (r.mae, r.rmse, r.similarity) == (0, 0, 1) and r.edge_density == r.reference_edge_density > 0


@pytest.mark.parametrize(
    "change,failed",
    [
        (lambda x, y, c: (255, 255, 255), {"similarity_minimum": False, "has_blue_structure": False, "has_green_border": False, "structural_border_presence": False, "structural_wall_context_presence": False, "has_nonwhite_content": False}),
        (lambda x, y, c: (255, 255, 255) if x > 70 and y > 60 else c, {"structural_title_block_occupancy": False, "structural_legend_region_occupancy": True, "structural_checks_pass": False, "has_blue_structure": True}),
        (lambda x, y, c: (255, 255, 255) if c == (200, 20, 20) else c, {"has_red_radiators": False, "structural_checks_pass": True}),
    ],
)
def test_gates_that_a_page_fails(spark, change, failed):
    (r,) = pages.page_gates(*sheet(spark, change)).collect()
    assert not r.passed
    assert {k: r[k] for k in failed} == failed


def test_region_metrics_against_loops(spark):
    pixels, sheets = sheet(spark, lambda x, y, c: ((c[0] + 7 * x) % 256, (c[1] + y) % 256, c[2]), 61, 47)
    side = {(r.side, r.x, r.y): (r.r, r.g, r.b) for r in pixels.collect()}
    for row in pages.region_metrics(pixels, sheets).collect():
        a, b, c, d = pages.REGIONS[row.region]
        x0, y0 = max(0, min(60, int(a * 61))), max(0, min(46, int(b * 47)))
        x1, y1 = max(x0 + 1, min(61, int(c * 61))), max(y0 + 1, min(47, int(d * 47)))
        l = lambda x, y: (77 * side[row.side, x, y][0] + 150 * side[row.side, x, y][1] + 29 * side[row.side, x, y][2]) >> 8  # noqa: B023, E731, E741
        steps = [(x, y) for y in range(y0, y1 - 2, 2) for x in range(x0, x1 - 2, 2)]
        edges = sum(abs(l(x, y) - l(x + 2, y)) > 28 or abs(l(x, y) - l(x, y + 2)) > 28 for x, y in steps)
        assert row.pixels == (x1 - x0) * (y1 - y0)
        assert abs(row.edge_density - (edges / len(steps) if steps else 0)) < 1e-12
        black = sum(max(side[row.side, x, y]) < 80 for x in range(x0, x1) for y in range(y0, y1))
        assert abs(row.black_ratio - black / row.pixels) < 1e-12
