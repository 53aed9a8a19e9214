"""Operators on networks against plain versions, on small plans made here and on the derived tables."""

import heapq
import math
import random

from planfold import catalog
from planfold.operators import checks, networks, standards
from planfold.sources.fixtures import Views

catalog.load()


def greedy(pairs):
    used, out = set(), []
    for d, a, b in sorted(pairs):
        if a not in used and b not in used:
            used |= {a, b}
            out.append((d, a, b))
    return out


def plain_fillers(walls):
    """walls: {wall_id: (x1, y1, x2, y2)} of one plan -> segments by pass."""
    now, before, out = dict(walls), math.inf, []
    for k in range(3):
        ends = [(2 * w + i, w, *p[2 * i : 2 * i + 2]) for w, p in now.items() for i in (0, 1)]
        at = {e[0]: e[2:] for e in ends}
        pairs = [(d, *sorted((a[0], b[0]))) for i, a in enumerate(ends) for b in ends[:i] if a[1] != b[1] and 1 < (d := math.hypot(a[2] - b[2], a[3] - b[3])) < 200]
        gaps = greedy(pairs)
        if not gaps or len(gaps) >= before:
            break
        before = len(gaps)
        for d, a, b in gaps:
            if d >= 50:
                out.append((k + 1, *at[a], *at[b]))
                now[-(a * 3 + k) - 1] = (*at[a], *at[b])
    return out


def test_gap_fillers(spark):
    rng, rows = random.Random(4), []
    for plan in (1, 2, 3):
        for w in range(plan * 100, plan * 100 + 25):
            x, y = rng.randrange(900), rng.randrange(900)
            rows.append((plan, w, x, y, x + rng.choice([0, 120]), y + rng.choice([0, 90])))
    df = spark.createDataFrame(rows, "plan_id long, wall_id long, x1 long, y1 long, x2 long, y2 long")
    got = {}
    for r in networks.gap_fillers(df)[0].collect():
        got.setdefault(r.plan_id, []).append((r["pass"], r.x1, r.y1, r.x2, r.y2))
    for plan in (1, 2, 3):
        assert sorted(got.get(plan, [])) == sorted(plain_fillers({w: p for q, w, *p in rows if q == plan}))


def kruskal(nodes):
    """nodes: [(id, x, y, component)] -> total length and number of the shortest bridges."""
    parent = {c: c for *_, c in nodes}

    def root(c):
        while parent[c] != c:
            c = parent[c]
        return c

    out = []
    for d, a, b, p, q in sorted((math.hypot(a[1] - b[1], a[2] - b[2]), *sorted((a[0], b[0])), a[3], b[3]) for i, a in enumerate(nodes) for b in nodes[:i]):
        if root(p) != root(q):
            parent[root(p)] = root(q)
            out.append((a, b, round(d, 6)))
    return sorted(out)


def test_bridges_make_a_shortest_tree(spark):
    rng, rows = random.Random(9), []
    for plan in (1, 2):
        rows += [(plan, plan * 1000 + i, rng.randrange(20_000), rng.randrange(20_000), plan * 100 + i % 9) for i in range(40)]
    rows.append((3, 5000, 1, 1, 300))
    df = spark.createDataFrame(rows, "plan_id long, id long, x long, y long, component long")
    got = sorted((r.a, r.b, round(r.distance, 6)) for r in networks.bridge_report(df, reach=500).collect())
    assert got == sorted(e for plan in (1, 2) for e in kruskal([r[1:] for r in rows if r[0] == plan]))


def plain_routes(connectors, links):
    """Dijkstra over the complete floors of each plan: {upper connector: (cost to the lowest level of its component)}."""
    at = {c["connector_id"]: c for c in connectors}
    near = {k: {} for k in at}
    by_floor = {}
    for c in connectors:
        by_floor.setdefault((c["plan_id"], c["floor_level"]), []).append(c["connector_id"])
    flat = lambda a, b: math.hypot(at[a]["x"] - at[b]["x"], at[a]["y"] - at[b]["y"])
    for floor in by_floor.values():
        for i, a in enumerate(floor):
            for b in floor[:i]:
                near[a][b] = near[b][a] = flat(a, b)
    for a, b in links:
        near[a][b] = near[b][a] = 1.4 * math.hypot(flat(a, b), 320 * abs(at[a]["floor_level"] - at[b]["floor_level"]))
    out, seen = {}, set()
    for start in at:
        if start in seen:
            continue
        part, work = set(), [start]
        while work:
            x = work.pop()
            if x not in part:
                part.add(x)
                work += near[x]
        seen |= part
        base = min(at[x]["floor_level"] for x in part)
        cost, heap = {}, [(0.0, x) for x in part if at[x]["floor_level"] == base]
        while heap:
            d, x = heapq.heappop(heap)
            if x not in cost:
                cost[x] = d
                for y, w in near[x].items():
                    heapq.heappush(heap, (d + w, y))
        out |= {x: cost[x] for x in part if at[x]["floor_level"] != base}
    return out


def test_cross_floor_routes(spark, sf):
    v = Views(spark, sf)
    connectors = [r.asDict() for r in v.connectors.collect()]
    links = [(r.a_id, r.b_id) for r in catalog.QUERIES["J14_connector_candidates"](spark, sf).collect()]
    expected = plain_routes(connectors, links)
    routes, segments = networks.cross_floor_routes(v.connectors, spark.createDataFrame(links, "a_id long, b_id long"))
    got = {r.from_id: r for r in routes.collect()}
    assert set(got) == set(expected) and all(abs(got[k].cost - expected[k]) < 1e-6 for k in got)
    level = {c["connector_id"]: c["floor_level"] for c in connectors}
    assert all(level[r.to_id] <= min(level[r.from_id], 3) for r in got.values())
    used = segments.collect()
    assert len({(r.a_id, r.b_id) for r in used}) == len(used) and all(r.a_id < r.b_id for r in used)
    assert {r.type for r in used} == {"horizontal", "vertical"}
    assert all((level[r.a_id] == level[r.b_id]) == (r.type == "horizontal") for r in used)


def test_level_hops_have_no_limit(spark):
    df = spark.createDataFrame([(1, i, i + 1) for i in range(9)] + [(1, 0, 5), (2, 0, 1)], "plan_id long, low int, high int")
    got = {(r.plan_id, r.from_level, r.to_level): r.hops for r in networks.level_hops(df).collect()}
    for a in range(10):
        for b in range(a + 1, 10):
            assert got[1, a, b] == min(b - a, a + 1 + abs(b - 5))
    assert got[2, 0, 1] == 1 and len(got) == 46


def test_distinct_zones(spark):
    rng = random.Random(3)
    rows = [(1 + i % 2, i, rng.randrange(600), rng.randrange(600), 200 + rng.randrange(200), 300) for i in range(80)]
    df = spark.createDataFrame(rows, "plan_id long, zone_id long, x long, y long, w long, h long")
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4] * r[5], r[1])):
        if not any(k[0] == r[0] and abs(k[4] * k[5] - r[4] * r[5]) < 50_000 and math.hypot(k[2] - r[2], k[3] - r[3]) < 100 for k in kept):
            kept.append(r)
    assert sorted(r.zone_id for r in networks.distinct_zones(df).collect()) == sorted(r[1] for r in kept)


def test_palette_and_colours(spark):
    p = standards.palette()
    assert len(p) == 256 and p[1] == (255, 0, 0) and p[35] == (255, 159, 0) and p[251] == (91, 91, 91) and p[230] == (185, 20, 141)
    df = spark.createDataFrame([(1,), (4,), (50,), (12,), (3,), (200,), (255,), (300,)], "color int")
    got = [(r.t, float(r.c)) for r in df.select(standards.colour_class(df.color).alias("k")).selectExpr("k.type as t", "k.confidence as c").collect()]
    assert got[:4] == [("entrance", 0.9), ("forbidden", 0.9), ("corridor", 0.9), ("entrance", 0.7)] and got[6] == ("wall", 0.9)
    df = spark.createDataFrame([(7,), (0xFF0000,), (0x00FFFE,), (None,), (-3,)], "value long")
    assert [r.i for r in df.select(standards.colour_index(df.value).alias("i")).collect()] == [7, 1, 4, 0, 0]


def test_literals(spark):
    df = spark.createDataFrame([("A-OFFICE", 3.0), ("Conference", 3.0), ("x", 4.9), (None, 15.0), ("x", 30.0)], "layer string, area double")
    assert [r.t for r in df.select(checks.room_type(df.layer, df.area).alias("t")).collect()] == ["office", "meeting", "small_office", "large_office", "open_space"]
    h = spark.createDataFrame([("m", i, 1.0 / (i + 1), None, v, 0.5) for i, v in enumerate([3.0, 1.0, 1.0, 2.0])], "model string, step int, loss double, acc double, val_loss double, val_acc double")
    (r,) = checks.history_metrics(h).collect()
    assert (r.final_loss, r.final_accuracy, r.final_val_loss, r.epochs, r.best_epoch) == (0.25, None, 2.0, 4, 2)
    plan = spark.createDataFrame([(1, 0, 0, 2000, 1000)], "plan_id long, min_x long, min_y long, max_x long, max_y long")
    corridors = spark.createDataFrame([(1, 10, 0, 90, 1000, 20), (1, 11, 490, 0, 20, 600), (1, 12, 1200, 95, 500, 20)], "plan_id long, corridor_id long, x long, y long, w long, h long")
    walls = spark.createDataFrame([(1, 1, 800, 0, 800, 300)], "plan_id long, wall_id long, x1 long, y1 long, x2 long, y2 long")
    got = {(r.kind, r.x1, r.y1, r.x2, r.y2): (r.length, r.blocked) for r in networks.centreline_edges(plan, corridors, walls).collect()}
    assert got == {
        ("corridor", 0.0, 100.0, 500.0, 100.0): (500.0, False), ("corridor", 500.0, 100.0, 1000.0, 100.0): (500.0, True), ("corridor", 500.0, 0.0, 500.0, 100.0): (100.0, False),
        ("corridor", 500.0, 100.0, 500.0, 600.0): (500.0, False), ("corridor", 1200.0, 105.0, 1700.0, 105.0): (500.0, False),
    } | {k: v for k, v in got.items() if k[0] == "bridge"}
    # the wall is in the way of the bridge from (500, 100) to (1200, 105); nodes on one centreline that aren't neighbours are bridged
    assert {k[1:] for k in got if k[0] == "bridge"} <= {(500.0, 0.0, 500.0, 600.0)}


def plain_graph(corridors, walls, most):
    """Edges along centrelines with blocked, and bridges, of one plan by loops."""
    lines = [(True, y + h / 2, x, x + w) if w >= h else (False, x + w / 2, y, y + h) for x, y, w, h in corridors]

    def crosses(a, b):
        d = (a[0] - a[2]) * (b[1] - b[3]) - (a[1] - a[3]) * (b[0] - b[2])
        if d == 0:
            return False
        t = ((a[0] - b[0]) * (b[1] - b[3]) - (a[1] - b[1]) * (b[0] - b[2])) / d
        u = -((a[0] - a[2]) * (a[1] - b[1]) - (a[1] - a[3]) * (a[0] - b[0])) / d
        return 0.01 < t < 0.99 and 0.01 < u < 0.99

    edges = {}
    for flat, c, s, e in lines:
        at = sorted({s, e} | {d for f, d, s2, e2 in lines if f != flat and s <= d <= e and s2 <= c <= e2})
        for a, b in zip(at, at[1:], strict=False):
            if b - a >= 20:
                edge = (a, c, b, c) if flat else (c, a, c, b)
                edges[edge] = any(crosses(edge, w) for w in walls)
    nodes = sorted({p for e, blocked in edges.items() if not blocked for p in (e[:2], e[2:])})
    aligned = lambda d, off: 30 <= d <= most and abs(off) <= 25
    pairs = [(*a, *b) for a in nodes for b in nodes if aligned(b[0] - a[0], b[1] - a[1]) or aligned(b[1] - a[1], b[0] - a[0])]
    joined = {x for e, blocked in edges.items() if not blocked for x in (e, e[2:] + e[:2])}
    return {("corridor", *e, blocked) for e, blocked in edges.items()} | {("bridge", *p, False) for p in pairs if p not in joined and not any(crosses(p, w) for w in walls)}


def test_centreline_graph_against_loops(spark):
    rng = random.Random(8)
    tables, expected = {"plans": [], "corridors": [], "walls": []}, set()
    for plan, wide in ((1, 2000), (2, 6000)):
        at = lambda: rng.randrange(-300, 2000) // 25 * 25
        corridors = [(at(), at(), *rng.choice([(rng.randrange(50, 700, 25), 50), (50, rng.randrange(60, 700, 25))])) for _ in range(45)]
        corridors += corridors[:3] + [(x, y, w + 100, h) if w >= h else (x, y, w, h + 100) for x, y, w, h in corridors[:6]]  # equal edges, and several from one node
        walls = [(at(), at(), at(), at()) for _ in range(6)]
        tables["plans"].append((plan, -300, -300, wide - 300, 2000))
        tables["corridors"] += [(plan, 100 * plan + i, *c) for i, c in enumerate(corridors)]
        tables["walls"] += [(plan, i, *w) for i, w in enumerate(walls)]
        expected |= {(plan, *e) for e in plain_graph(corridors, walls, max(400, wide * 0.15))}
    names = {"plans": "plan_id long, min_x long, min_y long, max_x long, max_y long", "corridors": "plan_id long, corridor_id long, x long, y long, w long, h long", "walls": "plan_id long, wall_id long, x1 long, y1 long, x2 long, y2 long"}
    got = networks.centreline_edges(*(spark.createDataFrame(tables[k], names[k]) for k in names)).select("plan_id", "kind", "x1", "y1", "x2", "y2", "blocked").collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected
    assert {(r.kind, r.blocked) for r in got} == {("corridor", True), ("corridor", False), ("bridge", False)}


def test_merged_rectangles(spark):
    rng = random.Random(21)
    rows = [(1 + i % 2, i, rng.randrange(3000), rng.randrange(3000), 40 + rng.randrange(400), 30 + rng.randrange(200)) for i in range(70)]
    df = spark.createDataFrame(rows, "plan_id long, id long, x long, y long, w long, h long")
    expected = []
    for plan in (1, 2):
        left = [list(r[1:]) + [1] for r in rows if r[0] == plan]
        done = False
        while not done:
            done = True
            for i, a in enumerate(left):
                j = next((j for j in range(i) if all(a[k] <= left[j][k] + left[j][k + 2] + 15 and left[j][k] <= a[k] + a[k + 2] + 15 for k in (1, 2))), None)
                if j is not None:
                    b = left[j]
                    x, y = min(a[1], b[1]), min(a[2], b[2])
                    left[j] = [min(a[0], b[0]), x, y, max(a[1] + a[3], b[1] + b[3]) - x, max(a[2] + a[4], b[2] + b[4]) - y, a[5] + b[5]]
                    del left[i]
                    done = False
                    break
        expected += [(plan, *r) for r in left]
    got = networks.merged_rectangles(df, ["plan_id"]).select("plan_id", "id", "x", "y", "w", "h", "n").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected))
