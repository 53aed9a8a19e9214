"""Queries without a SQL twin against plain versions on the derived tables."""

import math
from collections import Counter, defaultdict

import pytest

from planfold import catalog
from planfold.sources.fixtures import Views

catalog.load()


@pytest.fixture(scope="module")
def v(spark, sf):
    return Views(spark, sf)


def run(spark, sf, name):
    return catalog.QUERIES[name](spark, sf).collect()


def groups(nodes, near):
    """{node: least node reachable} by depth-first search."""
    out = {}
    for start in sorted(nodes):
        work = [start]
        while work:
            x = work.pop()
            if x not in out:
                out[x] = start
                work += near[x]
    return out


def test_free_regions(spark, sf, v):
    blocked = defaultdict(set)
    for z in v.zones.collect():
        blocked[z.plan_id] |= {(i, j) for i in range(z.x // 500, (z.x + z.w) // 500 + 1) for j in range(z.y // 500, (z.y + z.h) // 500 + 1)}
    expected = Counter()
    for p in v.plans.collect():
        free = {(i, j) for i in range(math.ceil(p.max_x / 500)) for j in range(math.ceil(p.max_y / 500))} - blocked[p.plan_id]
        found = groups(free, {(i, j): [c for c in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)) if c in free] for i, j in free})
        parts = defaultdict(list)
        for cell, root in found.items():
            parts[root].append(cell)
        for cells in parts.values():
            xs, ys = zip(*cells, strict=True)
            expected[p.plan_id, len(cells), min(xs), max(xs), min(ys), max(ys)] += 1
    assert Counter((r.plan_id, r.cells, r.i1, r.i2, r.j1, r.j2) for r in run(spark, sf, "R10_free_regions")) == expected


def gap(a, b):
    """Distance of rectangles (x, y, w, h)."""
    dx, dy = (max(0, a[k] - b[k] - b[k + 2], b[k] - a[k] - a[k + 2]) for k in (0, 1))
    return math.hypot(dx, dy)


def test_exits_off_the_main_component(spark, sf, v):
    corridors, exits = defaultdict(dict), defaultdict(dict)
    for c in v.corridors.collect():
        corridors[c.plan_id][c.corridor_id] = (c.x, c.y, c.w, c.h)
    for e in v.exits.collect():
        exits[e.plan_id][e.exit_id] = (e.x, e.y, 0, 0)
    expected = {}
    for plan, found in corridors.items():
        near = {a: [b for b in found if b != a and gap(found[a], found[b]) < 50] for a in found}
        part = groups(found, near)
        sizes = Counter(part.values())
        main = min(sizes, key=lambda c: (-sizes[c], c))
        for e, point in exits[plan].items():
            d = min(gap(found[c], point) for c in found if part[c] == main)
            if d >= 500:
                expected[plan, e] = round(d, 4)
    assert {(r.plan_id, r.exit_id): round(r.distance, 4) for r in run(spark, sf, "R11_exits_off_main")} == expected


def test_splits(spark, sf, v):
    got = run(spark, sf, "M4_splits")
    assert got == run(spark, sf, "M4_splits") or sorted(map(tuple, got)) == sorted(map(tuple, run(spark, sf, "M4_splits")))
    total = Counter()
    for r in got:
        total[r.part] += r.n
    n = v.entities.count()
    assert sum(total.values()) == n
    assert all(abs(total[part] / n - share) < 0.03 for part, share in (("train", 0.7), ("validation", 0.15), ("test", 0.15)))


def test_room_classifier(spark, sf):
    got = run(spark, sf, "M8_room_classifier")
    assert sum(r.n for r in got if r.truth == r.said) >= 0.8 * sum(r.n for r in got)
