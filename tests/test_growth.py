"""What loops and joins write and ship must not grow beyond what is still open: rows written, cells per shape, shuffles of one view."""

import pytest
from pyspark.sql import functions as F

from planfold import catalog
from planfold.functions import text
from planfold.operators import checks, cleanup, graph, networks, rules, spatial

catalog.load()


@pytest.fixture
def cuts(monkeypatch):
    """Rows of each table that is cut."""
    rows, plain = [], graph.cut

    def counted(df):
        out = plain(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    return rows


def test_components_write_only_open_edges(spark, cuts):
    n = 400
    nodes = spark.range(n)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.id: r.component for r in graph.components(nodes, edges).collect()} == {i: 0 if i <= 40 else i for i in range(n)}
    assert sum(cuts) < 2 * n  # the nodes without edges are written once


def test_merged_rectangles_leave_settled_plans_alone(spark, cuts):
    # plan 0 grows for several rounds, 300 rectangles of other plans have nothing to merge
    rows = [(0, i, 100 * i, 40 * i * (i - 1) // 2, 90, 40 * i + 10) for i in range(1, 8)] + [(p, 1000 + p, 0, 0, 10, 10) for p in range(1, 301)]
    df = spark.createDataFrame(rows, "plan_id long, id long, x long, y long, w long, h long")
    got = networks.merged_rectangles(df, ["plan_id"]).select("plan_id", "n").collect()
    assert sorted((r.plan_id, r.n) for r in got) == [(0, 7), *((p, 1) for p in range(1, 301))]
    assert sum(c >= 300 for c in cuts) <= 2


def test_bridges_keep_the_shortest_pair_of_two_components(spark, cuts):
    # two dense clusters: all their pairs are within reach, one is a bridge
    rows = [(1, 100 * c + i, 300 * c + i, 0, 100 * c) for c in (0, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "plan_id long, id long, x long, y long, component long")
    assert [(r.a, r.b, r.distance) for r in networks.bridge_report(df, reach=1000).collect()] == [(59, 100, 241.0)]
    assert max(cuts) == 120


@pytest.mark.parametrize("name", ["J17_edge_partitions", "R3_connectivity_report", "W4_tolerance_columns"])
def test_boxes_are_derived_once(spark, sf, name):
    # the view of boxes shuffles lineitem; a query that reads it several times does so from a table
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


def test_edges_near_borders_of_stretches(spark):
    rows = [(1, 0, i, x, 5000, 100, 7) for i, x in enumerate((291, 400, 500, 90, 8000))]
    boxes = spark.createDataFrame(rows, "plan_id long, floor_level int, box_id long, x long, y long, w long, h long")
    walls = spark.createDataFrame([(1, 419, 0, 419, 10), (1, 7980, 0, 7980, 10)], "plan_id long, x1 long, y1 long, x2 long, y2 long")
    got = {(r.box_id, r.side): (r.partition, r.shared) for r in checks.edge_partitions(boxes, walls).collect()}
    ends = {(i, side): x + (100 if side == "right" else 0) for _, _, i, x, *_ in rows for side in ("left", "right")}
    for (i, side), c in ends.items():
        shared = any(j != i and s != side and abs(c - d) < 10 for (j, s), d in ends.items())
        white = not shared and (abs(c - 419) < 20 or abs(c - 7980) < 20)
        assert got[i, side] == ("white" if white else "grey", shared)
    assert len(got) == 20


@pytest.mark.parametrize("name", ["A22_search_fitness", "A22_placement_score", "R9_bridge_report"])
def test_long_reaches_have_wide_cells(spark, sf, monkeypatch, name):
    seen, plain = [], spatial.grid_join

    def spied(left, right, keys, test, cell=1000, pad=0, how="inner"):
        seen.append((cell, pad))
        return plain(left, right, keys, test, cell, pad, how)

    monkeypatch.setattr(spatial, "grid_join", spied)
    catalog.QUERIES[name](spark, sf)
    assert all(cell >= 2 * pad for cell, pad in seen) and any(pad >= 500 for _, pad in seen)
    assert name != "A22_search_fitness" or len(seen) == 2


def test_door_pairs_are_dealt_out(spark, sf):
    # a small table is one partition: the pairs of its walls must not all be one task's
    df = catalog.QUERIES["J19_doors_between_walls"](spark, sf)
    assert df.rdd.getNumPartitions() >= 4
    assert df._jdf.queryExecution().optimizedPlan().toString().upper().count("ATAN2") == 2  # once a wall, for each side


def test_scan_in_order_leaves_nodes_without_conflicts_alone(spark, cuts):
    nodes = spark.range(400).selectExpr("id", "-id as place")
    conflicts = spark.createDataFrame([(1, 2), (3, 2), (3, 4)], "a long, b long")
    assert {r.id for r in graph.kept_in_order(nodes, conflicts).collect()} == set(range(400)) - {3, 1}
    assert sum(cuts) < 40


def test_boxes_of_a_cleanup_go_to_cells_once(spark, sf, monkeypatch):
    seen, plain = [], spatial.grid_join

    def spied(left, right, keys, test, cell=1000, pad=0, how="inner"):
        seen.append((tuple(keys), "box_id" in left.columns, cell, pad))
        return plain(left, right, keys, test, cell, pad, how)

    monkeypatch.setattr(cleanup.spatial, "grid_join", spied)
    catalog.QUERIES["J24_layout_cleanup"](spark, sf)
    assert len({s for s in seen if s[1] and s[0] == ("plan_id",)}) == 1  # one shuffle for walls, zones, entrances and corridors


def test_layer_names_are_hashed_once_a_form(spark, sf):
    from planfold.plans import checks as plans
    from planfold.sources.fixtures import Views

    v = Views(spark, sf)
    samples = plans.entity_samples(v)
    plan = samples._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "RLIKE" not in plan  # names are matched in a table of forms, before the entities are joined
    said = {(r.layer, round(r.h, 6)) for r in v.entities.select("layer", text.layer_hash(F.lower("layer")).alias("h")).distinct().collect()}
    assert {round(r.layer_hash, 6) for r in samples.select("layer_hash").distinct().collect()} <= {h for _, h in said}
    assert samples.count() == v.entities.count()


def test_issues_are_summed_before_plans_join_them(spark, sf):
    plan = catalog.QUERIES["A7_scored_audit"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Project") and plan.splitlines()[1].startswith("+- Join LeftOuter")


def test_boxes_of_all_sizes_and_without_place(spark):
    sizes = [(i, x, y, w, h) for i, (x, y, w, h) in enumerate([(1990, 1990, 100, 100), (-700, 30, 500, 500), (0, 5000, 6000, 90), (2600, 10, 10, 3000), (None, 5, 50, 50), (9000, 9000, 501, 20), (4105, 4100, 20, 20)])]
    boxes = spark.createDataFrame([(1, *s) for s in sizes], "plan_id long, box_id long, x int, y int, w int, h int")
    corridors = [(0, 2100, 2100, 600, 120), (1, -2000, 0, 1201, 100), (2, 3000, 2900, 700, 900), (3, 4000, 4000, 100, 100)]
    gap = lambda a, b: max(0, a[0] - b[0] - b[2], b[0] - a[0] - a[2]) ** 2 + max(0, a[1] - b[1] - b[3], b[1] - a[1] - a[3]) ** 2
    expected = sorted(i for i, *s in sizes if s[0] is None or not any(gap(s, c) < 10000 for _, *c in corridors))
    c = spark.createDataFrame([(1, *c) for c in corridors], "plan_id long, corridor_id long, x int, y int, w int, h int")
    exits = spark.createDataFrame([(1, 0, 0, 0)], "plan_id long, exit_id long, x int, y int")
    assert sorted(r.element_id for r in rules.without_access(boxes, c, exits).collect()) == expected
    zones = c.withColumnRenamed("corridor_id", "zone_id")
    hits = [(i, k) for i, *s in sizes if s[0] is not None for k, *z in corridors if any(z[0] <= s[0] + s[2] * u <= z[0] + z[2] and z[1] <= s[1] + s[3] * t <= z[1] + z[3] for u, t in ((0, 0), (1, 0), (0, 1), (1, 1), (0.5, 0.5)))]
    assert sorted((r.box_id, r.zone_id) for r in rules.boxes_in_zones(boxes, zones).collect()) == sorted(hits)


def test_routes_broadcast_no_connectors(spark, sf):
    plan = catalog.QUERIES["R6_route_segments"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_only_corridors_of_plans_with_large_boxes_go_to_all_cells(spark, monkeypatch):
    boxes = spark.createDataFrame([(1, 0, 0, 0, 100, 100), (1, 1, 900, 900, 50, 50), (2, 2, 0, 0, 100, 100), (2, 3, 3000, 40, 501, 90), (2, 4, 6000, 0, 20, 900), (None, 5, 0, 0, 600, 600)], "plan_id long, box_id long, x int, y int, w int, h int")
    corridors = spark.createDataFrame([(1, 0, 150, 0, 600, 120), (2, 1, 3550, 100, 600, 120), (3, 2, 0, 0, 600, 120)], "plan_id long, corridor_id long, x int, y int, w int, h int")
    exits = spark.createDataFrame([(p, 0, 0, 0) for p in (1, 2)], "plan_id long, exit_id long, x int, y int")
    within, sent = spatial.within, []
    monkeypatch.setattr(spatial, "within", lambda left, right, *a, **k: sent.append(right) or within(left, right, *a, **k))
    found = sorted(r.element_id for r in rules.without_access(boxes, corridors, exits).collect())
    assert [sorted(r.plan_id for r in c.collect()) for c in sent] == [[2]]
    assert found == [1, 2, 4]


def test_dead_ends_deal_corridors_out_once(spark):
    rects = [(1, 0, -700, -30, 600, 120), (1, 1, -51, 0, 600, 120), (1, 2, 1990, 1985, 10, 10), (1, 3, 2049, 1985, 10, 50), (1, 4, 2000, 2050, 20, 20), (1, 5, 2108, 1900, 600, 100), (1, 6, 9000, 9000, 5000, 90), (2, 7, 0, 0, 50, 50), (2, 8, 10, 0, 50, 50)]
    corridors = graph.cut(spark.createDataFrame(rects, "plan_id long, corridor_id long, x int, y int, w int, h int"))
    gap = lambda a, b: max(0, a[0] - b[0] - b[2], b[0] - a[0] - a[2]) ** 2 + max(0, a[1] - b[1] - b[3], b[1] - a[1] - a[3]) ** 2
    links = {i: sum(p == q and i != k and gap(a, b) < 2500 for q, k, *b in rects) for p, i, *a in rects if p == 1}
    ends = rules.dead_ends(corridors)
    assert {r.element_id: r.actual for r in ends.collect()} == {i: n for i, n in links.items() if n < 2}
    assert 0 < sum(n < 2 for n in links.values()) < len(links)
    plan = ends._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def exchanged_rows(df, exchange="Exchange", metric="shuffleRecordsWritten"):
    """Rows that each exchange of a query wrote when it ran; those that were used again count once."""
    df.collect()

    def under(node):
        name = node.nodeName()
        if name.startswith("ReusedExchange"):
            return []
        inner = [node.executedPlan()] if name.startswith("AdaptiveSparkPlan") else [node.plan()] if "QueryStage" in name else [node.children().apply(i) for i in range(node.children().size())]
        wrote = [node.metrics().get(metric).get().value()] if name == exchange else []
        return wrote + [n for i in inner for n in under(i)]

    return under(df._jdf.queryExecution().executedPlan())


def test_nodes_in_one_line_meet_in_few_cells(spark, tmp_path):
    n = 1500
    nodes = spark.range(n).selectExpr("id % 3 as plan_id", "id * 7919 % 12000 / 2D as x", "id * 104729 % 9000 / 2D as y", "900D as most", "array(cast(null as double)) as next_x", "array(cast(null as double)) as next_y")
    nodes.write.parquet(f"{tmp_path}/nodes")
    assert 0 < sum(exchanged_rows(networks._aligned(spark.read.parquet(f"{tmp_path}/nodes"), "x", "y"))) < 2 * n


def test_bridges_are_found_once_and_shuffled_once(spark, sf):
    from planfold.sources.fixtures import Views

    v = Views(spark, sf)
    edges = networks.centreline_edges(v.plans, v.corridors, v.walls)
    assert sum(exchanged_rows(edges)) < edges.count()  # the table returned is read from what was written, and is not derived twice


def test_aisles_of_plans_are_not_broadcast(spark, sf):
    from planfold.operators import spans
    from planfold.sources.fixtures import Views

    v = Views(spark, sf)
    plans, walls = v.plans.count(), v.walls
    found = spans.aisle_shadows(v.plans, walls, v.zones.select("plan_id", "x", "y", "w", "h"))
    assert max(exchanged_rows(found, "BroadcastExchange", "numOutputRows"), default=0) <= plans < spans.aisles(v.plans).count()
