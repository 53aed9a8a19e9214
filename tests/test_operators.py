"""Operators on small literals, and loops against plain versions."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from planfold.functions import geometry, text
from planfold.operators import graph, mix, rules, spatial
from planfold.sources import files
from planfold.sources.fixtures import twin
from planfold.streaming import events as streams


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("v")).first().v


def test_text_rules(spark):
    assert one(spark, text.layer_name(F.col("a")), a=" Mûr--porteur é ") == "MUR_PORTEUR_E"
    assert one(spark, text.base_type(F.col("a")), a="S (<2m²)") == "S"
    assert one(spark, text.range_midpoint(F.col("a")), a="5 - 10") == 7.5
    assert one(spark, text.range_midpoint(F.col("a")), a="xl") == 12
    assert one(spark, text.unit_size(F.col("a")), a=2.25) == 2.0
    assert one(spark, text.unit_size(F.col("a")), a=26.3) == 26.5
    assert one(spark, text.padded(F.col("a"), 3), a=1234) == "1234"
    t = one(spark, text.tolerance(F.col("a")), a="5%")
    assert (t.kind, t.value) == ("percentage", 5.0)


def test_polygons(spark):
    ring = [Row(x=0.0, y=0.0), Row(x=4.0, y=0.0), Row(x=4.0, y=3.0), Row(x=0.0, y=3.0)]
    df = spark.createDataFrame([Row(r=ring)])
    c = F.col("r")
    row = df.select(geometry.signed_area(c).alias("a"), geometry.perimeter(c).alias("p"), geometry.centroid(c).alias("c"), geometry.inside(F.lit(1.0), F.lit(1.0), c).alias("i"), geometry.inside(F.lit(5.0), F.lit(1.0), c).alias("o")).first()
    assert (row.a, row.p, row.c.x, row.c.y, row.i, row.o) == (12.0, 14.0, 2.0, 1.5, True, False)
    d = spark.range(1).select(geometry.point_segment_squared(*(F.lit(float(x)) for x in (0, 3, -1, 0, 1, 0)))).first()[0]
    assert d == 9.0


def test_mix_report_literal(spark):
    lines = spark.createDataFrame([(1, "S", 12, "10%", 1), (1, "M", 10, "0", 1)], "plan_id long, type string, target_area long, tolerance string, ord int")
    boxes = spark.createDataFrame([(1, "S (small)", 1, 5), (1, "S", 5, 1), (1, "M", 10, 1)], "plan_id long, type string, w int, h int")
    got = {r.type: r for r in mix.against_targets(lines, boxes).collect()}
    assert (got["S"].actual_area, got["S"].delta, got["S"].within) == (10, -2, False)
    assert (got["M"].actual_area, got["M"].within) == (10, True)


def test_grid_join_finds_every_pair_once(spark):
    rng = random.Random(1)
    boxes = [(1, 0, i, rng.randrange(-3000, 3000), rng.randrange(-3000, 3000), rng.randrange(1, 900), rng.randrange(1, 900)) for i in range(150)]
    df = spark.createDataFrame(boxes, "plan_id long, floor_level int, box_id long, x int, y int, w int, h int")
    expected = sorted((a[2], b[2]) for a in boxes for b in boxes if a[2] < b[2] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5] and a[4] < b[4] + b[6] and b[4] < a[4] + a[6])
    assert sorted((r.a_id, r.b_id) for r in spatial.overlapping(df, ["plan_id", "floor_level"]).collect()) == expected
    gap = lambda a, b: max(0, a[3] - b[3] - b[5], b[3] - a[3] - a[5]) ** 2 + max(0, a[4] - b[4] - b[6], b[4] - a[4] - a[6]) ** 2
    near = spatial.within(df, df, ["plan_id"], 300, F.col("a.box_id") < F.col("b.box_id")).select("a.box_id", F.col("b.box_id").alias("o")).collect()
    assert sorted(map(tuple, near)) == sorted((a[2], b[2]) for a in boxes for b in boxes if a[2] < b[2] and gap(a, b) < 90000)


@pytest.fixture(scope="module")
def random_graph():
    rng = random.Random(5)
    return sorted({(rng.randrange(120), rng.randrange(120), rng.randrange(1, 9)) for _ in range(110)})


def test_components_and_distances(spark, random_graph):
    nodes, edges = spark.range(120), spark.createDataFrame(random_graph, "a long, b long, cost double" if False else "a long, b long, cost long")
    label = list(range(120))
    for _ in range(120):
        for a, b, _c in random_graph:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.id: r.component for r in graph.components(nodes, edges).collect()} == dict(enumerate(label))
    best = {0: 0}
    for _ in range(120):
        for a, b, c in random_graph:
            for p, q in ((a, b), (b, a)):
                if p in best and best[p] + c < best.get(q, 1e9):
                    best[q] = best[p] + c
    assert {r.id: r.cost for r in graph.distances(spark.createDataFrame([(0,)], "id long"), edges).collect()} == best


def test_kept_in_order_and_mutual_nearest(spark, random_graph):
    order = {i: (i * 37) % 120 for i in range(120)}
    kept, near = [], {}
    for a, b, _ in random_graph:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for i in sorted(order, key=lambda i: (order[i], i)):
        if not near.get(i, set()) & set(kept):
            kept.append(i)
    nodes = spark.createDataFrame(list(order.items()), "id long, place long")
    edges = spark.createDataFrame([(a, b) for a, b, _ in random_graph if a != b], "a long, b long")
    assert sorted(r.id for r in graph.kept_in_order(nodes, edges).collect()) == sorted(kept)
    pairs, used, expected = [(a, b + 1000, float(c)) for a, b, c in random_graph], set(), set()
    for d, a, b in sorted((c, a, b) for a, b, c in pairs):
        if a not in used and b not in used:
            used |= {a, b}
            expected.add((a, b, d))
    assert {tuple(r) for r in graph.mutual_nearest(spark.createDataFrame(pairs, "a long, b long, distance double")).collect()} == expected


def test_plans_without_exits_get_an_issue(spark):
    plans = spark.createDataFrame([(1,), (2,), (3,)], "plan_id long")
    exits = spark.createDataFrame([(1, 1, 0, 0), (2, 1, 0, 0), (2, 2, 5, 5)], "plan_id long, exit_id long, x int, y int")
    assert sorted((r.plan_id, r.code) for r in rules.exits_missing(plans, exits).collect()) == [(1, "single_exit"), (3, "no_exit")]


def test_mix_csv(spark, tmp_path):
    (tmp_path / "north.csv").write_text(" Typologie ,Surface_cible,Tolerance,Priorite\nS,50,10%,oblig\n\"L, large\",120,15%,souhaitable\n")
    rows = files.read_mix_csv(spark, str(tmp_path))
    got = {r.typologie: r for r in rows.collect()}
    assert set(got) == {"S", "L, large"} and got["S"].mix_id == "north" and got["S"].tolerance == "10%"
    lines = mix.read_lines(rows.withColumn("plan_id", F.lit(1)).withColumn("line_no", F.lit(1)))
    s = lines.where("name = 'S'").first()
    assert (s.target, s.allowed, s.min_area, s.required, s.error) == (50.0, 5.0, 45.0, True, None)


def test_versions_upserts_samples_and_bundles(spark, tmp_path):
    old = spark.createDataFrame([("p", 1.0, 10, 10, "a")], "project_id string, version double, created_at long, updated_at long, payload string")
    new = spark.createDataFrame([("p", 20, "b"), ("q", 21, "c")], "project_id string, updated_at long, payload string")
    got = {(r.project_id, r.version, r.created_at) for r in files.save_version(old, new).collect()}
    assert got == {("p", 1.0, 10), ("p", 1.1, 10), ("q", 1.0, 21)}
    schema = "key string, updated_at long, metadata map<string, string>"
    a, b = spark.createDataFrame([("k", 1, {"x": "1", "y": "1"})], schema), spark.createDataFrame([("k", 2, {"y": "2"}), ("n", 1, {})], schema)
    assert {r.key: r.metadata for r in files.upserted(a, b).collect()} == {"k": {"x": "1", "y": "2"}, "n": {}}
    assert files.append_samples(new, str(tmp_path / "s")) == (2, 2) and files.append_samples(new, str(tmp_path / "s")) == (2, 4)
    files.write_bundle({"one": new, "two": old}, str(tmp_path / "bundle"))
    assert spark.read.parquet(str(tmp_path / "bundle" / "one")).count() == 2


def test_stream_of_events(spark, tmp_path):
    rows = [("a", "2026-01-01 10:00:00", 1, "view", "success"), ("a", "2026-01-01 10:01:00", 1, "view", "success"), ("b", "2026-01-01 10:02:00", 2, "done", "failed"), (None, "2026-01-01 10:03:00", 3, "extraction.success", None), (None, "2026-01-01 10:03:00", 3, "extraction.success", None), ("c", "2026-01-01 10:04:00", None, "x", "success")]
    df = spark.createDataFrame(rows, "event_id string, ts string, plan_id long, event_type string, status string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    streams.to_jobs(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(str(r.event_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["None", "None", "a"]
    assert streams.deduplicated(df).count() == 3
    jobs = spark.createDataFrame([(1, 1, "pending"), (1, 3, "done"), (1, 2, "failed")], "job_id long, ts long, state string")
    assert tuple(streams.job_states(jobs).first()) == (1, "done", 3, 1)


def test_twin_names_only_what_it_uses():
    assert twin("select 1 as x from exits").startswith("with exits as (")


def test_all_projects_are_placed(spark, sf):
    from planfold import catalog
    from planfold.sources.fixtures import Views

    catalog.load()
    got = catalog.QUERIES["T1_all_projects_by_update"](spark, sf).orderBy("place").collect()
    versions = Views(spark, sf).versions.select("project_id", "updated_at").collect()
    latest = {}
    for p, u in versions:
        latest[p] = max(u, latest.get(p, u))
    assert len(latest) > 100
    assert [(r.project_id, r.place) for r in got] == [(p, k + 1) for k, p in enumerate(sorted(sorted(latest), key=latest.get, reverse=True))]


def test_audit_sends_boxes_to_cells_once(spark, monkeypatch):
    """All joins of an audit that lay boxes into cells lay them alike, so that they share a shuffle; fire doors need none."""
    laid, real = set(), spatial.in_cells
    monkeypatch.setattr(spatial, "in_cells", lambda shapes, cell, pad=0: laid.add((cell, pad)) or real(shapes, cell, pad) if "box_id" in shapes.columns else real(shapes, cell, pad))
    df = spark.createDataFrame
    plans = df([(1, 0, 0, 9000, 9000), (2, 0, 0, 9000, 9000)], "plan_id long, min_x int, min_y int, max_x int, max_y int")
    boxes = df([(1, 0, 10, 0, 0, 200, 200), (1, 0, 11, 1000, 0, 200, 200), (2, 0, 20, 0, 0, 200, 200)], "plan_id long, floor_level int, box_id long, x int, y int, w int, h int")
    corridors = df([(1, 30, 299, 0, 150, 600), (1, 31, 5000, 5000, 150, 600)], "plan_id long, corridor_id long, x int, y int, w int, h int")
    zones = df([(1, 40, 1100, 100, 50, 50), (2, 41, 1100, 100, 50, 50)], "plan_id long, zone_id long, x int, y int, w int, h int")
    doors = df([(1, 1, 100, 249), (1, 2, 190, 220), (1, 3, 100, 250), (1, 4, 1100, 100)], "plan_id long, exit_id long, x int, y int")
    issues = rules.audit(plans, boxes, corridors, zones, doors, doors).collect()
    assert len(laid) == 1
    near = sorted((r.element_id, r.severity, r.actual, r.required) for r in issues if r.code == "box_fire_door")
    assert near == [(10, "MAJOR", 149.0, 150.0), (11, "MAJOR", 0.0, 150.0)]  # a door at 150 cm is far enough
    assert sorted(r.element_id for r in issues if r.code == "forbidden_zone") == [11]
    assert sorted(r.element_id for r in issues if r.code == "box_access") == [11]


def test_entity_names_are_read_once(spark):
    """A layer's name is cleaned once for all rules and classes."""
    from planfold.operators import classify

    df = spark.createDataFrame([("a-Door 1", 3, True)], "layer string, color int, closed boolean")
    c = classify.entity_class(F.col("layer"), F.col("color"), F.col("closed"))
    assert df.select(c["type"].alias("t"))._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
    assert df.select(c["type"].alias("t"), c["confidence"].alias("c")).first() == ("entrance", 0.9)


def test_box_lists_hold_a_plan_together(spark, tmp_path):
    """However many tasks hold a plan's boxes, its folder has a file for each range of the plan, not for each task."""
    boxes = spark.range(4000).select((F.col("id") % 50).alias("plan_id"), F.col("id").alias("box_id"), F.lit("S").alias("type"), *(F.lit(100).alias(c) for c in "xywh"), F.lit(10000).cast("long").alias("area")).repartition(8, "box_id")
    files.write_box_list(boxes, str(tmp_path / "list"))
    written = list((tmp_path / "list").glob("plan_id=*/*.csv"))
    assert len(written) <= 50 + 3  # three bounds between the ranges of four tasks
    assert files.read_box_list(spark, str(tmp_path / "list")).agg(F.count("box_id"), F.countDistinct("plan_id", "box_id")).first() == (4000, 4000)
