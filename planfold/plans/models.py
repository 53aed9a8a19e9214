"""Queries on causes of deviations, layout scores, colours, raster regions, bridges, pixels and training data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planfold.catalog import query
from planfold.functions import geometry
from planfold.operators import graph, raster, spatial
from planfold.operators.shapes import as_rectangles
from planfold.plans.floors import _corridor_components
from planfold.plans.layout import _ISSUES, _NEAR, _STRICT, FLOOR, _audit, _by_plan
from planfold.plans.mix import _VAR, _variance

_CAUSE = _VAR + """, s as (select plan_id, sum(target) as target, sum(actual) as actual, count(*) filter (priority = 'obligatoire' and abs(deviation) > allowed) as unmet,
    string_agg(type, ',' order by ord) filter (priority = 'obligatoire' and deviation < -allowed) as missing from k group by plan_id), z as (select plan_id, sum(cast(w as bigint) * h) as taken from zones group by plan_id)
"""  # fmt: skip


def _causes(v):
    v1 = _variance(v)
    must = (F.col("priority") == "obligatoire") & ~F.col("within")
    short = F.array_sort(F.collect_list(F.when(must & (F.col("delta") < 0), F.struct("ord", "type"))))
    s = v1.groupBy("plan_id").agg(F.sum("target_area").alias("target"), F.sum("actual_area").alias("actual"), F.count(F.when(must, 1)).alias("unmet"), F.array_join(F.transform(short, lambda x: x["type"]), ",").alias("missing"))
    z = v.zones.groupBy("plan_id").agg(F.sum(F.col("w").cast("long") * F.col("h")).alias("taken"))
    return s.join(z, "plan_id", "left").join(v.plan_areas, "plan_id")


@query("A4_deviation_causes", _CAUSE + "select plan_id, concat_ws(',', case when coalesce(taken, 0) > 0 then 'geometry' end, case when target > 0.9 * (cast(max_x - min_x as bigint) * (max_y - min_y)) then 'feasibility' end, case when unmet > 0 then 'priority' end) as causes from s join plans using (plan_id) left join z using (plan_id)")
def a4_causes(v):
    c = _causes(v)
    return c.select("plan_id", F.concat_ws(",", F.when(F.coalesce("taken", F.lit(0)) > 0, "geometry"), F.when(F.col("target") > 0.9 * F.col("plan_area"), "feasibility"), F.when(F.col("unmet") > 0, "priority")).alias("causes"))


@query("A4_recommendations", _CAUSE + "select plan_id, action, detail from (select plan_id, 'meet mandatory types' as action, missing as detail from s where missing is not null union all select plan_id, 'review geometry', '' from s join z using (plan_id) where taken > 0 union all select plan_id, 'improve utilisation', 'yield ' || (actual * 100 // (cast(max_x - min_x as bigint) * (max_y - min_y))) || '%' from s join plans using (plan_id) where actual < 0.6 * (cast(max_x - min_x as bigint) * (max_y - min_y))) t")
def a4_recommendations(v):
    c = graph.cut(_causes(v))
    part = lambda where, action, detail: c.where(where).select("plan_id", F.lit(action).alias("action"), detail.alias("detail"))
    out = part("missing <> ''", "meet mandatory types", F.col("missing")).unionByName(part("taken > 0", "review geometry", F.lit("")))
    share = F.floor(F.col("actual") * 100 / F.col("plan_area"))
    return out.unionByName(part("actual < 0.6 * plan_area", "improve utilisation", F.concat(F.lit("yield "), share, F.lit("%"))))


@query("A8_validator_counts", _ISSUES + "select p.plan_id, count(*) filter (code like 'corridor%') as corridors, count(*) filter (code like 'box%') as boxes, count(*) filter (code like '%exit%') as exits, count(*) filter (code = 'forbidden_zone') as zones, count(*) filter (severity in ('CRITICAL', 'MAJOR')) = 0 as valid from plans p left join i using (plan_id) group by p.plan_id")
def a8(v):
    """Clean plans show zeros."""
    n = lambda c: F.count(F.when(c, 1))
    code, grave = F.col("code"), F.col("severity").isin("CRITICAL", "MAJOR")
    j = _by_plan(v, n(code.startswith("corridor")).alias("corridors"), n(code.startswith("box")).alias("boxes"), n(code.contains("exit")).alias("exits"), n(code == "forbidden_zone").alias("zones"), n(grave).alias("grave"))
    return j.select("plan_id", "corridors", "boxes", "exits", "zones", (F.col("grave") == 0).alias("valid"))


@query("A22_layout_scores", f"""with o as (select plan_id, count(*) as n from (select a.plan_id from boxes a join boxes b on a.plan_id = b.plan_id and a.floor_level = b.floor_level and a.box_id < b.box_id and {_STRICT}) t group by plan_id),
  b as (select plan_id, count(*) as n, sum(cast(w as bigint) * h) as area, avg(distance) as d, count(*) filter (x % 50 = 0 or y % 50 = 0) as aligned from {_NEAR} t group by plan_id)
  select plan_id, round(area * 1.0 / (cast(max_x - min_x as bigint) * (max_y - min_y)), 6) as coverage, round(1.0 - coalesce(o.n, 0) * 1.0 / b.n, 6) as separation, round(greatest(0, 1 - coalesce(d, 15000) / 15000), 6) as access, round(aligned * 1.0 / b.n, 6) as alignment,
    round(0.4 * area / (cast(max_x - min_x as bigint) * (max_y - min_y)) + 0.3 * (1.0 - coalesce(o.n, 0) * 1.0 / b.n) + 0.2 * greatest(0, 1 - coalesce(d, 15000) / 15000) + 0.1 * aligned / b.n, 6) as score from b join plans using (plan_id) left join o using (plan_id)""")
def a22(v):
    """Coverage, separation, access and alignment of a layout, and their weighted sum."""
    o = spatial.overlapping(v.boxes, FLOOR).groupBy("plan_id").agg(F.count(F.lit(1)).alias("o"))
    b = spatial.nearest_exit(v.boxes, v.exits).groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("w").cast("long") * F.col("h")).alias("area"), F.avg("distance").alias("d"), F.count(F.when((F.col("x") % 50 == 0) | (F.col("y") % 50 == 0), 1)).alias("k"))
    j = b.join(o, "plan_id", "left").fillna(0, ["o"]).join(v.plan_areas, "plan_id")
    parts = {"coverage": F.col("area") / F.col("plan_area"), "separation": 1 - F.col("o") / F.col("n"), "access": F.greatest(F.lit(0.0), 1 - F.coalesce("d", F.lit(15000.0)) / 15000), "alignment": F.col("k") / F.col("n")}
    score = sum(w * c for w, c in zip((0.4, 0.3, 0.2, 0.1), parts.values(), strict=True))
    return j.select("plan_id", *(F.round(c, 6).alias(n) for n, c in parts.items()), F.round(score, 6).alias("score"))


_CELL = 500


@query("R10_free_regions")
def r10(v):
    """Free cells of a 5 m raster (none of a zone's), joined to regions by their four neighbours."""
    low, high = (lambda c: F.floor(F.col(c) / _CELL)), (lambda c: F.ceil(F.col(c) / _CELL))
    size = graph.cut(v.plans.select("plan_id", (high("max_x") - low("min_x")).alias("cols"), (high("max_y") - low("min_y")).alias("rows"), low("min_x").alias("c0"), low("min_y").alias("r0")))
    end = lambda p, s, o: F.floor((F.col(p) + F.col(s)) / _CELL) - F.col(o)
    blocked = v.zones.join(size, "plan_id").select("plan_id", (low("x") - F.col("c0")).alias("c1"), (low("y") - F.col("r0")).alias("r1"), end("x", "w", "c0").alias("c2"), end("y", "h", "r0").alias("r2"))
    found = raster.joined_regions(size, blocked, named=True).join(size, "plan_id")
    at = lambda c, o: (F.col(c) + F.col(o)).cast("int")
    return found.select("plan_id", F.concat_ws("/", "plan_id", "name").alias("region"), "cells", at("c1", "c0").alias("i1"), at("c2", "c0").alias("i2"), at("r1", "r0").alias("j1"), at("r2", "r0").alias("j2"))


@query("R11_exits_off_main")
def r11(v):
    """Exits near corridors outside the plan's largest component, with the distance to the nearest corridor of that one."""
    found = graph.cut(_corridor_components(v).withColumnRenamed("id", "corridor_id").join(v.corridors, "corridor_id"))
    main = found.groupBy("plan_id", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("plan_id").agg(F.max(F.struct("n", (-F.col("component")).alias("k"))).alias("m")).select("plan_id", (-F.col("m.k")).alias("main"))
    on_main = found.join(main, "plan_id").where("component = main")
    d = spatial.nearest(v.exits, "exit_id", on_main, ["plan_id"], geometry.gap_squared("a", "b"))
    return d.where("d2 >= 250000").select("plan_id", "exit_id", F.round(F.sqrt("d2"), 4).alias("distance"))


@query("A28_pixel_metrics", """with p as (select event_id % 64 as x, event_id // 64 as y, event_id * 7 % 256 as r, event_id * 13 % 256 as g, user_id * 5 % 256 as b from events), q as (select x, y, (r + x) % 256 as r, (g + y % 9) % 256 as g, b from p), d as (select abs(p.r - q.r) + abs(p.g - q.g) + abs(p.b - q.b) as s, pow(p.r - q.r, 2) + pow(p.g - q.g, 2) + pow(p.b - q.b, 2) as s2 from p join q using (x, y)),
  e as (select a.x, a.y, abs(a.l - b.l) > 28 as edge from (select x, y, (299 * r + 587 * g + 114 * b) // 1000 as l from p) a join (select x - 2 as x, y, (299 * r + 587 * g + 114 * b) // 1000 as l from p) b using (x, y))
  select round(sum(s) / 3.0 / count(*), 4) as mae, round(sqrt(sum(s2) / 3.0 / count(*)), 4) as rmse, round(1 - sum(s) / 3.0 / count(*) / 255, 6) as similarity, (select round(avg(case when edge then 1.0 else 0 end), 6) from e) as edge_density from d""")
def a28(v):
    """Two pixel tables compared: mean and root-mean-square error, similarity, edge density (steps of two pixels)."""
    e = v.raw("events")
    p = e.select((F.col("event_id") % 64).alias("x"), F.floor(F.col("event_id") / 64).alias("y"), (F.col("event_id") * 7 % 256).alias("r"), (F.col("event_id") * 13 % 256).alias("g"), (F.col("user_id") * 5 % 256).alias("b"))
    q = p.select("x", "y", ((F.col("r") + F.col("x")) % 256).alias("r2"), ((F.col("g") + F.col("y") % 9) % 256).alias("g2"), F.col("b").alias("b2"))
    diff = [F.col(c) - F.col(c + "2") for c in "rgb"]
    s, s2 = sum(F.abs(x) for x in diff), sum(x * x for x in diff)
    d = p.join(q, ["x", "y"]).agg(F.sum(s).alias("s"), F.sum(s2).alias("s2"), F.count(F.lit(1)).alias("n"))
    luma = F.floor((299 * F.col("r") + 587 * F.col("g") + 114 * F.col("b")) / 1000)
    edges = p.select("x", "y", luma.alias("l")).join(p.select((F.col("x") - 2).alias("x"), "y", luma.alias("m")), ["x", "y"]).agg(F.round(F.avg(F.when(F.abs(F.col("l") - F.col("m")) > 28, 1.0).otherwise(0.0)), 6).alias("edge_density"))
    mae = F.col("s") / 3 / F.col("n")
    return d.select(F.round(mae, 4).alias("mae"), F.round(F.sqrt(F.col("s2") / 3 / F.col("n")), 4).alias("rmse"), F.round(1 - mae / 255, 6).alias("similarity")).join(edges, how="cross")  # one row each


@query("M2_labelled_samples", "select zone_id, cast(w * h as double) as area, 2.0 * (w + h) as perimeter, round(greatest(w, h) * 1.0 / least(w, h), 6) as aspect, x + w / 2.0 as cx, y + h / 2.0 as cy from zones")
def m2(v):
    """Shape features of labelled zones from their vertices; the centre is the mean of the vertices."""
    p = lambda i, j: F.struct((F.col("x") + F.col("w") * i).cast("double").alias("x"), (F.col("y") + F.col("h") * j).cast("double").alias("y"))
    ring = F.array(p(0, 0), p(1, 0), p(1, 1), p(0, 1))
    z = v.zones.withColumn("ring", ring)
    mean = lambda k: F.aggregate("ring", F.lit(0.0), lambda s, q: s + q[k]) / F.size("ring")
    return z.select("zone_id", geometry.signed_area(F.col("ring")).alias("area"), geometry.perimeter(F.col("ring")).alias("perimeter"), F.round(F.greatest("w", "h") / F.least("w", "h"), 6).alias("aspect"), mean("x").alias("cx"), mean("y").alias("cy"))


@query("M4_splits")
def m4(v):
    """Reproducible training, validation and test sets by a hash of the id."""
    band = F.pmod(F.xxhash64("entity_id"), F.lit(100))
    part = F.when(band < 70, "train").when(band < 85, "validation").otherwise("test")
    return v.entities.select("plan_id", part.alias("part")).groupBy("plan_id", "part").agg(F.count(F.lit(1)).alias("n"))


@query("M8_room_classifier")
def m8(v):
    """Zones classified by a multilayer perceptron on their shape, trained on the hash split; the confusion of the test part."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    area = F.col("w") * F.col("h")
    label = F.when(area < 60000, 0.0).when(area < 140000, 1.0).otherwise(2.0)
    z = v.zones.select("zone_id", F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h"), label.alias("label"), F.pmod(F.xxhash64("zone_id"), F.lit(100)).alias("band"))
    steps = [VectorAssembler(inputCols=["w", "h"], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), MultilayerPerceptronClassifier(layers=[2, 8, 3], maxIter=60, seed=3)]
    model = Pipeline(stages=steps).fit(z.where("band < 70"))
    return model.transform(z.where("band >= 70")).groupBy(F.col("label").cast("int").alias("truth"), F.col("prediction").cast("int").alias("said")).agg(F.count(F.lit(1)).alias("n"))


@query("J24_clean_corridors", f"select plan_id, count(*) as before, count(*) filter (x + w <= max_x and y + h <= max_y and corridor_id not in (select a.corridor_id from corridors a join zones b on a.plan_id = b.plan_id and {_STRICT})) as after from corridors join plans using (plan_id) group by plan_id")
def j24(v):
    """Corridors inside the bounds and clear of zones; counts before and after."""
    hit = spatial.grid_join(v.corridors, v.zones, ["plan_id"], geometry.overlap("a", "b")).select(F.col("a.corridor_id").alias("corridor_id")).distinct().withColumn("hit", F.lit(1))
    j = v.corridors.join(hit, "corridor_id", "left").join(v.plans, "plan_id")
    ok = F.col("hit").isNull() & (F.col("x") + F.col("w") <= F.col("max_x")) & (F.col("y") + F.col("h") <= F.col("max_y"))
    return j.groupBy("plan_id").agg(F.count(F.lit(1)).alias("before"), F.count(F.when(ok, 1)).alias("after"))


@query("J16_merged_zones", "with s as (select plan_id, zone_id + 1000000 as zone_id, x + zone_id % 40 as x, y, w, h from zones where zone_id % 2 = 0) select plan_id, zone_id from zones union all select s.plan_id, s.zone_id from s where not exists (select 1 from zones p where p.plan_id = s.plan_id and abs(p.w * p.h - s.w * s.h) <= 0.2 * p.w * p.h and pow(p.x + p.w / 2.0 - s.x - s.w / 2.0, 2) + pow(p.y + p.h / 2.0 - s.y - s.h / 2.0, 2) <= 400)")
def j16(v):
    """A second set of zones merged into the first: those alike in area (20 %) and centre (20 cm) are left out."""
    p = v.zones.select("plan_id", "zone_id", (F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") / 2).alias("y"), (F.col("w") * F.col("h")).alias("area"))
    s = p.where("zone_id % 2 = 0").withColumn("x", F.col("x") + F.col("zone_id") % 40).withColumn("zone_id", F.col("zone_id") + 1000000)
    c = lambda t, n: F.col(f"{t}.{n}")
    d2 = F.pow(c("a", "x") - c("b", "x"), 2) + F.pow(c("a", "y") - c("b", "y"), 2)
    alike = (d2 <= 400) & (F.abs(c("a", "area") - c("b", "area")) <= 0.2 * c("b", "area"))
    gone = spatial.grid_join(spatial.points(s), spatial.points(p), ["plan_id"], alike, pad=21).select(c("a", "zone_id").alias("zone_id"))
    return p.select("plan_id", "zone_id").unionByName(s.join(gone, "zone_id", "left_anti").select("plan_id", "zone_id"))


@query("X2_ready_events", "select event_type, count(*) as n, count(distinct event_id) as ids from webhook_events where event_type <> 'view' group by event_type")
def x2(v):
    from planfold.streaming import events as streams

    e = v.webhook_events.select("event_id", "ts", "event_type", F.when(F.col("event_type") != "view", "Success").alias("status"), F.col("user_id").alias("plan_id"))
    return streams.ready(e).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


@query("T5_ranked_recommendations", _ISSUES + ", c as (select plan_id, code, count(*) as n, row_number() over (partition by plan_id order by count(*) desc, code) as place from i group by plan_id, code) select plan_id, code, n, place from c where place <= 3")
def t5(v):
    c = _audit(v).groupBy("plan_id", "code").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("plan_id").orderBy(F.desc("n"), "code")).cast("long")).where("place <= 3")


@query("P12_wall_distance", "select plan_id, exit_id, round(min(sqrt(pow(greatest(0, least(x1, x2) - x, x - greatest(x1, x2)), 2) + pow(greatest(0, least(y1, y2) - y, y - greatest(y1, y2)), 2))), 4) as distance from exits join walls using (plan_id) group by plan_id, exit_id")
def p12(v):
    """Distance of each exit from the nearest wall of its plan (point to segment)."""
    d2 = geometry.point_segment_squared(*(F.col(c).cast("double") for c in ("a.x", "a.y", "b.x1", "b.y1", "b.x2", "b.y2")))
    return spatial.nearest(v.exits, "exit_id", as_rectangles(v.walls), ["plan_id"], d2).select("plan_id", "exit_id", F.round(F.sqrt("d2"), 4).alias("distance"))


@query("P12_polygon_distance", """with d as (select plan_id, exit_id, case when e.x > z.x and e.x < z.x + z.w and e.y > z.y and e.y < z.y + z.h then least(e.x - z.x, z.x + z.w - e.x, e.y - z.y, z.y + z.h - e.y)::double else sqrt(pow(greatest(0, z.x - e.x, e.x - z.x - z.w), 2) + pow(greatest(0, z.y - e.y, e.y - z.y - z.h), 2)) end as d from exits e join zones z using (plan_id)) select plan_id, exit_id, round(min(d), 4) as distance from d group by plan_id, exit_id""")
def p12_polygon(v):
    """Distance of each exit from the nearest edge of a zone's polygon, also from inside."""
    p = lambda i, j: F.struct((F.col("x") + F.col("w") * i).cast("double").alias("x"), (F.col("y") + F.col("h") * j).cast("double").alias("y"))
    zones = v.zones.withColumn("polygon", F.array(p(0, 0), p(1, 0), p(1, 1), p(0, 1)))
    d2 = geometry.point_polygon_squared(F.col("a.x").cast("double"), F.col("a.y").cast("double"), F.col("b.polygon"))
    return spatial.nearest(v.exits, "exit_id", zones, ["plan_id"], d2).select("plan_id", "exit_id", F.round(F.sqrt("d2"), 4).alias("distance"))
