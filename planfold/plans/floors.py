"""Queries on floors and circulation: vertical connectors, building summaries, components, reachability, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from planfold.catalog import query
from planfold.functions import geometry
from planfold.operators import catalogs, cleanup, graph, spatial
from planfold.plans.layout import _GAP2, _LINKS, _NEAR, _links

_PAIRS = "(select a.plan_id, a.connector_id as a_id, b.connector_id as b_id, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) as d2, a.floor_level as level_a from connectors a join connectors b on a.plan_id = b.plan_id and a.type = b.type and b.floor_level = a.floor_level + 1 and pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 15625)"


def _vertical(v, limit=125):
    """Connectors of adjacent levels and one type, at most limit apart."""
    up = v.connectors.select("plan_id", "type", F.col("connector_id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), (F.col("floor_level") - 1).alias("floor_level"))
    pairs = v.connectors.withColumnRenamed("connector_id", "a_id").join(graph.spread(up), ["plan_id", "type", "floor_level"])
    d2 = F.pow(F.col("x") - F.col("bx"), 2) + F.pow(F.col("y") - F.col("by"), 2)
    return pairs.withColumn("d2", d2).where(F.col("d2") <= limit * limit)


@query("J14_connector_candidates", f"select plan_id, a_id, b_id, round(sqrt(d2), 4) as distance from {_PAIRS} p")
def j14_candidates(v):
    return _vertical(v).select("plan_id", "a_id", "b_id", F.round(F.sqrt("d2"), 4).alias("distance"))


@query("J14_connector_matches")
def j14(v):
    """One-to-one pairs, the nearest first."""
    found = graph.mutual_nearest(_vertical(v).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.sqrt("d2").alias("distance")))
    return found.select(F.col("a").alias("a_id"), F.col("b").alias("b_id"), F.round("distance", 4).alias("distance"))


@query("A15_floor_stacking", f"""with f as (select plan_id, floor_level, count(*) as n, count(*) filter (type = 'elevator') as elevator, count(*) filter (type = 'stair') as stair, count(*) filter (type = 'escalator') as escalator, count(*) filter (type = 'shaft') as shaft from connectors group by all),
  l as (select plan_id, level_a as floor_level, count(*) as links from {_PAIRS} p group by all) select f.*, floor_level * 300 as z, coalesce(links, 0) as links_up from f left join l using (plan_id, floor_level)""")
def a15(v):
    counts = v.connectors.groupBy("plan_id", "floor_level").pivot("type", ["elevator", "stair", "escalator", "shaft"]).count().fillna(0)
    links = _vertical(v).groupBy("plan_id", "floor_level").agg(F.count(F.lit(1)).alias("links_up"))
    out = counts.join(links, ["plan_id", "floor_level"], "left").fillna(0, ["links_up"])
    return out.select("*", (F.col("elevator") + F.col("stair") + F.col("escalator") + F.col("shaft")).alias("n"), (F.col("floor_level") * 300).alias("z"))


@query("A17_accessibility", """with f as (select plan_id, floor_level from boxes union select plan_id, floor_level from connectors), c as (select plan_id, floor_level, bool_or(type = 'elevator') as lift, count(*) filter (type in ('stair', 'escalator')) as stairs, count(*) as n from connectors group by all), e as (select plan_id, 0 as floor_level, count(*) as n from exits where 75 + 10 * exit_id >= 90 group by plan_id),
  j as (select plan_id, floor_level, coalesce(lift, false) as elevator, coalesce(stairs, 0) as stairs, coalesce(e.n, 0) as entrances, floor_level > 0 and coalesce(c.n, 0) = 0 as none, floor_level > 0 and not coalesce(lift, false) as no_lift, floor_level = 0 and coalesce(e.n, 0) < 1 as few from f left join c using (plan_id, floor_level) left join e using (plan_id, floor_level))
  select plan_id, floor_level, elevator, stairs, entrances, not (none or no_lift or few) as passes, concat_ws(' ', case when none then 'No vertical connector.' end, case when no_lift then 'Elevator missing.' end, case when few then 'Needs 1 accessible entrances.' end) as notes from j""")
def a17(v):
    """Exits are entrances of the ground floor, from 75 cm wide."""
    floors = v.boxes.select("plan_id", "floor_level").union(v.connectors.select("plan_id", "floor_level"))
    entrances = v.exits.select("plan_id", F.lit(0).alias("floor_level"), ((75 + 10 * F.col("exit_id")) / 100).alias("width"))
    return catalogs.accessibility(floors, v.connectors, entrances)


@query("A14_building_summary", "with f as (select plan_id, floor_level, sum(cast(w as bigint) * h) as area, count(*) as n from boxes group by all) select building_id, count(distinct plan_id) as plans, count(*) as floors, cast(sum(n) as bigint) as boxes, cast(sum(area) as bigint) as area, round(sum(area) * 100.0 / sum((cast(max_x - min_x as bigint) * (max_y - min_y))), 4) as utilisation from f join plans using (plan_id) group by building_id")
def a14(v):
    f = v.boxes.groupBy("plan_id", "floor_level").agg(F.sum(F.col("w").cast("long") * F.col("h")).alias("area"), F.count(F.lit(1)).alias("n"))
    g = f.join(v.plans, "plan_id").join(v.plan_areas, "plan_id").groupBy("building_id")
    return g.agg(F.countDistinct("plan_id").alias("plans"), F.count(F.lit(1)).alias("floors"), F.sum("n").alias("boxes"), F.sum("area").alias("area"), F.round(F.sum("area") * 100 / F.sum("plan_area"), 4).alias("utilisation"))


@query("A16_egress", f"with e as (select plan_id, floor_level, count(*) as rooms, max(distance) as far, avg(distance) as mean from {_NEAR} t group by all) select plan_id, floor_level, rooms, round(far, 4) as max_distance, round(mean, 4) as mean_distance, coalesce(far <= 4500, false) as passes, case when far is null then 'no exits' when far > 4500 then 'too far' else 'ok' end as reason from e")
def a16(v):
    e = spatial.nearest_exit(v.boxes, v.exits).groupBy("plan_id", "floor_level").agg(F.count(F.lit(1)).alias("rooms"), F.max("distance").alias("far"), F.avg("distance").alias("mean"))
    reason = F.when(F.col("far").isNull(), "no exits").when(F.col("far") > 4500, "too far").otherwise("ok")
    return e.select("plan_id", "floor_level", "rooms", F.round("far", 4).alias("max_distance"), F.round("mean", 4).alias("mean_distance"), F.coalesce(F.col("far") <= 4500, F.lit(False)).alias("passes"), reason.alias("reason"))


@query("J22_floor_bounds", "with f as (select plan_id, floor_level, min(x) as x1, max(x + w) as x2 from boxes group by all) select plan_id, floor_level, x1 - first_value(x1) over (partition by plan_id order by floor_level) as shift_min, x2 - first_value(x2) over (partition by plan_id order by floor_level) as shift_max, abs(x1 - first_value(x1) over (partition by plan_id order by floor_level)) > 2 or abs(x2 - first_value(x2) over (partition by plan_id order by floor_level)) > 2 as warn from f")
def j22(v):
    f = v.boxes.groupBy("plan_id", "floor_level").agg(F.min("x").alias("x1"), F.max(F.col("x") + F.col("w")).alias("x2"))
    base = f.groupBy("plan_id").agg(F.min_by("x1", "floor_level").alias("b1"), F.min_by("x2", "floor_level").alias("b2"))
    f = f.join(base, "plan_id").withColumn("shift_min", F.col("x1") - F.col("b1")).withColumn("shift_max", F.col("x2") - F.col("b2"))
    return f.select("plan_id", "floor_level", "shift_min", "shift_max", ((F.abs("shift_min") > 2) | (F.abs("shift_max") > 2)).alias("warn"))


_COMPONENTS = f"with recursive e as (select a_id, b_id from {_LINKS} l), x as (select distinct a.corridor_id as id from corridors a join (select *, 0 as w, 0 as h from exits) b on a.plan_id = b.plan_id and {_GAP2} < 250000), r(id, root) as (select corridor_id, corridor_id from corridors union select e.b_id, r.root from r join e on e.a_id = r.id where r.root < e.b_id), c as (select id, min(root) as component from r group by id)"


def _corridor_components(v):
    nodes = v.corridors.select(F.col("corridor_id").alias("id"))
    return graph.components(nodes, _links(v).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))


@query("R1_corridor_components", _COMPONENTS + " select id as corridor_id, component from c")
def r1(v):
    return _corridor_components(v).select(F.col("id").alias("corridor_id"), "component")


def _with_exit(v):
    """Corridors less than 5 m from an exit of their plan."""
    pairs = spatial.within(v.corridors, spatial.points(v.exits), ["plan_id"], 500)
    return pairs.select(F.col("a.corridor_id").alias("id")).distinct()


@query("R2_unreachable_corridors", _COMPONENTS + " select k.plan_id, k.corridor_id from corridors k join c on c.id = k.corridor_id where c.component not in (select c.component from c join x using (id))")
def r2(v):
    """Corridors whose component has no exit near; plans without exits have none reachable."""
    found = _corridor_components(v)
    reached = found.join(_with_exit(v), "id").select("component").distinct()
    return found.join(reached, "component", "left_anti").join(v.corridors.select(F.col("corridor_id").alias("id"), "plan_id"), "id").select("plan_id", F.col("id").alias("corridor_id"))


@query("R8_kept_components", _COMPONENTS + " select k.plan_id, c.component, cast(sum(greatest(k.w, k.h)) as bigint) as length, count(*) as corridors, max(case when x.id is null then 0 else 1 end) as has_exit from corridors k join c on c.id = k.corridor_id left join x on x.id = c.id group by k.plan_id, c.component having max(case when x.id is null then 0 else 1 end) = 1 or sum(greatest(k.w, k.h)) >= 2000")
def r8(v):
    """Components with an exit near, or 20 m of corridor."""
    found = _corridor_components(v).join(v.corridors.select(F.col("corridor_id").alias("id"), "plan_id", F.greatest("w", "h").alias("length")), "id")
    exits = _with_exit(v).withColumn("has_exit", F.lit(1))
    by = found.join(exits, "id", "left").groupBy("plan_id", "component").agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("corridors"), F.max(F.coalesce("has_exit", F.lit(0))).alias("has_exit"))
    return by.where("has_exit = 1 or length >= 2000")


@query("R8_kept_with_fallbacks", _COMPONENTS + """, d as (select k.plan_id, c.component, cast(sum(greatest(k.w, k.h)) as bigint) as length, count(*) as n, max(case when x.id is null then 0 else 1 end) = 1 as seeded from corridors k join c on c.id = k.corridor_id left join x on x.id = c.id group by k.plan_id, c.component),
  f as (select *, bool_or(seeded) over w as any_seed, bool_or(length >= 2000 or n > 1) over w as any_long, row_number() over (partition by plan_id order by length desc, component desc) as place from d window w as (partition by plan_id))
  select plan_id, component, length, n, seeded from f where case when any_seed then seeded or length >= 2000 when any_long then length >= 2000 or n > 1 else place = 1 end""")
def r8_fallbacks(v):
    """Components that stay, also in plans where none has an exit near."""
    found = _corridor_components(v).join(v.corridors.select(F.col("corridor_id").alias("id"), "plan_id", F.greatest("w", "h").alias("length")), "id")
    by = found.join(_with_exit(v).withColumn("_exit", F.lit(True)), "id", "left").groupBy("plan_id", "component").agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or("_exit"), F.lit(False)).alias("seeded"))
    return cleanup.kept_components(graph.cut(by), 2000)


@query("R5_path_costs")
def r5(v):
    """Least cost from the corridors near an exit, over links that cost the mean of both lengths."""
    length = v.corridors.select(F.col("corridor_id").alias("id"), F.greatest("w", "h").alias("length"))
    e = _links(v).join(length.withColumnRenamed("id", "a_id").withColumnRenamed("length", "la"), "a_id").join(length.withColumnRenamed("id", "b_id").withColumnRenamed("length", "lb"), "b_id")
    found = graph.distances(_with_exit(v), e.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), ((F.col("la") + F.col("lb")) / 2).alias("cost")))
    return found.select(F.col("id").alias("corridor_id"), F.round("cost", 4).alias("cost"))


@query("W14_conflict_free_boxes")
def w14(v):
    """Boxes kept by a scan in id order that drops overlaps."""
    pairs = spatial.overlapping(v.boxes, ["plan_id", "floor_level"]).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return graph.kept_in_order(v.boxes.select(F.col("box_id").alias("id"), F.col("box_id").alias("place")), pairs).select(F.col("id").alias("box_id"))


_ENDS = "(select plan_id, wall_id, 0 as e, x1 as x, y1 as y from walls union all select plan_id, wall_id, 1, x2, y2 from walls)"


@query("C11_corridor_class", f"""with x as (select distinct a.corridor_id from corridors a join (select *, 0 as w, 0 as h from exits) b on a.plan_id = b.plan_id and {_GAP2} < 250000), n as (select distinct a.corridor_id from corridors a join boxes b on a.plan_id = b.plan_id and {_GAP2} < 40000)
  select c.plan_id, c.corridor_id, case when x.corridor_id is not null then 'main' when n.corridor_id is not null then 'access' else 'connecting' end as class from corridors c left join x using (corridor_id) left join n using (corridor_id)""")
def c11(v):
    one = lambda df, name: df.select(F.col("a.corridor_id").alias("corridor_id")).distinct().withColumn(name, F.lit(1))
    x = one(spatial.within(v.corridors, spatial.points(v.exits), ["plan_id"], 500), "at_exit")
    n = one(spatial.within(v.corridors, v.boxes, ["plan_id"], 200), "at_box")
    j = v.corridors.join(x, "corridor_id", "left").join(n, "corridor_id", "left")
    return j.select("plan_id", "corridor_id", F.when(F.col("at_exit") == 1, "main").when(F.col("at_box") == 1, "access").otherwise("connecting").alias("class"))
