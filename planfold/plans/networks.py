"""Queries on networks: centreline graphs, bridges, routes across floors, wall gaps and their fillers, near-duplicate zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from planfold.catalog import query
from planfold.functions import geometry
from planfold.operators import graph, networks, rules, spatial
from planfold.plans.floors import _COMPONENTS, _ENDS, _PAIRS, _corridor_components, _vertical, _with_exit
from planfold.plans.layout import _GAP2

_EDGE = f"""with l as (select plan_id, corridor_id, w >= h as flat, case when w >= h then y + h / 2.0 else x + w / 2.0 end::double as c, case when w >= h then x else y end::double as s, case when w >= h then x + w else y + h end::double as e from corridors),
  cross_ as (select a.plan_id, a.corridor_id as ha, b.corridor_id as vb, a.c as hy, b.c as vx from l a join l b on a.plan_id = b.plan_id and a.flat and not b.flat and b.c between a.s and a.e and a.c between b.s and b.e),
  at_ as (select plan_id, corridor_id, s as t from l union select plan_id, corridor_id, e from l union select plan_id, ha, vx from cross_ union select plan_id, vb, hy from cross_),
  st as (select plan_id, corridor_id, t as a, lead(t) over (partition by plan_id, corridor_id order by t) as b from at_),
  ed as (select distinct st.plan_id, case when flat then a else c end as x1, case when flat then c else a end as y1, case when flat then b else c end as x2, case when flat then c else b end as y2 from st join l using (plan_id, corridor_id) where b - a >= 20)"""
_INNER = "exists (select 1 from (select wl.*, (({p}x1 - {p}x2) * (wl.y1 - wl.y2) - ({p}y1 - {p}y2) * (wl.x1 - wl.x2)) as d from walls wl where wl.plan_id = {p}plan_id) w where d <> 0 and (({p}x1 - w.x1) * (w.y1 - w.y2) - ({p}y1 - w.y1) * (w.x1 - w.x2)) / d > 0.01 and (({p}x1 - w.x1) * (w.y1 - w.y2) - ({p}y1 - w.y1) * (w.x1 - w.x2)) / d < 0.99 and -(({p}x1 - {p}x2) * ({p}y1 - w.y1) - ({p}y1 - {p}y2) * ({p}x1 - w.x1)) / d > 0.01 and -(({p}x1 - {p}x2) * ({p}y1 - w.y1) - ({p}y1 - {p}y2) * ({p}x1 - w.x1)) / d < 0.99)"
_GRAPH = f"""{_EDGE}, eb as (select ed.*, {_INNER.format(p='ed.')} as blocked from ed), nd as (select plan_id, x1 as x, y1 as y from eb where not blocked union select plan_id, x2, y2 from eb where not blocked),
  br as (select a.plan_id, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from nd a join nd b on a.plan_id = b.plan_id join plans p on p.plan_id = a.plan_id and ((b.x > a.x and abs(b.y - a.y) <= 25 and b.x - a.x between 30 and greatest(400, (max_x - min_x) * 0.15)) or (b.y > a.y and abs(b.x - a.x) <= 25 and b.y - a.y between 30 and greatest(400, (max_x - min_x) * 0.15)))),
  bn as (select br.* from br where not exists (select 1 from eb where not eb.blocked and eb.plan_id = br.plan_id and ((eb.x1 = br.x1 and eb.y1 = br.y1 and eb.x2 = br.x2 and eb.y2 = br.y2) or (eb.x1 = br.x2 and eb.y1 = br.y2 and eb.x2 = br.x1 and eb.y2 = br.y1))))"""


@query("R4_centreline_graph", _GRAPH + f" select plan_id, 'corridor' as kind, x1, y1, x2, y2, round(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)), 4) as length, blocked from eb union all select plan_id, 'bridge', x1, y1, x2, y2, round(greatest(abs(x2 - x1), abs(y2 - y1)), 4), false from bn where not {_INNER.format(p='bn.')}")
def r4(v):
    """Edges along centrelines, split at crossings, and bridges between nodes in one line."""
    return networks.centreline_edges(v.plans, v.corridors, v.walls).withColumn("length", F.round("length", 4))


@query("R9_bridge_report")
def r9(v):
    """Bridges between the centres of corridors that join the components of each plan."""
    centre = v.corridors.select("plan_id", F.col("corridor_id").alias("id"), (F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") / 2).alias("y"))
    return networks.bridge_report(centre.join(_corridor_components(v), "id")).select("plan_id", F.col("a").alias("a_id"), F.col("b").alias("b_id"), F.round("distance", 4).alias("distance"))


def _links_of(v):
    return _vertical(v).select("a_id", "b_id")


@query("R6_cross_floor_routes")
def r6(v):
    """Least routes from upper connectors to the lowest level of their component."""
    return networks.cross_floor_routes(v.connectors, _links_of(v))[0].withColumn("cost", F.round("cost", 4))


@query("R6_route_segments")
def r6_segments(v):
    return networks.cross_floor_routes(v.connectors, _links_of(v))[1].withColumn("length", F.round("length", 4))


@query("R7_level_hops", f"""with recursive e as (select distinct plan_id, level_a as a, level_a + 1 as b from {_PAIRS} p), n as (select distinct plan_id, floor_level as l from connectors),
  r(plan_id, src, l, hops) as (select plan_id, l, l, 0 from n union select r.plan_id, r.src, case when e.a = r.l then e.b else e.a end, r.hops + 1 from r join e on e.plan_id = r.plan_id and (e.a = r.l or e.b = r.l) where r.hops < (select count(distinct floor_level) from connectors))
  select plan_id, src as from_level, l as to_level, min(hops) as hops from r where src < l group by all""")
def r7(v):
    """Levels reachable from each level over vertical links, in the fewest hops."""
    return networks.level_hops(_vertical(v).select("plan_id", F.col("floor_level").alias("low"), (F.col("floor_level") + 1).alias("high")).distinct())


@query("R3_connectivity_report", _COMPONENTS + f""", g as (select distinct c.component from c join x using (id)), k as (select k.*, c.component, g.component is not null as ok from corridors k join c on c.id = k.corridor_id left join g using (component)), s as (select distinct a.box_id from boxes a join k b on a.plan_id = b.plan_id and b.ok and {_GAP2} < 2500),
  u as (select plan_id, count(*) filter (s.box_id is null) as n from boxes left join s using (box_id) group by plan_id)
  select k.plan_id, count(distinct component) as components, count(*) as corridors, count(*) filter (not ok) as unreachable, any_value(u.n) as unreachable_boxes, count(distinct component) = 1 as connected from k left join u using (plan_id) group by k.plan_id""")
def r3(v):
    """Components of each plan, corridors without a way to an exit, and boxes not within 50 cm of a corridor with one."""
    found = graph.cut(_corridor_components(v).withColumnRenamed("id", "corridor_id").join(v.corridors, "corridor_id"))
    reached = found.join(_with_exit(v).withColumnRenamed("id", "corridor_id"), "corridor_id").select("component").distinct().withColumn("ok", F.lit(True))
    found = graph.cut(found.join(reached, "component", "left"))
    boxes = graph.cut(v.boxes.select("plan_id", "box_id", "x", "y", "w", "h"))
    served = spatial.within(boxes, found.where("ok"), ["plan_id"], 50, cell=rules.CELL).select(F.col("a.plan_id").alias("plan_id"), F.col("a.box_id").alias("box_id")).distinct()
    served = served.groupBy("plan_id").agg(F.count(F.lit(1)).alias("served"))
    alone = boxes.groupBy("plan_id").agg(F.count(F.lit(1)).alias("boxes")).join(served, "plan_id", "left").select("plan_id", (F.col("boxes") - F.coalesce("served", F.lit(0))).alias("unreachable_boxes"))
    n = found.groupBy("plan_id").agg(F.countDistinct("component").alias("components"), F.count(F.lit(1)).alias("corridors"), F.count(F.when(F.col("ok").isNull(), 1)).alias("unreachable"))
    return n.join(alone, "plan_id", "left").select("plan_id", "components", "corridors", "unreachable", F.col("unreachable_boxes").cast("long").alias("unreachable_boxes"), (F.col("components") == 1).alias("connected"))


@query("J12_wall_ends", f"""with p as (select a.wall_id, a.e, min(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as d2 from {_ENDS} a join {_ENDS} b on a.plan_id = b.plan_id and a.wall_id <> b.wall_id and pow(a.x - b.x, 2) + pow(a.y - b.y, 2) < 62500 group by all)
  select a.plan_id, a.wall_id, a.e, case when d2 <= 225 then 'connected' when d2 is not null then 'gap' else 'open' end as state, coalesce(d2 > 225 and d2 between 100 and 62500, false) as fillable, round(sqrt(d2), 4) as distance from {_ENDS} a left join p using (wall_id, e)""")
def j12(v):
    """Each wall end: connected to another wall's end (15 cm), across a gap (2.5 m) that can be filled, or open."""
    ends = networks.wall_ends(v.walls)
    pairs = spatial.within(ends, ends, ["plan_id"], 250, F.col("a.wall_id") != F.col("b.wall_id"))
    near = pairs.groupBy(F.col("a.id").alias("id")).agg(F.min(geometry.gap_squared("a", "b")).alias("d2"))
    state = F.when(F.col("d2") <= 225, "connected").when(F.col("d2").isNotNull(), "gap").otherwise("open")
    out = ends.join(near, "id", "left").select("plan_id", "wall_id", (F.col("id") % 2).cast("int").alias("e"), state.alias("state"), "d2")
    return out.select("plan_id", "wall_id", "e", "state", ((F.col("state") == "gap") & (F.col("d2") >= 100)).alias("fillable"), F.round(F.sqrt("d2"), 4).alias("distance"))


@query("J12_gap_report", f"""with p as (select a.plan_id, a.wall_id, a.e, min(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as d2 from {_ENDS} a left join {_ENDS} b on a.plan_id = b.plan_id and a.wall_id <> b.wall_id and pow(a.x - b.x, 2) + pow(a.y - b.y, 2) < 62500 group by all), s as (select plan_id, count(*) filter (d2 > 225) as gap_ends, count(*) filter (d2 is null) as open_ends from p group by plan_id)
  select plan_id, coalesce(gap_ends, 0) as gap_ends, coalesce(open_ends, 0) as open_ends, case when gap_ends is null then 'no walls' else concat_ws('; ', case when gap_ends > 0 then 'fill ' || gap_ends || ' ends across gaps' end, case when open_ends > 0 then 'complete ' || open_ends || ' open ends' end, case when gap_ends = 0 and open_ends = 0 then 'complete' end) end as advice from plans left join s using (plan_id)""")
def j12_report(v):
    """What each plan's wall ends ask for."""
    gap, open_ = F.count(F.when(F.col("state") == "gap", 1)), F.count(F.when(F.col("state") == "open", 1))
    n = j12(v).groupBy("plan_id").agg(gap.alias("gap_ends"), open_.alias("open_ends"))
    g, o = F.col("gap_ends"), F.col("open_ends")
    said = F.concat_ws("; ", F.when(g > 0, F.concat(F.lit("fill "), g, F.lit(" ends across gaps"))), F.when(o > 0, F.concat(F.lit("complete "), o, F.lit(" open ends"))), F.when((g == 0) & (o == 0), "complete"))
    return v.plans.select("plan_id").join(n, "plan_id", "left").select("plan_id", F.coalesce(g, F.lit(0)).alias("gap_ends"), F.coalesce(o, F.lit(0)).alias("open_ends"), F.when(g.isNull(), "no walls").otherwise(said).alias("advice"))


@query("J13_gap_fillers")
def j13(v):
    """Synthetic walls across gaps of each plan's walls."""
    return networks.gap_fillers(v.walls)[0]


@query("J15_distinct_zones")
def j15_distinct(v):
    """Zones without near-duplicates, the largest kept."""
    return networks.distinct_zones(v.zones).select("plan_id", "zone_id")
