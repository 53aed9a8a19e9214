"""Queries on placed layouts: spatial joins, checks, measures, numbering, rows and gaps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planfold.catalog import query
from planfold.functions import geometry, text
from planfold.operators import catalogs, rules, spatial
from planfold.operators.shapes import sanitized

FLOOR = ["plan_id", "floor_level"]
_STRICT = "a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h"
_TOUCH = "a.x <= b.x + b.w and b.x <= a.x + a.w and a.y <= b.y + b.h and b.y <= a.y + a.h"
_GAP2 = "(greatest(0, a.x - b.x - b.w, b.x - a.x - a.w)::double * greatest(0, a.x - b.x - b.w, b.x - a.x - a.w) + greatest(0, a.y - b.y - b.h, b.y - a.y - a.h)::double * greatest(0, a.y - b.y - b.h, b.y - a.y - a.h))"
_AREA = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


@query("J1_grid_candidates", f"select a.plan_id, count(*) as n from boxes a join zones b on a.plan_id = b.plan_id and {_TOUCH} group by a.plan_id")
def j1(v):
    pairs = spatial.grid_join(v.boxes, v.zones, ["plan_id"], geometry.overlap("a", "b", strict=False))
    return pairs.groupBy(F.col("a.plan_id").alias("plan_id")).agg(F.count(F.lit(1)).alias("n"))


@query("J2_box_overlaps", f"select a.plan_id, a.floor_level, a.box_id as a_id, b.box_id as b_id from boxes a join boxes b on a.plan_id = b.plan_id and a.floor_level = b.floor_level and a.box_id < b.box_id and {_STRICT}")
def j2(v):
    return spatial.overlapping(v.boxes, FLOOR)


@query("P15_overlap_area", f"select a.plan_id, a.box_id, b.zone_id, cast({_AREA} as bigint) as area from boxes a join zones b on a.plan_id = b.plan_id and {_STRICT}")
def p15(v):
    pairs = spatial.grid_join(v.boxes, v.zones, ["plan_id"], geometry.overlap("a", "b"))
    return pairs.select(F.col("a.plan_id").alias("plan_id"), F.col("a.box_id").alias("box_id"), F.col("b.zone_id").alias("zone_id"), geometry.overlap_area("a", "b").cast("long").alias("area"))


_SPOT = " or ".join(f"(a.x + a.w * {i} between b.x and b.x + b.w and a.y + a.h * {j} between b.y and b.y + b.h)" for i, j in ((0, 0), (1, 0), (0, 1), (1, 1), (0.5, 0.5)))


@query("J3_boxes_in_zones", f"select a.plan_id, a.box_id, b.zone_id from boxes a join zones b on a.plan_id = b.plan_id and ({_SPOT})")
def j3(v):
    return rules.boxes_in_zones(v.boxes, v.zones)


_NEAR = "(select b.*, n.exit_id, n.d as distance from boxes b left join (select box_id, arg_min(exit_id, d * 1000000000 + exit_id) as exit_id, min(sqrt(d)) as d from (select b.box_id, e.exit_id, pow(e.x - (b.x + b.w / 2.0), 2) + pow(e.y - (b.y + b.h / 2.0), 2) as d from boxes b join exits e using (plan_id)) t group by box_id) n using (box_id))"


@query("J5_nearest_exit", f"select plan_id, box_id, coalesce(exit_id, -1) as exit_id, round(distance, 4) as distance from {_NEAR} t")
def j5(v):
    return spatial.nearest_exit(v.boxes, v.exits).select("plan_id", "box_id", F.coalesce("exit_id", F.lit(-1)).alias("exit_id"), F.round("distance", 4).alias("distance"))


@query("J6_box_exit_close", f"select a.plan_id, a.box_id, b.exit_id, round(sqrt({_GAP2}), 4) as distance from boxes a join (select *, 0 as w, 0 as h from exits) b on a.plan_id = b.plan_id and {_GAP2} < 10000")
def j6_exit(v):
    pairs = spatial.within(v.boxes, spatial.points(v.exits), ["plan_id"], 100)
    return pairs.select(F.col("a.plan_id").alias("plan_id"), F.col("a.box_id").alias("box_id"), F.col("b.exit_id").alias("exit_id"), F.round(F.sqrt(geometry.gap_squared("a", "b")), 4).alias("distance"))


@query("J6_box_gaps", f"select a.plan_id, count(*) as n, round(avg(sqrt({_GAP2})), 4) as mean_gap from boxes a join boxes b on a.plan_id = b.plan_id and a.floor_level = b.floor_level and a.box_id < b.box_id and {_GAP2} < 2500 group by a.plan_id")
def j6_gap(v):
    pairs = spatial.within(v.boxes, v.boxes, FLOOR, 50, F.col("a.box_id") < F.col("b.box_id"))
    return pairs.groupBy(F.col("a.plan_id").alias("plan_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.sqrt(geometry.gap_squared("a", "b"))), 4).alias("mean_gap"))


_LINKS = f"(select a.plan_id, a.corridor_id as a_id, b.corridor_id as b_id from corridors a join corridors b on a.plan_id = b.plan_id and a.corridor_id <> b.corridor_id and {_GAP2} < 2500)"


def _links(v):
    pairs = spatial.within(v.corridors, v.corridors, ["plan_id"], 50, F.col("a.corridor_id") != F.col("b.corridor_id"))
    return pairs.select(F.col("a.plan_id").alias("plan_id"), F.col("a.corridor_id").alias("a_id"), F.col("b.corridor_id").alias("b_id"))


@query("J7_dead_ends", f"with n as (select a_id, count(*) as n from {_LINKS} l group by a_id), t as (select plan_id, count(*) as k from corridors group by plan_id) select c.plan_id, c.corridor_id, coalesce(n.n, 0) as links, coalesce(n.n, 0) <= 1 and t.k >= 3 as dead_end from corridors c join t using (plan_id) left join n on n.a_id = c.corridor_id")
def j7(v):
    n = _links(v).groupBy(F.col("a_id").alias("corridor_id")).agg(F.count(F.lit(1)).alias("links"))
    k = v.corridors.groupBy("plan_id").agg(F.count(F.lit(1)).alias("k"))
    out = v.corridors.select("plan_id", "corridor_id").join(n, "corridor_id", "left").join(k, "plan_id").fillna(0, ["links"])
    return out.select("plan_id", "corridor_id", "links", ((F.col("links") <= 1) & (F.col("k") >= 3)).alias("dead_end"))


@query("J11_valid_corridors", f"select plan_id, corridor_id from corridors where corridor_id not in (select a.corridor_id from corridors a join (select plan_id, x, y, w, h from zones union all select plan_id, x - 33, y - 33, 66, 66 from exits) b on a.plan_id = b.plan_id and {_STRICT}) and corridor_id not in (select a.corridor_id from corridors a join boxes b on a.plan_id = b.plan_id and {_STRICT} and {_AREA} > 0.8 * a.w * a.h)")
def j11(v):
    """Over no zone and no entrance (66 cm about an exit), and over no box of any floor by more than 80 %."""
    entrances = v.exits.select("plan_id", (F.col("x") - 33).alias("x"), (F.col("y") - 33).alias("y"), F.lit(66).alias("w"), F.lit(66).alias("h"))
    return catalogs.valid_corridors(v.corridors, v.zones, entrances, v.boxes).select("plan_id", "corridor_id")


@query("J25_proximity_graph", "select a.plan_id, count(*) as n from boxes a join boxes b on a.plan_id = b.plan_id and a.floor_level = b.floor_level and a.box_id < b.box_id and pow(a.x + a.w / 2.0 - b.x - b.w / 2.0, 2) + pow(a.y + a.h / 2.0 - b.y - b.h / 2.0, 2) < 1000000 group by a.plan_id")
def j25(v):
    centres = spatial.points(v.boxes.select("plan_id", "floor_level", "box_id", (2 * F.col("x") + F.col("w")).alias("x"), (2 * F.col("y") + F.col("h")).alias("y")))
    pairs = spatial.within(centres, centres, FLOOR, 2000, F.col("a.box_id") < F.col("b.box_id"))  # half centimetres
    return pairs.groupBy(F.col("a.plan_id").alias("plan_id")).agg(F.count(F.lit(1)).alias("n"))


_ISSUES = f"""with i as (select plan_id, 'corridor_width' as code, 'MAJOR' as severity, corridor_id as element_id, least(w, h)::double as actual, case when w > h then 150 else 120 end::double as required from corridors where least(w, h) < case when w > h then 150 else 120 end
  union all select c.plan_id, 'corridor_dead_end', 'MINOR', c.corridor_id, coalesce(n.n, 0), 2 from corridors c join (select plan_id, count(*) as k from corridors group by plan_id) t using (plan_id) left join (select a_id, count(*) as n from {_LINKS} l group by a_id) n on n.a_id = c.corridor_id where t.k >= 3 and coalesce(n.n, 0) <= 1
  union all select plan_id, 'box_area', 'MINOR', box_id, w * h, 5000 from boxes where w * h < 5000
  union all select plan_id, 'box_side', 'MINOR', box_id, least(w, h), 50 from boxes where least(w, h) < 50
  union all select plan_id, 'box_access', 'MINOR', box_id, null, 100 from boxes where plan_id in (select plan_id from exits) and box_id not in (select a.box_id from boxes a join corridors b on a.plan_id = b.plan_id and {_GAP2} < 10000)
  union all select b.plan_id, 'box_fire_door', 'MAJOR', b.box_id, round(sqrt(pow(b.x + b.w / 2.0 - e.x, 2) + pow(b.y + b.h / 2.0 - e.y, 2)), 4), 150 from boxes b join exits e on e.plan_id = b.plan_id and e.exit_id % 2 = 0 and pow(b.x + b.w / 2.0 - e.x, 2) + pow(b.y + b.h / 2.0 - e.y, 2) < 22500
  union all select a.plan_id, 'forbidden_zone', 'CRITICAL', a.box_id, b.zone_id, null from boxes a join zones b on a.plan_id = b.plan_id and ({_SPOT})
  union all select plan_id, 'exit_distance', case when distance > 3000 then 'MAJOR' else 'MINOR' end, box_id, round(distance, 4), 3000 from {_NEAR} t where distance > 2400
  union all select plan_id, case when n = 0 then 'no_exit' else 'single_exit' end, case when n = 0 then 'CRITICAL' else 'MAJOR' end, plan_id, n, n + 1 from (select p.plan_id, count(e.exit_id) as n from plans p left join exits e using (plan_id) group by p.plan_id) x where n < 2)
"""  # fmt: skip


def _audit(v):
    """Every other exit is a fire door."""
    return rules.audit(v.plans, v.boxes, v.corridors, v.zones, v.exits, v.exits.where("exit_id % 2 = 0"))


def _by_plan(v, *sums):
    """Every plan with sums over its issues, which are made before the join (a plan listed k times has them k times)."""
    found = _audit(v).groupBy("plan_id").agg(*sums)
    plans = v.plans.groupBy("plan_id").agg(F.count(F.lit(1)).alias("_k"))
    names = [c for c in found.columns if c != "plan_id"]
    return plans.join(found, "plan_id", "left").select("plan_id", *((F.col("_k") * F.coalesce(c, F.lit(0))).alias(c) for c in names))


@query("A6_violations", _ISSUES + "select plan_id, code, severity, element_id, actual, required from i")
def a6(v):
    return _audit(v)


@query("A6_violation_summary", _ISSUES + "select plan_id, code, count(*) filter (severity = 'CRITICAL') as critical, count(*) filter (severity = 'MAJOR') as major, count(*) filter (severity = 'MINOR') as minor from i group by all")
def a6_summary(v):
    n = lambda severity: F.count(F.when(F.col("severity") == severity, 1)).alias(severity.lower())
    return _audit(v).groupBy("plan_id", "code").agg(n("CRITICAL"), n("MAJOR"), n("MINOR"))


@query("A7_scored_audit", _ISSUES + "select p.plan_id, count(i.code) as issues, greatest(0, 100 - 25 * count(*) filter (severity = 'CRITICAL') - 10 * count(*) filter (severity = 'MAJOR') - 2 * count(*) filter (severity = 'MINOR')) as score from plans p left join i using (plan_id) group by p.plan_id")
def a7(v):
    points = F.sum(F.expr("case severity when 'CRITICAL' then 25 when 'MAJOR' then 10 when 'MINOR' then 2 else 0 end"))
    n = _by_plan(v, F.count("code").alias("issues"), points.alias("points"))
    return n.select("plan_id", "issues", F.greatest(F.lit(0).cast("long"), 100 - F.col("points")).alias("score"))


@query("A5_kpis", """with b as (select plan_id, sum(cast(w as bigint) * h) as leasable, sum(2 * (w + h)) as partition_length from boxes group by plan_id), c as (select plan_id, sum(cast(w as bigint) * h) as corridor_area, sum(greatest(w, h)) as corridor_length from corridors group by plan_id)
  select p.plan_id, cast(coalesce(leasable, 0) as bigint) as leasable_area, (cast(max_x - min_x as bigint) * (max_y - min_y)) as usable_area, round(coalesce(leasable, 0) * 1.0 / (cast(max_x - min_x as bigint) * (max_y - min_y)), 6) as yield_ratio, cast(coalesce(partition_length, 0) as bigint) as partition_length, cast(coalesce(corridor_area, 0) as bigint) as corridor_area, cast(coalesce(corridor_length, 0) as bigint) as corridor_length from plans p left join b using (plan_id) left join c using (plan_id)""")
def a5(v):
    area = F.sum(F.col("w").cast("long") * F.col("h"))
    b = v.boxes.groupBy("plan_id").agg(area.alias("leasable_area"), F.sum(2 * (F.col("w") + F.col("h"))).alias("partition_length"))
    c = v.corridors.groupBy("plan_id").agg(area.alias("corridor_area"), F.sum(F.greatest("w", "h")).alias("corridor_length"))
    usable = ((F.col("max_x") - F.col("min_x")).cast("long") * (F.col("max_y") - F.col("min_y"))).alias("usable_area")
    names = ["leasable_area", "partition_length", "corridor_area", "corridor_length"]
    j = v.plans.select("plan_id", usable).join(b, "plan_id", "left").join(c, "plan_id", "left").fillna(0, names)
    return j.withColumn("yield_ratio", F.round(F.col("leasable_area") / F.col("usable_area"), 6))


@query("A18_plan_bounds", "select plan_id, min(x) as min_x, min(y) as min_y, max(x + w) as max_x, max(y + h) as max_y from (select plan_id, x, y, w, h from boxes union all select plan_id, x, y, w, h from corridors union all select plan_id, x, y, w, h from zones) t group by plan_id")
def a18(v):
    parts = [t.select("plan_id", "x", "y", "w", "h") for t in (v.boxes, v.corridors, v.zones)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("plan_id").agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max(F.col("x") + F.col("w")).alias("max_x"), F.max(F.col("y") + F.col("h")).alias("max_y"))


@query("A19_density_map", "select plan_id, cast(floor((x + w / 2.0::double - min_x) / (max_x - min_x) * 32) as int) as gx, cast(floor((y + h / 2.0::double - min_y) / (max_y - min_y) * 32) as int) as gy, count(*) as n from boxes join plans using (plan_id) where floor((x + w / 2.0::double - min_x) / (max_x - min_x) * 32) between 0 and 31 and floor((y + h / 2.0::double - min_y) / (max_y - min_y) * 32) between 0 and 31 group by 1, 2, 3")
def a19(v):
    return catalogs.density_grid(v.plans, v.boxes)


_ROWKEY = "cast(floor((y + h / 2.0) / 400 + 0.5) as bigint)"


@query("W1_box_numbers", "with r as (select plan_id, box_id, type, y // 300 as band, row_number() over (partition by plan_id order by type, y // 300, x, box_id) as n, dense_rank() over (partition by plan_id order by type) as zone, dense_rank() over (partition by plan_id, type order by y // 300) as row_no from boxes) select plan_id, box_id, n, zone, row_no, concat('Z', zone, '-R', row_no, '-', case when length(cast(n as varchar)) >= 3 then cast(n as varchar) else lpad(cast(n as varchar), 3, '0') end) as label from r")
def w1(v):
    """Zones by type, rows by bands, a number that runs through the plan."""
    b = v.boxes.withColumn("band", F.floor(F.col("y") / 300))
    plan = Window.partitionBy("plan_id")
    b = b.withColumn("n", F.row_number().over(plan.orderBy("type", "band", "x", "box_id"))).withColumn("zone", F.dense_rank().over(plan.orderBy("type"))).withColumn("row_no", F.dense_rank().over(Window.partitionBy("plan_id", "type").orderBy("band")))
    return b.select("plan_id", "box_id", F.col("n").cast("long").alias("n"), F.col("zone").cast("long").alias("zone"), F.col("row_no").cast("long").alias("row_no"), F.concat(F.lit("Z"), "zone", F.lit("-R"), "row_no", F.lit("-"), text.padded(F.col("n"), 3)).alias("label"))


@query("W2_floor_numbers", "select plan_id, floor_level, box_id, floor_level * 100 + row_number() over (partition by plan_id, floor_level order by y // 200 desc, x, box_id) as number from boxes")
def w2(v):
    w = Window.partitionBy(*FLOOR).orderBy(F.floor(F.col("y") / 200).desc(), "x", "box_id")
    return v.boxes.select(*FLOOR, "box_id", (F.col("floor_level") * 100 + F.row_number().over(w)).cast("long").alias("number"))


@query("W3_labels", "select plan_id, box_id, 'B' || case when length(cast(n as varchar)) >= 3 then cast(n as varchar) else lpad(cast(n as varchar), 3, '0') end as label from (select *, row_number() over (partition by plan_id order by box_id) as n from boxes) t")
def w3(v):
    n = F.row_number().over(Window.partitionBy("plan_id").orderBy("box_id"))
    return v.boxes.withColumn("n", n).select("plan_id", "box_id", F.concat(F.lit("B"), text.padded(F.col("n"), 3)).alias("label"))


@query("W4_column_gaps", "with c as (select plan_id, floor_level, x // 100 as col, box_id, y, h, lead(y) over w as ny, lead(box_id) over w as nid from boxes window w as (partition by plan_id, floor_level, x // 100 order by y, box_id)) select plan_id, floor_level, cast(col as bigint) as col, box_id, nid as next_id, ny - y - h as gap from c where ny - y - h between 120 and 2000")
def w4(v):
    w = Window.partitionBy(*FLOOR, "col").orderBy("y", "box_id")
    b = v.boxes.withColumn("col", F.floor(F.col("x") / 100)).withColumn("ny", F.lead("y").over(w)).withColumn("next_id", F.lead("box_id").over(w))
    return b.withColumn("gap", F.col("ny") - F.col("y") - F.col("h")).where("gap between 120 and 2000").select(*FLOOR, "col", "box_id", "next_id", "gap")


@query("W5_fixed_rows", f"select plan_id, floor_level, {_ROWKEY} as row_key, count(*) as n, min(x) as min_x, max(x + w) as max_x from boxes group by all")
def w5(v):
    key = F.floor((F.col("y") + F.col("h") / 2.0) / 400 + 0.5).alias("row_key")
    return v.boxes.groupBy(*FLOOR, key).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("min_x"), F.max(F.col("x") + F.col("w")).alias("max_x"))


@query("W6_row_metrics", f"select plan_id, floor_level, {_ROWKEY} as row_key, round(sum(w) * 1.0 / (max(x + w) - min(x)), 6) as density, round(1 / (1 + var_pop(y / 100.0)), 6) as alignment from boxes group by all")
def w6(v):
    key = F.floor((F.col("y") + F.col("h") / 2.0) / 400 + 0.5).alias("row_key")
    width = F.max(F.col("x") + F.col("w")) - F.min("x")
    return v.boxes.groupBy(*FLOOR, key).agg(F.round(F.sum("w") / width, 6).alias("density"), F.round(1 / (1 + F.var_pop(F.col("y") / 100.0)), 6).alias("alignment"))


_ISLANDS = """with s as (select plan_id, y // 500 as band, x as a, x + w as b from corridors), m as (select *, max(b) over (partition by plan_id, band order by a, b rows between unbounded preceding and 1 preceding) as seen from s),
  i as (select *, sum(case when seen is null or a > seen then 1 else 0 end) over (partition by plan_id, band order by a, b rows unbounded preceding) as island from m), g as (select plan_id, band, island, min(a) as a, max(b) as b from i group by all)"""


def _islands(v):
    keys = ["plan_id", "band"]
    s = v.corridors.select("plan_id", F.floor(F.col("y") / 500).alias("band"), F.col("x").alias("a"), (F.col("x") + F.col("w")).alias("b"))
    w = Window.partitionBy(*keys).orderBy("a", "b")
    s = s.withColumn("seen", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.when(F.col("seen").isNull() | (F.col("a") > F.col("seen")), 1).otherwise(0)
    s = s.withColumn("island", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*keys, "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))


@query("W8_merged_intervals", _ISLANDS + " select plan_id, cast(band as bigint) as band, a, b from g")
def w8(v):
    return _islands(v).select("plan_id", "band", "a", "b")


@query("W9_free_spans", _ISLANDS + """, f as (select plan_id, band, coalesce(lag(b) over (partition by plan_id, band order by a), 0) as lo, a as hi from g union all select plan_id, band, max(b), any_value(max_x) from g join plans using (plan_id) group by plan_id, band) select plan_id, cast(band as bigint) as band, lo, hi from f where hi - lo >= 100""")
def w9(v):
    g = _islands(v)
    before = g.select("plan_id", "band", F.coalesce(F.lag("b").over(Window.partitionBy("plan_id", "band").orderBy("a")), F.lit(0).cast("long")).alias("lo"), F.col("a").alias("hi"))
    after = g.groupBy("plan_id", "band").agg(F.max("b").alias("lo")).join(v.plans.select("plan_id", F.col("max_x").cast("long").alias("hi")), "plan_id").select("plan_id", "band", "lo", "hi")
    return before.unionByName(after).where("hi - lo >= 100")


@query("W10_row_alignment", f"with b as (select plan_id, floor_level, {_ROWKEY} as row_key, box_id, x, w, h from boxes), r as (select *, row_number() over (partition by plan_id, floor_level, row_key order by h, box_id) as rn, count(*) over (partition by plan_id, floor_level, row_key) as n, sum(w) over (partition by plan_id, floor_level, row_key order by x, box_id rows unbounded preceding) - w as at from b), m as (select plan_id, floor_level, row_key, h as median from r where rn = n // 2 + 1) select r.plan_id, r.floor_level, r.row_key, r.box_id, cast(r.at as bigint) as at, m.median from r join m using (plan_id, floor_level, row_key)")
def w10(v):
    keys = [*FLOOR, "row_key"]
    b = v.boxes.withColumn("row_key", F.floor((F.col("y") + F.col("h") / 2.0) / 400 + 0.5))
    w = Window.partitionBy(*keys)
    b = b.withColumn("rn", F.row_number().over(w.orderBy("h", "box_id"))).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("at", (F.sum("w").over(w.orderBy("x", "box_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")).cast("long"))
    return b.withColumn("median", F.max(F.when(F.col("rn") == F.floor(F.col("n") / 2) + 1, F.col("h"))).over(w)).select(*keys, "box_id", "at", "median")


@query("W13_corridor_dedupe", "select plan_id, corridor_id from (select *, row_number() over (partition by plan_id, x // 500, y // 500, w > h order by w * h desc, corridor_id) as rn from corridors) t where rn = 1")
def w13(v):
    w = Window.partitionBy("plan_id", F.floor(F.col("x") / 500), F.floor(F.col("y") / 500), F.col("w") > F.col("h")).orderBy((F.col("w") * F.col("h")).desc(), "corridor_id")
    return v.corridors.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("plan_id", "corridor_id")


@query("T2_zones_by_area", "select plan_id, zone_id, row_number() over (partition by plan_id order by w * h desc, zone_id) as place from zones")
def t2(v):
    return v.zones.select("plan_id", "zone_id", F.row_number().over(Window.partitionBy("plan_id").orderBy((F.col("w") * F.col("h")).desc(), "zone_id")).cast("long").alias("place"))


@query("T6_capped_boxes", "select plan_id, box_id from (select *, row_number() over (partition by plan_id order by box_id) as n from boxes) t where n <= 100 + plan_id")
def t6(v):
    n = F.row_number().over(Window.partitionBy("plan_id").orderBy("box_id"))
    return v.boxes.withColumn("n", n).where(F.col("n") <= 100 + F.col("plan_id")).select("plan_id", "box_id")


@query("P9_clipped_boxes", """with b as (select plan_id, box_id, case when box_id % 7 in (3, 5) then x + w / 2.0 else x end as x, case when box_id % 7 in (3, 5) then y + h / 2.0 else y end as y, case when box_id % 11 = 4 then 100 else w end as w, h from boxes where box_id % 7 <> 5 or box_id % 13 <> 2),
  c as (select plan_id, box_id, greatest(x, min_x) as x1, greatest(y, min_y) as y1, least(x + w, max_x) as x2, least(y + h, max_y) as y2 from b join plans using (plan_id) where x + w >= min_x and x <= max_x and y + h >= min_y and y <= max_y) select plan_id, box_id, x1::double as x, y1::double as y, (x2 - x1)::double as w, (y2 - y1)::double as h from c where x2 - x1 >= 50 and y2 - y1 >= 50""")
def p9(v):
    """Boxes some of which have no x (or y) but a centre, some not even that, some no width: clipped to the plan."""
    k = F.col("box_id") % 7
    centre = F.when((k != 5) | (F.col("box_id") % 13 != 2), 1)
    b = v.boxes.select("plan_id", "box_id", F.when(k != 3, F.when(k != 5, F.col("x"))).alias("x"), F.when(k != 5, F.col("y")).alias("y"), (centre * (F.col("x") + F.col("w") / 2)).alias("cx"), (centre * (F.col("y") + F.col("h") / 2)).alias("cy"), F.when(F.col("box_id") % 11 != 4, F.col("w")).alias("w"), "h")
    return sanitized(b, v.plans).select("plan_id", "box_id", *(F.col(c).cast("double").alias(c) for c in "xywh"))


@query("P19_snapped_boxes", "select box_id, cast(floor(x / 25.0 + 0.5) * 25 as bigint) as x, cast(floor(y / 25.0 + 0.5) * 25 as bigint) as y from boxes")
def p19(v):
    snap = lambda c: (F.floor(F.col(c) / 25 + 0.5) * 25).alias(c)
    return v.boxes.select("box_id", snap("x"), snap("y"))


@query("P21_centrelines", "select corridor_id, case when w >= h then 'horizontal' else 'vertical' end as direction, case when w >= h then x else x + w / 2.0 end::double as x1, case when w >= h then y + h / 2.0 else y end::double as y1, case when w >= h then x + w else x + w / 2.0 end::double as x2, case when w >= h then y + h / 2.0 else y + h end::double as y2 from corridors")
def p21(v):
    flat = F.col("w") >= F.col("h")
    mid_x, mid_y = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    d = lambda a, b, n: F.when(flat, a).otherwise(b).cast("double").alias(n)
    return v.corridors.select("corridor_id", F.when(flat, "horizontal").otherwise("vertical").alias("direction"), d(F.col("x"), mid_x, "x1"), d(mid_y, F.col("y"), "y1"), d(F.col("x") + F.col("w"), mid_x, "x2"), d(mid_y, F.col("y") + F.col("h"), "y2"))


@query("P31_box_score", "select box_id, round(greatest(0, least(1, 0.5 + least(0.3, w * h / 10000.0 / 50) - sqrt(x * x + y * y * 1.0) / 100000.0)), 6) as score from boxes")
def p31(v):
    score = 0.5 + F.least(F.lit(0.3), F.col("w") * F.col("h") / 10000.0 / 50) - F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) / 100000.0
    return v.boxes.select("box_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("score"))


@query("P11_polygon_measures", """select zone_id, round(w * h * 15 / 16.0, 4) as area, round(w + 0.75 * h + sqrt(0.25 * w * w + 0.0625 * h * h) + 0.5 * w + h, 4) as perimeter,
  round((w * h * (x + w / 2.0) - w * h / 16.0 * (x + w * 5 / 6.0)) / (w * h * 15 / 16.0), 4) as cx from zones""")
def p11(v):
    """Zones as rings with one corner cut off: area, perimeter and centroid from the vertices."""
    pt = lambda i, j: F.struct((F.col("x") + F.col("w") * i).cast("double").alias("x"), (F.col("y") + F.col("h") * j).cast("double").alias("y"))
    ring = F.array(pt(0, 0), pt(1, 0), pt(1, 0.75), pt(0.5, 1), pt(0, 1))
    z = v.zones.withColumn("ring", ring)
    c = geometry.centroid(F.col("ring"))
    return z.select("zone_id", F.round(geometry.signed_area(F.col("ring")), 4).alias("area"), F.round(geometry.perimeter(F.col("ring")), 4).alias("perimeter"), F.round(c["x"], 4).alias("cx"))
