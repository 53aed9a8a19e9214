"""Queries on drawing standards and layout checks: colours, roles, compliance, templates, units, room types, exits, clearances, validity."""

from __future__ import annotations

from pyspark.sql import functions as F

from planfold.catalog import query
from planfold.functions import geometry, text
from planfold.operators import checks, classify, graph, learning, rules, shapes, spatial, standards
from planfold.plans.layers import _CLASS, _NAME, _STANDARD, _classed
from planfold.plans.layout import _GAP2, _NEAR, _STRICT, _TOUCH, FLOOR
from planfold.plans.shapes import _D

_INK = ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(standards.palette()))
_LISTED = " ".join(f"when color in ({', '.join(map(str, listed))}) then '{kind}:0.9'" for kind, listed in standards.COLOUR_CLASSES)


@query("C2_colour_class", f"""with p(i, r, g, b) as (values {_INK}), c as (select color, case {_LISTED} when r > 200 and g < 100 and b < 100 then 'entrance:0.7' when b > 200 and r < 100 and g < 100 then 'forbidden:0.7'
    when r < 100 and g < 100 and b < 100 then 'wall:0.6' when r > 200 and g > 200 and b > 200 then 'wall:0.5' else 'wall:0.3' end as c from (select distinct color from entities) t join p on p.i = color)
  select color, split_part(c, ':', 1) as class, cast(split_part(c, ':', 2) as double) as confidence from c""")
def c2(v):
    return v.entities.select("color").distinct().select("color", standards.colour_class(F.col("color")).alias("c")).select("color", F.col("c.type").alias("class"), F.col("c.confidence").cast("double").alias("confidence"))


_TRUE = "(select distinct color, case when color % 3 = 0 then color else color * 7 % 256 * 65536 + color * 13 % 256 * 256 + color * 29 % 256 end as value from entities)"


@query("C3_nearest_colour", f"""with p(i, r, g, b) as (values {_INK}), c as (select *, value // 65536 as vr, value // 256 % 256 as vg, value % 256 as vb from {_TRUE} t), n as (select color, arg_min(i, (pow(vr - r, 2) + pow(vg - g, 2) + pow(vb - b, 2)) * 1000 + i) as nearest from c cross join p group by color)
  select color, value, case when value > 255 then nearest else value end as nearest from c join n using (color)""")
def c3(v):
    """Each distinct colour once; a third of them are indices already."""
    c = v.entities.select("color").distinct()
    true = F.col("color") * 7 % 256 * 65536 + F.col("color") * 13 % 256 * 256 + F.col("color") * 29 % 256
    c = c.withColumn("value", F.when(F.col("color") % 3 == 0, F.col("color")).otherwise(true))
    return c.select("color", "value", standards.colour_index(F.col("value")).cast("long").alias("nearest"))


def _drawn(v):
    """Entities with the rectangle and area of the box of the same id (in drawing units)."""
    shape = v.boxes.select("plan_id", F.col("box_id").alias("entity_id"), "x", "y", "w", "h", (F.col("w") * F.col("h") / 300.0).alias("area"))
    return v.entities.join(shape, ["plan_id", "entity_id"]).withColumn("closed", F.col("entity_type") == "LWPOLYLINE")


_ROUTED = f"""(select *, coalesce(role in ('ENVELOPE', 'OBSTACLES', 'FORBIDDEN', 'EXITS', 'FIRE_DOORS', 'WALLS'), false) or (s is null and entity_type = 'LWPOLYLINE') as counts from (select *, case when s is not null then s when layer like '%ENTREE%' and layer like '%SORTIE%' then 'EXITS' when entity_type = 'LINE' then 'WALLS'
    when entity_type = 'LWPOLYLINE' and w * h / 300.0 > 500 then 'ENVELOPE' when entity_type = 'LWPOLYLINE' and w * h / 300.0 > 10 then 'OBSTACLES' end as role from (select e.*, b.x, b.y, b.w, b.h, {_STANDARD} as s from entities e join boxes b on b.plan_id = e.plan_id and b.box_id = e.entity_id) t) u)"""


@query("C8_entity_roles", f"select plan_id, coalesce(role, 'none') as role, count(*) as n, count(*) filter (counts) as counted from {_ROUTED} r group by all")
def c8(v):
    return standards.routed(_drawn(v)).groupBy("plan_id", F.coalesce("role", F.lit("none")).alias("role")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("counts"), 1)).alias("counted"))


@query("C8_plan_envelopes", f"""with r as (select * from {_ROUTED} r where counts), e as (select plan_id, arg_max(struct_pack(a := x, b := y, c := x + w, d := y + h), cast(w as bigint) * h * 1000000 + entity_id) filter (role = 'ENVELOPE') as own, min(x) as x1, min(y) as y1, max(x + w) as x2, max(y + h) as y2 from r group by plan_id)
  select plan_id, coalesce(own.a, x1) as min_x, coalesce(own.b, y1) as min_y, coalesce(own.c, x2) as max_x, coalesce(own.d, y2) as max_y, case when own is null then 'bounds' else 'drawn' end as source from e""")
def c8_envelopes(v):
    return standards.envelopes(standards.routed(_drawn(v)))


_RGB = "case color % 4 when 0 then 0 when 1 then 16711680 when 2 then 255 else color * 65793 end"
_KIND = "case split_part(c, ':', 1) when 'wall' then 'walls' when 'entrance' then 'entrances' when 'forbidden' then 'forbiddenZones' end"
_SAID = "(rgb // 65536) || ',' || (rgb // 256 % 256) || ',' || (rgb % 256)"
_ISSUES_OF = " ".join(f"when kind = '{k}' then concat_ws('; ', case when not regexp_matches(n, '{p}', 'i') then 'layer ' || n || ' is not of {k}' end, case when {_SAID} <> '{','.join(map(str, rgb))}' then 'colour ' || {_SAID} || ' is not {','.join(map(str, rgb))}' end)" for k, p, rgb in standards.CAD_STANDARDS)


@query("C10_standard_compliance", f"select entity_id, issues = '' as compliant, issues from (select entity_id, coalesce(case {_ISSUES_OF} end, '') as issues from (select entity_id, n, {_KIND} as kind, {_RGB} as rgb from {_CLASS} u) t) w")
def c10(v):
    """Entities against the standard of the type that their layer and colour index gave them."""
    kinds = F.create_map(*(F.lit(x) for pair in (("wall", "walls"), ("entrance", "entrances"), ("forbidden", "forbiddenZones")) for x in pair))
    shade = F.col("color") % 4
    e = _classed(v).withColumn("kind", kinds[F.col("c.type")]).withColumn("rgb", F.when(shade == 0, 0).when(shade == 1, 16711680).when(shade == 2, 255).otherwise(F.col("color") * 65793))
    out = standards.with_compliance(e)
    return out.select("entity_id", (F.size("issues") == 0).alias("compliant"), F.array_join("issues", "; ").alias("issues"))


@query("C15_template_checks", """select zone_id, 'T' || zone_id as name, lo as min_area, hi as max_area, case when lo >= hi then 'area' when zone_id % 3 > 0 and 0.8 + zone_id % 4 >= 3.0 then 'width' when 1.0 >= 1.0 + zone_id % 2 then 'depth' when zone_id % 11 = 0 then 'aspect' end as error
  from (select zone_id, case when zone_id % 7 = 0 then 0.5 else zone_id % 7 / 2.0 end::double as lo, case when zone_id % 5 = 0 then 20.0 else zone_id % 5 end::double as hi from zones) t""")
def c15(v):
    """Template definitions made from zones: some without areas or widths, some with ranges that don't rise."""
    z = F.col("zone_id")
    span = lambda a, b: F.struct(a.cast("double").alias("min"), b.cast("double").alias("max"))
    configs = v.zones.select("zone_id", F.concat(F.lit("t"), z).alias("name"), (z % 7 / 2.0).alias("min_area"), (z % 5).alias("max_area"), F.when(z % 3 > 0, span(0.8 + z % 4, F.lit(3.0))).alias("width"), span(F.lit(1.0), 1.0 + z % 2).alias("depth"), F.when(z % 11 == 0, span(F.lit(1.4), F.lit(0.6))).alias("aspect"))
    return standards.checked_templates(configs).select("zone_id", "name", "min_area", "max_area", "error")


_UNIT = "case k when 1 then 0.0254 when 2 then 0.3048 when 3 then 1609.344 when 4 then 0.001 when 5 then 0.01 when 6 then 1.0 when 7 then 1000.0 when 8 then 0.0000000254 when 9 then 0.0000254 when 10 then 0.9144 else case when bw between 5 and 500 and bh between 5 and 500 then 1.0 when bw between 1000 and 1000000 then 0.001 when bw between 100 and 50000 and bh >= 100 then 0.01 when bw < 5 and bh < 5 then 10.0 else 1.0 end end::double"


@query("P8_rescaled_zones", f"with p as (select plan_id, plan_id % 18 as k, (max_x - min_x) / pow(10, plan_id % 6) as bw, (max_y - min_y) / pow(10, plan_id % 6) as bh from plans), s as (select plan_id, {_UNIT} as scale from p) select zone_id, scale, round(x * scale, 6) as x_m, round(y * scale, 6) as y_m, round(w * h * scale * scale, 6) as area_m2 from zones join s using (plan_id)")
def p8(v):
    """Zones in metres: each plan has a unit code (or none that is known) and an extent of its own size; areas scale by the square."""
    part = F.pow(F.lit(10), F.col("plan_id") % 6)
    code = F.when(~(F.col("plan_id") % 18).isin(14, 15, 16), F.col("plan_id") % 18)
    scale = standards.metres(code, (F.col("max_x") - F.col("min_x")) / part, (F.col("max_y") - F.col("min_y")) / part)
    z = v.zones.join(v.plans.select("plan_id", scale.cast("double").alias("scale")), "plan_id")
    return z.select("zone_id", "scale", F.round(F.col("x") * F.col("scale"), 6).alias("x_m"), F.round(F.col("y") * F.col("scale"), 6).alias("y_m"), F.round(F.col("w") * F.col("h") * F.col("scale") * F.col("scale"), 6).alias("area_m2"))


_ROOM = "(select z.*, w * h / 4000.0 as area, case p_size % 9 when 0 then 'A-Office-2' when 1 then 'MEETING' when 2 then 'big conference' when 3 then 'store' when 4 then 'Hallway' when 5 then 'WC' when 6 then 'break' else '0' end as layer from zones z join part on p_partkey = zone_id)"


def _rooms(v):
    names = F.array(*(F.lit(x) for x in ("A-Office-2", "MEETING", "big conference", "store", "Hallway", "WC", "break")))
    layers = v.raw("part").select(F.col("p_partkey").alias("zone_id"), F.coalesce(F.get(names, F.col("p_size") % 9), F.lit("0")).alias("layer"))
    return v.zones.join(layers, "zone_id").withColumn("area", F.col("w") * F.col("h") / 4000.0)


@query("P20_room_types", f"""select zone_id, case when upper(layer) like '%OFFICE%' then 'office' when regexp_matches(upper(layer), 'MEETING|CONFERENCE') then 'meeting' when regexp_matches(upper(layer), 'STORAGE|STORE') then 'storage' when regexp_matches(upper(layer), 'CORRIDOR|HALLWAY') then 'corridor'
    when regexp_matches(upper(layer), 'RESTROOM|WC|TOILET') then 'restroom' when regexp_matches(upper(layer), 'KITCHEN|BREAK') then 'break_room' when area < 5 then 'small_office' when area < 15 then 'office' when area < 30 then 'large_office' else 'open_space' end as room_type,
    case when w * 1.0 / h > 2 or w * 1.0 / h < 0.5 then 'elongated' when abs(2 * (w + h) / 100.0 - 4 * sqrt(w * w + h * h) / 100.0 / sqrt(2)) < 1 then 'rectangular' else 'irregular' end as subtype from {_ROOM} t""")
def p20(v):
    r = _rooms(v)
    return r.select("zone_id", checks.room_type(F.col("layer"), F.col("area")).alias("room_type"), checks.room_subtype(F.col("w") / 100, F.col("h") / 100).alias("subtype"))


@query("J20_room_classes", f"""with r as (select *, x + w / 2.0 as cx, y + h / 2.0 as cy from {_ROOM} t), e as (select distinct zone_id from r join exits e on e.plan_id = r.plan_id and pow(cx - e.x, 2) + pow(cy - e.y, 2) < 250000), f as (select distinct r.zone_id from r join zones z on z.plan_id = r.plan_id and z.zone_id % 10 = 0 and pow(cx - z.x - z.w / 2.0, 2) + pow(cy - z.y - z.h / 2.0, 2) < 1000000)
  select r.plan_id, r.zone_id, case when area < 5 then 'utility' when area < 20 then 'office' when area < 50 then 'meeting' when e.zone_id is not null then 'entry' when f.zone_id is not null then 'circulation' else 'hall' end as class from r left join e using (zone_id) left join f using (zone_id)""")
def j20_classes(v):
    """Rooms by area, and large ones by the exits within 5 m and the forbidden zones (every tenth) within 10 m of their centres."""
    return checks.room_classes(_rooms(v), v.exits, v.zones.where("zone_id % 10 = 0")).select("plan_id", "zone_id", "class")


@query("P25_exit_widths", """select plan_id, exit_id, round(width, 4) as width, width >= 90 as accessible from (select plan_id, exit_id, case (plan_id + exit_id) % 5 when 0 then 70 + x % 40 when 1 then greatest(60 + x % 50, 60 + y % 50) when 2 then sqrt(pow(60 + x % 30, 2) + pow(y % 70, 2)) when 3 then sqrt(pow(50, 2) + pow(40 + y % 60, 2)) else 0 end as width from exits) t""")
def p25(v):
    """Exits that state a width, a bounding box, two ends, a polygon, or nothing."""
    k, x, y = (F.col("plan_id") + F.col("exit_id")) % 5, F.col("x"), F.col("y")
    at = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    e = v.exits.select("plan_id", "exit_id", F.when(k == 0, 70 + x % 40).alias("width"), F.when(k == 1, F.struct((60 + x % 50).alias("w"), (60 + y % 50).alias("h"))).alias("box"), F.when(k == 2, at(x, y)).alias("start"), F.when(k == 2, at(x + 60 + x % 30, y + y % 70)).alias("end"), F.when(k == 3, F.array(at(x, y), at(x + 50, y + 40 + y % 60), at(x, y + 90))).alias("polygon"))
    return e.select("plan_id", "exit_id", checks.exit_width().alias("width")).select("plan_id", "exit_id", F.round("width", 4).alias("width"), (F.col("width") >= 90).alias("accessible"))


@query("J4_wall_clearance", f"""with d as (select a.plan_id, a.box_id, min(sqrt({_D('a.c', 'b.')}) - greatest(a.w, a.h) / 2.0) as c from (select *, x + w / 2.0 as cx, y + h / 2.0 as cy from boxes) a join walls b on a.plan_id = b.plan_id group by all)
  select plan_id, box_id, round(c, 4) as clearance, code, case code when 'wall_overlap' then 'CRITICAL' else 'MAJOR' end as severity from (select *, unnest(case when c < 0 then ['wall_clearance', 'wall_overlap'] else ['wall_clearance'] end) as code from d where c < 30) t""")
def j4(v):
    """Boxes less than 30 cm from a wall (centre to wall, less half the longer side): a MAJOR issue, and a CRITICAL one under 0."""
    return checks.wall_clearance(v.boxes, v.walls).withColumn("clearance", F.round("clearance", 4))


@query("J6_fire_doors", "select b.plan_id, b.box_id, e.exit_id, round(sqrt(pow(b.x + b.w / 2.0 - e.x, 2) + pow(b.y + b.h / 2.0 - e.y, 2)), 4) as distance from boxes b join exits e on e.plan_id = b.plan_id and e.exit_id % 2 = 0 and pow(b.x + b.w / 2.0 - e.x, 2) + pow(b.y + b.h / 2.0 - e.y, 2) < 22500")
def j6_fire(v):
    """Boxes whose centre is less than 1.5 m from a fire door (every other exit)."""
    return rules.near_fire_doors(v.boxes, v.exits.where("exit_id % 2 = 0")).withColumn("distance", F.round("distance", 4))


@query("J6_far_exits", "with d as (select a.plan_id, a.exit_id, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) as d from exits a join exits b on a.plan_id = b.plan_id and a.exit_id <> b.exit_id group by all) select plan_id, exit_id, round(d, 4) as distance from d where d > 3000")
def j6_far(v):
    """Exits more than 30 m from the plan's nearest other exit; a plan has few exits."""
    a, b = v.exits.alias("a"), v.exits.alias("b")
    d = a.join(b, (F.col("a.plan_id") == F.col("b.plan_id")) & (F.col("a.exit_id") != F.col("b.exit_id")))
    d = d.groupBy(F.col("a.plan_id").alias("plan_id"), F.col("a.exit_id").alias("exit_id")).agg(F.min(F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))).alias("d"))
    return d.where("d > 3000").select("plan_id", "exit_id", F.round("d", 4).alias("distance"))


_WALL_BOX = "(select plan_id, least(x1, x2) as x, least(y1, y2) as y, abs(x2 - x1) as w, abs(y2 - y1) as h from walls)"


@query("J23_first_failure", f"""with l as (select distinct a.box_id from boxes a join {_WALL_BOX} b on a.plan_id = b.plan_id and {_TOUCH}), z as (select distinct a.box_id from boxes a join zones b on a.plan_id = b.plan_id and {_TOUCH}), o as (select distinct unnest([a.box_id, b.box_id]) as box_id from boxes a join boxes b on a.plan_id = b.plan_id and a.floor_level = b.floor_level and a.box_id < b.box_id and {_STRICT}), e as (select distinct box_id from {_NEAR} n where distance < 50)
  select b.plan_id, b.box_id, case when b.x < min_x or b.y < min_y or b.x + b.w > max_x or b.y + b.h > max_y then 'bounds' when l.box_id is not null then 'wall' when z.box_id is not null then 'zone' when o.box_id is not null then 'box' when e.box_id is not null then 'exit' else 'ok' end as reason from boxes b join plans using (plan_id) left join l using (box_id) left join z using (box_id) left join o using (box_id) left join e using (box_id)""")
def j23(v):
    return checks.first_failure(v.plans, v.boxes, v.walls, v.zones, v.exits).select("plan_id", "box_id", "reason")


@query("J17_edge_partitions", f"""with s as (select box_id, plan_id, floor_level, side, case side when 'left' then x when 'right' then x + w when 'bottom' then y else y + h end as c from boxes cross join (values ('left'), ('right'), ('bottom'), ('top')) as k(side)), w as (select plan_id, x1 as x, y1 as y from walls union select plan_id, x2, y2 from walls),
  l as (select distinct box_id, side from s join w on w.plan_id = s.plan_id and abs(s.c - case when side in ('left', 'right') then w.x else w.y end) < 20), n as (select distinct a.box_id, a.side from s a join s b on a.plan_id = b.plan_id and a.floor_level = b.floor_level and a.box_id <> b.box_id and abs(a.c - b.c) < 10 and b.side = case a.side when 'left' then 'right' when 'right' then 'left' when 'top' then 'bottom' else 'top' end)
  select s.box_id, s.side, case when n.box_id is not null then 'grey' when l.box_id is not null then 'white' else 'grey' end as partition, n.box_id is not null as shared from s left join l using (box_id, side) left join n using (box_id, side)""")
def j17(v):
    """Partition of each edge of a box: white along a wall's end (20 cm), grey where another box has its opposite edge (10 cm), which
    counts more, and grey otherwise."""
    return checks.edge_partitions(v.boxes, v.walls)


@query("A21_layout_features", f"""with o as (select a.plan_id, count(*) as n from boxes a join boxes b on a.plan_id = b.plan_id and a.floor_level = b.floor_level and a.box_id < b.box_id and {_TOUCH} group by a.plan_id), l as (select b.plan_id, count(*) as n from boxes b join walls w on w.plan_id = b.plan_id and pow(b.x + b.w / 2.0 - (w.x1 + w.x2) / 2.0, 2) + pow(b.y + b.h / 2.0 - (w.y1 + w.y2) / 2.0, 2) < 22500 group by b.plan_id),
  b as (select plan_id, count(*) as boxes, sum(cast(w as bigint) * h) / 10000.0 as area, coalesce(avg(distance), 0) / 100 as d, sqrt(var_pop(x + w / 2.0) + var_pop(y + h / 2.0)) / 100 as spread from {_NEAR} t group by plan_id), c as (select plan_id, sum(greatest(w, h)) / 100.0 as len from corridors group by plan_id), e as (select plan_id, count(*) as n from exits group by plan_id), z as (select plan_id, count(*) as n from zones group by plan_id)
  select p.plan_id, round(coalesce(area, 0) / f, 4) || '|' || round(coalesce(spread, 0) / 10, 4) || '|' || round(coalesce(d, 0) / 20, 4) || '|' || round(coalesce(len, 0) / f, 4) || '|' || round((coalesce(o.n, 0) + coalesce(l.n, 0)) / 10.0, 4) || '|' || round(coalesce(boxes, 0) / 50.0, 4) || '|' || round(coalesce(area, 0) / 1000, 4) || '|' || case when boxes > 0 then 1.0 else 0.0 end || '|' || round(coalesce(e.n, 0) / 10.0, 4) || '|' || round(coalesce(z.n, 0) / 20.0, 4) as features
  from (select plan_id, (max_x - min_x) * (max_y - min_y) / 10000.0 as f from plans) p left join b using (plan_id) left join c using (plan_id) left join o using (plan_id) left join l using (plan_id) left join e using (plan_id) left join z using (plan_id)""")
def a21(v):
    """Ten numbers of a layout, in metres: density, spread, mean exit distance, corridor length by area, collisions, boxes, area, whether
    there are boxes, exits, rooms."""
    f = checks.layout_features(v.plans, v.boxes, v.corridors, v.exits, v.zones, v.walls)
    return f.select("plan_id", F.array_join(F.transform("features", lambda x: F.round(x, 4).cast("string")), "|").alias("features"))


@query("M1_entity_features", f"""with f as (select layer, any_value(feature) as s from (with recursive l as (select distinct layer from entities), h(layer, i, v) as (select layer, 0, cast(0 as bigint) from l union all select layer, i + 1, ((v * 31 + ord(lower(layer)[i + 1]) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 from h where i < length(layer)) select layer, ((v % 4294967296 + 4294967296) % 4294967296) % 1000 / 1000.0 as feature from h where i = length(layer)) t group by layer)
  select entity_id, round(rgb // 65536 / 255.0, 6) as r, round(rgb // 256 % 256 / 255.0, 6) as g, round(rgb % 256 / 255.0, 6) as b, case when s = 0 then 0.001 else s end as layer_hash, w * h / 10000.0 as area, 2 * (w + h) / 100.0 as perimeter, round(greatest(w, h) * 1.0 / least(w, h), 6) as aspect, (x + w / 2.0) / 1000 as px, (y + h / 2.0) / 1000 as py
  from (select e.entity_id, e.layer, {_RGB} as rgb, b.x, b.y, b.w, b.h from entities e join boxes b on b.plan_id = e.plan_id and b.box_id = e.entity_id) t join f using (layer)""")
def m1(v):
    """The nine features of an entity, in metres."""
    shade = F.col("color") % 4
    e = _drawn(v).withColumn("rgb", F.when(shade == 0, 0).when(shade == 1, 16711680).when(shade == 2, 255).otherwise(F.col("color") * 65793))
    return checks.entity_features(e)


def entity_samples(v):
    """The nine features of each entity with its class by layer and colour, those of every tenth drawing corrected by a user to the class that their number names."""
    shade = F.col("color") % 4
    e = _drawn(v).withColumn("rgb", F.when(shade == 0, 0).when(shade == 1, 16711680).when(shade == 2, 255).otherwise(F.col("color") * 65793))
    e = graph.cut(e.select("entity_id", "layer", "color", "closed", "rgb", "x", "y", "w", "h"))
    # names are cleaned, matched and hashed once for each layer, colour and form, not for each entity
    by = ["layer", "color", "closed"]
    forms = e.select(*by).distinct().withColumns({"label": classify.entity_class(*map(F.col, by))["type"], "layer_hash": text.layer_hash(F.lower("layer"))})
    forms = graph.cut(forms.toDF(*(f"_{c}" for c in by), "label", "layer_hash"))
    e = e.join(forms, F.col("layer").eqNullSafe(F.col("_layer")) & F.col("color").eqNullSafe(F.col("_color")) & F.col("closed").eqNullSafe(F.col("_closed")))
    kinds = F.array(*map(F.lit, ("entrance", "envelope", "forbidden", "wall")))
    own = e.where("floor(entity_id / 10) % 10 = 0").select("entity_id", F.element_at(kinds, (F.col("entity_id") % 4 + 1).cast("int")).alias("label"))
    features = checks.entity_features(e, "label")
    return learning.with_corrections(features, own, "entity_id")


@query("M8_entity_classifier")
def m8_entities(v):
    """A classifier of entities fitted on the training part, saved, loaded again, and its confusion on the test part."""
    samples = graph.cut(entity_samples(v).withColumn("part", learning.part_of(F.col("entity_id"))))
    path = graph.shared_folder(v.spark)
    learning.save(learning.fitted(samples.where("part = 'train'"), learning.ENTITY_FEATURES), path)
    return learning.confusion(learning.applied(samples.where("part = 'test'"), learning.load(path), learning.ENTITY_FEATURES))


@query("M1_room_features", f"""with n as (select a.zone_id, count(*) as n from zones a join zones b on a.plan_id = b.plan_id and a.zone_id <> b.zone_id and {_TOUCH} group by a.zone_id), d as (select z.zone_id, min(sqrt(pow(z.x + z.w / 2.0 - e.x, 2) + pow(z.y + z.h / 2.0 - e.y, 2))) / 100 as d from zones z join exits e using (plan_id) group by z.zone_id)
  select zone_id, w * h / 10000.0 as area, round(w * 1.0 / h, 6) as aspect, coalesce(n.n, 0) as adjacent, round(coalesce(d.d, 10), 4) as exit_distance, 2 * (w + h) / 100.0 as perimeter from zones left join n using (zone_id) left join d using (zone_id)""")
def m1_rooms(v):
    """The five features of a room: area, aspect, rooms that touch it, distance from the nearest exit (10 m without one), perimeter."""
    f = checks.room_features(v.zones, v.exits)
    return f.select("zone_id", "area", F.round("aspect", 6).alias("aspect"), "adjacent", F.round("exit_distance", 4).alias("exit_distance"), "perimeter")


_NOISE = lambda i: f"case when copy = 0 then 1.0 else 1 + ((zone_id * 7919 + copy * 104729 + {i} * 1299709) % 10007 / 10007.0 - 0.5) * 0.1 end"


@query("M5_augmented", f"select zone_id, copy, round(w * {_NOISE(0)}, 6) as w, round(h * {_NOISE(1)}, 6) as h from (select zone_id, w, h, unnest([0, 1, 2, 3]) as copy from zones) t")
def m5(v):
    """Each zone's sides with three noisy copies."""
    return checks.augmented(v.zones.select("zone_id", "w", "h"), "zone_id", ["w", "h"]).select("zone_id", "copy", F.round("w", 6).alias("w"), F.round("h", 6).alias("h"))


_HISTORY = "(select user_id % 5 as model, event_id as step, value as loss, case when event_type = 'view' then null else value % 100 end as acc, value * 7 % 90 as val_loss, value % 50 as val_acc from events)"


@query("M6_history_metrics", f"""with h as (select *, row_number() over (partition by model order by step) as epoch from {_HISTORY} t) select model, round(arg_max(struct_pack(x := loss), epoch).x, 4) as final_loss, round(arg_max(struct_pack(x := acc), epoch).x, 4) as final_accuracy, round(arg_max(struct_pack(x := val_loss), epoch).x, 4) as final_val_loss, round(arg_max(struct_pack(x := val_acc), epoch).x, 4) as final_val_accuracy,
  count(*) as epochs, min(epoch) filter (val_loss = m) as best_epoch from (select *, min(val_loss) over (partition by model) as m from h) t group by model""")
def m6_history(v):
    """Last and best epoch of each model's training history (made from the events of users)."""
    e = v.raw("events")
    value = F.col("value")
    h = e.select((F.col("user_id") % 5).alias("model"), F.col("event_id").alias("step"), value.alias("loss"), F.when(F.col("event_type") != "view", value % 100).alias("acc"), (value * 7 % 90).alias("val_loss"), (value % 50).alias("val_acc"))
    m = checks.history_metrics(h)
    return m.select("model", *(F.round(c, 4).alias(c) for c in ("final_loss", "final_accuracy", "final_val_loss", "final_val_accuracy")), "epochs", "best_epoch")


_ROOM_KIND = "case zone_id % 5 when 0 then 'office' when 1 then 'meeting' when 2 then 'restroom' when 3 then 'utility' else 'hall' end"
_ROOM_LEAST = "(values ('office', 70, 7), ('meeting', 120, 10), ('restroom', 30, 5), ('utility', 20, 4)) as m(type, a, s)"


@query("A8_room_minimums", f"""with r as (select z.*, w * h / (30.48 * 30.48) as area, least(w, h) / 30.48 as side, m.a, m.s from (select *, {_ROOM_KIND} as type from zones) z join {_ROOM_LEAST} on m.type = z.type) select plan_id, 'room_area' as code, 'MAJOR' as severity, zone_id as element_id, round(area, 4) as actual, a::double as required from r where area < a
  union all select plan_id, 'room_dimension', 'MINOR', zone_id, round(side, 4), s::double from r where side < s""")
def a8_rooms(v):
    """Rooms under the least area or side of their type; halls have none."""
    kinds = F.array(*(F.lit(k) for k in ("office", "meeting", "restroom", "utility", "hall")))
    return rules.room_minimums(v.zones.withColumn("type", F.get(kinds, F.col("zone_id") % 5)))


@query("A7_fire_compartments", "select plan_id, area, cast(ceil(area / 500) - 1 as bigint) as walls from (select plan_id, sum(cast(w as bigint) * h) / 10000.0 as area from boxes group by plan_id) t where area > 500")
def a7_compartments(v):
    return rules.fire_compartments(v.boxes)


_LEVEL = lambda p, w: f"(a.{p} <= b.{p} + b.{w} and b.{p} <= a.{p} + a.{w})"
_APART = lambda p, w: f"greatest(a.{p} - b.{p} - b.{w}, b.{p} - a.{p} - a.{w}) <= 100"
_BESIDE = f"(select distinct a.box_id from boxes a join corridors b on a.plan_id = b.plan_id and (({_LEVEL('x', 'w')} and {_APART('y', 'h')}) or ({_LEVEL('y', 'h')} and {_APART('x', 'w')})))"


@query("J10_isolated_boxes", f"select plan_id, count(*) as boxes, count(*) filter (c.box_id is null) as isolated, round(count(*) filter (c.box_id is null) * 1.0 / count(*), 6) as rate from boxes left join {_BESIDE} c using (box_id) group by plan_id")
def j10(v):
    """Boxes no corridor overlaps or lies beside (a metre), and their share."""
    near = checks.connected_boxes(v.boxes, v.corridors).withColumn("near", F.lit(1))
    alone = F.count(F.when(F.col("near").isNull(), 1))
    return v.boxes.join(near, "box_id", "left").groupBy("plan_id").agg(F.count(F.lit(1)).alias("boxes"), alone.alias("isolated"), F.round(alone / F.count(F.lit(1)), 6).alias("rate"))


_CORNER = "(select plan_id, zone_id, x as ax, y as ay, x + w as bx, y as by_, x + w / 2.0 as cx, cast(y + h as double) as cy from zones)"


@query("P13_points_in_polygons", f"""with p as (select b.box_id, b.x + b.w / 2.0 as x, b.y + b.h / 2.0 as y, t.* exclude (plan_id) from boxes b join {_CORNER} t on t.plan_id = b.plan_id), e as (select box_id, zone_id, x, y, case k when 0 then ax when 1 then bx else cx end as px, case k when 0 then ay when 1 then by_ else cy end as py, case k when 0 then bx when 1 then cx else ax end as qx, case k when 0 then by_ when 1 then cy else ay end as qy from p cross join (values (0), (1), (2)) as k(k))
  select box_id, zone_id from e group by box_id, zone_id having sum(case when (py > y) <> (qy > y) and x < (qx - px) * (y - py) / (qy - py) + px then 1 else 0 end) % 2 = 1""")
def p13(v):
    """Boxes whose centre lies in the triangle over a zone's base."""
    d = lambda c: F.col(c).cast("double")
    x, y, w, h = (d(c) for c in "xywh")
    ring = F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (x + w, y), (x + w / 2, y + h))))
    centres = spatial.points(v.boxes.select("plan_id", "box_id", (x + w / 2).alias("x"), (y + h / 2).alias("y")))
    pairs = spatial.grid_join(centres, v.zones.withColumn("ring", ring), ["plan_id"], geometry.overlap("a", "b", strict=False))
    return pairs.where(geometry.inside(F.col("a.x"), F.col("a.y"), F.col("b.ring"))).select("box_id", "zone_id")
