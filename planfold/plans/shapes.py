"""Queries on segments, rings and shapes: crossings, clean-up, doors, sanitised corridors and arrows."""

from __future__ import annotations

from pyspark.sql import functions as F

from planfold.catalog import query
from planfold.functions import geometry, text
from planfold.operators import networks, shapes, spatial

_CCW = lambda a, b, c: f"(({c}y - {a}y) * ({b}x - {a}x) > ({b}y - {a}y) * ({c}x - {a}x))"
_CROSS = f"({_CCW('p', 'r', 's')} <> {_CCW('q', 'r', 's')} and {_CCW('p', 'q', 'r')} <> {_CCW('p', 'q', 's')})"
_SIGHT = "(select a.plan_id, a.zone_id, b.wall_id, a.x as px, a.y as py, a.x + a.w as qx, a.y + a.h as qy, b.x1 as rx, b.y1 as ry, b.x2 as sx, b.y2 as sy from zones a join walls b on a.plan_id = b.plan_id)"


def _walls(v):
    return shapes.as_rectangles(v.walls)


@query("P14_segment_crossings", f"""with d as (select *, cast((px - qx) * (ry - sy) - (py - qy) * (rx - sx) as double) as d from {_SIGHT} t), u as (select *, ((px - rx) * (ry - sy) - (py - ry) * (rx - sx)) / nullif(d, 0) as t, -((px - qx) * (py - ry) - (py - qy) * (px - rx)) / nullif(d, 0) as u from d)
  select plan_id, zone_id, wall_id, {_CROSS} as crosses, round(px + t * (qx - px), 4) as x, round(py + t * (qy - py), 4) as y, t > 0.01 and t < 0.99 and u > 0.01 and u < 0.99 as inner_point from u where t between 0 and 1 and u between 0 and 1""")
def p14(v):
    """Where the diagonals of zones meet walls."""
    pairs = spatial.grid_join(v.zones, _walls(v), ["plan_id"], geometry.overlap("a", "b", strict=False))
    c = lambda t, n: F.col(f"{t}.{n}")
    ends = ((c("a", "x"), c("a", "y")), (c("a", "x") + c("a", "w"), c("a", "y") + c("a", "h")), (c("b", "x1"), c("b", "y1")), (c("b", "x2"), c("b", "y2")))
    out = pairs.select(c("a", "plan_id").alias("plan_id"), "zone_id", "wall_id", geometry.segments_cross(*ends).alias("crosses"), geometry.crossing(*ends).alias("at")).where("at is not null")
    return out.select("plan_id", "zone_id", "wall_id", "crosses", F.round("at.x", 4).alias("x"), F.round("at.y", 4).alias("y"), F.col("at.inner").alias("inner_point"))


_MIDDLE = "(select a.plan_id, a.corridor_id, b.wall_id, case when a.w >= a.h then a.x else a.x + a.w / 2.0 end as px, case when a.w >= a.h then a.y + a.h / 2.0 else a.y end as py, case when a.w >= a.h then a.x + a.w else a.x + a.w / 2.0 end as qx, case when a.w >= a.h then a.y + a.h / 2.0 else a.y + a.h end as qy, b.x1 as rx, b.y1 as ry, b.x2 as sx, b.y2 as sy from corridors a join walls b on a.plan_id = b.plan_id)"


@query("J8_corridors_across_walls", f"select plan_id, corridor_id, count(*) as walls, min(wall_id) as first_wall from {_MIDDLE} t where {_CROSS} group by all")
def j8_walls(v):
    """Corridors whose centreline crosses a wall."""
    return shapes.across_walls(v.corridors, v.walls)


_TRIANGLE = "(select plan_id, zone_id, x as ax, y as ay, x + w as bx, y as by_, x + w / 2.0 as cx, cast(y + h as double) as cy from zones)"
_EDGES = "(values (0), (1), (2)) as k(k)"


@query("P16_boxes_meeting_polygons", f"""with pair as (select b.box_id, b.x, b.y, b.w, b.h, t.* exclude (plan_id) from boxes b join {_TRIANGLE} t on t.plan_id = b.plan_id and t.ax <= b.x + b.w and b.x <= t.bx and t.ay <= b.y + b.h and b.y <= t.cy),
  e as (select box_id, zone_id, x, y, w, h, case k when 0 then ax when 1 then bx else cx end as px, case k when 0 then ay when 1 then by_ else cy end as py, case k when 0 then bx when 1 then cx else ax end as qx, case k when 0 then by_ when 1 then cy else ay end as qy from pair cross join {_EDGES}),
  c as (select *, i, case i when 1 then x + w when 2 then x + w else x end as rx, case i when 2 then y + h when 3 then y + h else y end as ry, case i when 0 then x + w when 1 then x + w else x end as sx, case i when 1 then y + h when 2 then y + h else y end as sy from e cross join (values (0), (1), (2), (3)) as n(i)),
  corner as (select box_id, zone_id, i, sum(case when (py > ry) <> (qy > ry) and rx < (qx - px) * (ry - py) / (qy - py) + px then 1 else 0 end) % 2 = 1 as inside, bool_or(px between x and x + w and py between y and y + h) as vertex, bool_or({_CROSS}) as crosses from c group by all)
  select box_id, zone_id from corner group by all having bool_or(inside or vertex or crosses)""")
def p16(v):
    """Boxes that meet the triangle over each zone's base."""
    d = lambda c: c.cast("double")
    x, y, w, h = (d(F.col(c)) for c in "xywh")
    triangle = F.array(*(F.struct(d(a).alias("x"), d(b).alias("y")) for a, b in ((x, y), (x + w, y), (x + w / 2, y + h))))
    pairs = spatial.grid_join(v.boxes, v.zones.withColumn("ring", triangle), ["plan_id"], geometry.overlap("a", "b", strict=False))
    return pairs.where(geometry.rectangle_meets(*(d(F.col(f"a.{c}")) for c in "xywh"), F.col("b.ring"))).select("box_id", "zone_id")


@query("P17_cleaned_rings", "select zone_id, case when zone_id % 2 = 0 then 5 else 4 end as n, cast(x as double)::varchar || ',' || cast(y as double)::varchar || ';' || case when zone_id % 2 = 0 then (x + w / 2.0)::double::varchar || ',' || (y - 20)::double::varchar || ';' else '' end || (x + w)::double::varchar || ',' || y::double::varchar || ';' || (x + w)::double::varchar || ',' || (y + h)::double::varchar || ';' || x::double::varchar || ',' || (y + h)::double::varchar as points from zones")
def p17(v):
    """Rings of zones drawn with a null, a doubled and a closing point, and a point half-way along the base: straight or, in every other
    zone, bent outwards."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y, w, h = (F.col(c) for c in "xywh")
    bend = F.when(F.col("zone_id") % 2 == 0, 20).otherwise(0)
    drawn = F.array(p(x, y), p(x + 0.01, y), p(x + w / 2, y - bend), F.lit(None).cast("struct<x: double, y: double>"), p(x + w, y), p(x + w, y + h), p(x + w, y + h), p(x, y + h), p(x, y))
    r = v.zones.select("zone_id", geometry.cleaned(drawn, 0.05).alias("r"))
    said = F.array_join(F.transform("r", lambda q: F.concat(q["x"].cast("string"), F.lit(","), q["y"].cast("string"))), ";")
    return r.select("zone_id", F.size("r").alias("n"), said.alias("points"))


@query("U2_distinct_rings", "select plan_id, count(distinct (x, y, w, h)) as rings from zones group by plan_id")
def u2_rings(v):
    """Zones drawn from each of two corners and in both directions: rings are the same whatever their start and direction."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y, w, h = (F.col(c) for c in "xywh")
    corners = [p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h)]
    rings = F.array(F.array(*corners), F.array(*corners[2:], *corners[:2]), F.array(*reversed(corners)))
    keys = v.zones.select("plan_id", F.explode(rings).alias("ring")).select("plan_id", geometry.ring_key(F.col("ring")).alias("key")).dropDuplicates()
    return keys.groupBy("plan_id").agg(F.count(F.lit(1)).alias("rings"))


@query("P10_sanitised_corridors", """select corridor_id, form, round(x, 4) as x, round(y, 4) as y, round(w, 4) as width, round(h, 4) as height, round(area, 4) as area, points from (
    select corridor_id, 'polygon' as form, 0.0 as x, 0.0 as y, w, h, 0.0 as area, 4 as points from corridors where corridor_id % 5 = 0
    union all select corridor_id, 'path', null, null, null, null, null, 2 from corridors where corridor_id % 5 = 1 and w >= h
    union all select corridor_id, 'rectangle', x, y, w, h, w * h, null from corridors where corridor_id % 5 = 2) t""")
def p10(v):
    """Corridors that come as polygons (with a broken point), as paths (of one point where they run upwards), as rectangles, with a
    missing side, or empty."""
    k, at = F.col("corridor_id") % 5, lambda *p: F.array(*(F.lit(None).cast("array<double>") if q is None else F.array(*(c.cast("double") for c in q)) for q in p))
    x, y, w, h = (F.col(c) for c in "xywh")
    polygon = F.when(k == 0, at((x, y), (x + w, y), None, (x + w, y + h), (x, y + h)))
    path = F.when(k == 1, F.when(w >= h, at((x, y), (x + w, y))).otherwise(at((x, y), None)))
    side = lambda c, *n: F.when(k.isin(*n), c.cast("double"))
    c = v.corridors.select("corridor_id", polygon.alias("polygon"), path.alias("path"), side(x, 2, 3).alias("x"), side(y, 2, 3).alias("y"), side(w, 2, 3).alias("width"), side(h, 2).alias("height"), F.lit(None).cast("double").alias("area"))
    return shapes.sanitised_corridors(c).select("corridor_id", "form", *(F.round(n, 4).alias(n) for n in ("x", "y", "width", "height", "area")), F.size(F.coalesce("polygon", "path")).alias("points"))


@query("P10_sanitised_arrows", "select corridor_id, cast(x as double) as x, cast(y as double) as y, 0.0::double as z, case corridor_id % 3 when 1 then 'up' else 'right' end as direction, 'corridor_flow' as type, 'green' as color, case corridor_id % 3 when 2 then 'large' else 'medium' end as size from corridors where corridor_id % 4 > 0")
def p10_arrows(v):
    k = F.col("corridor_id") % 3
    text = lambda c: c.cast("string")
    a = v.corridors.select("corridor_id", F.when(F.col("corridor_id") % 4 > 0, F.col("x")).cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(None).cast("double").alias("z"), F.when(k == 1, "UP").alias("direction"), text(F.lit(None)).alias("type"), text(F.lit(None)).alias("color"), F.when(k == 2, "large").alias("size"))
    return shapes.sanitised_arrows(a).select("corridor_id", "x", "y", "z", "direction", "type", "color", "size")


_DRAWN = "(select zone_id, case zone_id % 3 when 0 then 'ARC' when 1 then 'LINE' else 'TEXT' end as kind, case when w % 20 = 0 then 'A-Door' else 'Porte 2' end as layer, x, y, w, h, case when h % 2 = 0 then 0 else h % 180 end as a2 from zones where h % 4 > 0)"


@query("P23_door_candidates", f"""select zone_id, kind, upper(layer) as layer, round(case kind when 'ARC' then x + h * cos(radians(w % 90)) else x end, 4) as x1, round(case kind when 'ARC' then y + h * sin(radians(w % 90)) else y end, 4) as y1,
  round(case kind when 'ARC' then x + h * cos(radians(case when a2 = 0 then 90 else a2 end)) else x + w end, 4) as x2, round(case kind when 'ARC' then y + h * sin(radians(case when a2 = 0 then 90 else a2 end)) else y + h end, 4) as y2, round(case kind when 'ARC' then 2.0 * h else sqrt(w * w + h * h) end, 4) as width from {_DRAWN} t where kind <> 'TEXT'""")
def p23(v):
    """Arcs and lines drawn from zones, on door layers but for every fourth height."""
    kind = F.when(F.col("zone_id") % 3 == 0, "ARC").when(F.col("zone_id") % 3 == 1, "LINE").otherwise("TEXT")
    layer = F.when(F.col("h") % 4 == 0, "A-WALL").when(F.col("w") % 20 == 0, "A-Door").otherwise("Porte 2")
    e = v.zones.select("zone_id", kind.alias("kind"), layer.alias("layer"), "x", "y", F.col("h").alias("radius"), (F.col("w") % 90).alias("start_angle"), F.when(F.col("h") % 2 == 0, 0).otherwise(F.col("h") % 180).alias("end_angle"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    return shapes.door_candidates(e).select("zone_id", "kind", "layer", *(F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2", "width")))


_D = lambda p, q: f"pow({p}x - greatest(least({q}x1, {q}x2), least({p}x, greatest({q}x1, {q}x2))), 2) + pow({p}y - greatest(least({q}y1, {q}y2), least({p}y, greatest({q}y1, {q}y2))), 2)"


@query("J19_doors_between_walls", f"""with w as (select plan_id, wall_id, x1, y1, x2, y2, x1 = x2 as up from walls), pair as (select a.plan_id, a.wall_id as a_id, b.wall_id as b_id, a.x1 as sx, a.y1 as sy, a.x2 as ex, a.y2 as ey, b.x1 as bx1, b.y1 as by1, b.x2 as bx2, b.y2 as by2 from w a join w b on a.plan_id = b.plan_id and a.wall_id < b.wall_id and a.up = b.up),
  d as (select *, sqrt(least({_D('s', 'b')}, {_D('e', 'b')})) as gap from pair)
  select plan_id, a_id, b_id, round(gap, 4) as gap, round((sx + ex) / 2.0 - gap / 2, 4) as x1, round((sy + ey) / 2.0 - gap / 2, 4) as y1, round((bx1 + bx2) / 2.0 + gap / 2, 4) as x2, round((by1 + by2) / 2.0 + gap / 2, 4) as y2 from d where gap > 80 and gap < 250""")
def j19(v):
    """Parallel walls 0.8 to 2.5 m apart, with the door drawn between their middles."""
    return shapes.doors_between_walls(v.walls).select("plan_id", "a_id", "b_id", *(F.round(c, 4).alias(c) for c in ("gap", "x1", "y1", "x2", "y2")))


@query("P21_decomposed_corridors", """select corridor_id, 'h' as part, x::double as x, y::double as y, w::double as w, 120.0::double as h from corridors where corridor_id % 3 = 0 union all select corridor_id, 'v', x + w, y, 120.0, h + 300 from corridors where corridor_id % 3 = 0
  union all select corridor_id, '', x, y, w, h from corridors where corridor_id % 3 > 0""")
def p21_parts(v):
    """Every third corridor is L-shaped, turning upwards at its right end."""
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = (F.col(c).cast("double") for c in "xywh")
    corners = F.when(F.col("corridor_id") % 3 == 0, F.array(at(x, y), at(x + w, y), at(x + w, y + h), at(x + w, y + h + 300)))
    return shapes.decomposed(v.corridors.withColumn("corners", corners), 120)


_POINTS = "(select plan_id, unnest([x, x + w, x, x + w]) as x, unnest([y, y, y + h, y + h]) as y from boxes union all select plan_id, unnest([x, x + w]), unnest([y, y + h]) from corridors)"


@query("A18_trimmed_bounds", f"""with p as (select * from {_POINTS} t), r as (select plan_id, x, y, row_number() over (partition by plan_id order by x) - 1 as rx, row_number() over (partition by plan_id order by y) - 1 as ry, count(*) over (partition by plan_id) as n from p), q as (select *, cast(floor(n * 0.01) as bigint) as low, least(greatest(cast(floor(n * 0.01) as bigint) + 1, cast(ceil(n * 0.99) as bigint) - 1), n - 1) as high from r),
  e as (select plan_id, max(n) as n, max(x) filter (rx = low) as x1, max(x) filter (rx = high) as x2, max(y) filter (ry = low) as y1, max(y) filter (ry = high) as y2 from q group by plan_id), t as (select p.*, n, e.x1, e.x2, e.y1, e.y2, greatest(3, (e.x2 - e.x1) * 0.012) as px, greatest(3, (e.y2 - e.y1) * 0.012) as py from plans p left join e using (plan_id)),
  b as (select *, coalesce(n, 0) < 8 or x2 <= x1 or y2 <= y1 or (((x2 - x1 + 2 * px) / (max_x - min_x) < 0.22 or (y2 - y1 + 2 * py) / (max_y - min_y) < 0.22) and sqrt(pow(max_x - min_x, 2) + pow(max_y - min_y, 2)) <= 1.6 * sqrt(pow(x2 - x1 + 2 * px, 2) + pow(y2 - y1 + 2 * py, 2))) as back from t)
  select plan_id, round(case when back then min_x else x1 - px end, 4) as min_x, round(case when back then min_y else y1 - py end, 4) as min_y, round(case when back then max_x else x2 + px end, 4) as max_x, round(case when back then max_y else y2 + py end, 4) as max_y from b""")
def a18_trimmed(v):
    """Bounds of the corners of boxes and the ends of corridors without one in a hundred at each side."""
    x, y, w, h = (F.col(c) for c in "xywh")
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    points = v.boxes.select("plan_id", F.inline(F.array(at(x, y), at(x + w, y), at(x, y + h), at(x + w, y + h)))).unionByName(v.corridors.select("plan_id", F.inline(F.array(at(x, y), at(x + w, y + h)))))
    return shapes.trimmed_bounds(v.plans, points).select("plan_id", *(F.round(c, 4).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")))


_PAD = lambda c, n: f"case when length(({c})::varchar) >= {n} then ({c})::varchar else lpad(({c})::varchar, {n}, '0') end"
_CODE = "(select box_id, floor_level + 1 as z, y // 300 as r, box_id % 2000 as n from boxes)"


@query("P26_box_codes", f"select box_id, 'Z' || {_PAD('z', 2)} || '-R' || {_PAD('r', 2)} || '-' || {_PAD('n', 3)} as plain, {_PAD('n', 2)} as compact, 'ZONE' || {_PAD('z', 2)} || '-ROW' || {_PAD('r', 2)} || '-' || {_PAD('n', 4)} as verbose, z::bigint as zone, r::bigint as row_no, n::bigint as number, true as same, false as other from {_CODE} t")
def p26(v):
    """Codes of boxes in three schemes; the default one is parsed back, the compact one doesn't parse as it."""
    z, r, n = F.col("floor_level") + 1, F.floor(F.col("y") / 300), F.col("box_id") % 2000
    b = v.boxes.select("box_id", *(text.box_code(z, r, n, s).alias(name) for s, name in (("default", "plain"), ("compact", "compact"), ("verbose", "verbose"))))
    p, q = text.parsed_code(F.col("plain")), text.parsed_code(F.col("verbose"), "verbose")
    return b.select("*", p["zone"].alias("zone"), p["row"].alias("row_no"), p["number"].alias("number"), (p == q).alias("same"), text.parsed_code(F.col("compact")).isNotNull().alias("other"))


@query("W13_merged_corridors")
def w13_merged(v):
    """Corridors of one direction that overlap, or nearly touch, made one."""
    rects = v.corridors.select("plan_id", (F.col("w") >= F.col("h")).alias("flat"), F.col("corridor_id").alias("id"), "x", "y", "w", "h")
    return networks.merged_rectangles(rects, ["plan_id", "flat"])
