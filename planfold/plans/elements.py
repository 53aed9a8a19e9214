"""Queries on rooms, zones, walls and texts: classes, catalogues, presets, labels, clearances, features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planfold.catalog import query
from planfold.functions import geometry
from planfold.operators import catalogs, classify, spatial
from planfold.operators.shapes import path_arrows, perimeter_walls, synthetic_envelopes
from planfold.plans.layout import _GAP2, _STRICT, _TOUCH, FLOOR

@query("P18_usable_area", "with t as (select plan_id, case when plan_id % 4 = 0 then null when plan_id % 4 = 1 then 0 else 100 + plan_id end as total, case when plan_id % 8 = 0 then null else max_x - min_x end as width, max_y - min_y as height from plans), r as (select plan_id, sum(cast(w as bigint) * h) as rooms from zones group by plan_id) select t.plan_id, case when total > 0 then total when width > 0 then width * height when rooms > 0 then rooms else 0 end::double as area, case when total > 0 then 'totalArea' when width > 0 then 'bounds' when rooms > 0 then 'rooms' else 'unknown' end as source from t left join r using (plan_id)")
def p18(v):
    """Total area, else bounds, else the sum of rooms, else 0, with its source."""
    total = F.when(F.col("plan_id") % 4 == 1, 0).when(F.col("plan_id") % 4 > 1, 100 + F.col("plan_id"))
    width = F.when(F.col("plan_id") % 8 != 0, F.col("max_x") - F.col("min_x"))
    rooms = v.zones.groupBy("plan_id").agg(F.sum(F.col("w").cast("long") * F.col("h")).alias("rooms"))
    p = v.plans.select("plan_id", total.alias("total"), (width * (F.col("max_y") - F.col("min_y"))).alias("box")).join(rooms, "plan_id", "left")
    pick = lambda a, b, c, d: F.when(F.col("total") > 0, a).when(F.col("box") > 0, b).when(F.col("rooms") > 0, c).otherwise(d)
    return p.select("plan_id", pick(F.col("total"), F.col("box"), F.col("rooms"), F.lit(0)).cast("double").alias("area"), pick(F.lit("totalArea"), F.lit("bounds"), F.lit("rooms"), F.lit("unknown")).alias("source"))


_CLEAR = "case " + " ".join(f"when regexp_matches(lower(name), '{p}') then {round(100 * c)}" for p, c in catalogs.CLEARANCES) + f" else {round(100 * catalogs.DEFAULT_CLEARANCE)} end"


@query("P22_exclusion_zones", f"with o as (select plan_id, type as name, connector_id as element_id, x, y, 100 as w, 100 as h from connectors union all select plan_id, 'exit', exit_id, x, y, 100, 100 from exits union all select plan_id, layer, wall_id, least(x1, x2), least(y1, y2), abs(x2 - x1), abs(y2 - y1) from walls), c as (select *, {_CLEAR} as clearance from o) select plan_id, name, element_id, clearance, x - clearance as x1, y - clearance as y1, x + w + clearance as x2, y + h + clearance as y2 from c")
def p22(v):
    """Connectors and exits (a metre wide) and walls, grown by the clearance that their name asks for."""
    one = F.lit(100).cast("long")
    o = v.connectors.select("plan_id", F.col("type").alias("name"), F.col("connector_id").alias("element_id"), "x", "y", one.alias("w"), one.alias("h"))
    o = o.unionByName(v.exits.select("plan_id", F.lit("exit").alias("name"), F.col("exit_id").alias("element_id"), "x", "y", one.alias("w"), one.alias("h")))
    o = o.unionByName(_segments(v).join(v.walls.select("wall_id", "layer"), "wall_id").select("plan_id", F.col("layer").alias("name"), F.col("wall_id").alias("element_id"), "x", "y", "w", "h"))
    return catalogs.exclusion_zones(o).select("plan_id", "name", "element_id", "clearance", "x1", "y1", "x2", "y2")


_ELEMENTS = "(select entity_id, case when entity_type = 'HATCH' and color % 7 = 0 then 'ARC' when entity_type = 'HATCH' and color % 7 = 1 then 'CIRCLE' else entity_type end as t, (len_cm * (1 + color % 3)) / 100.0::double as n, w / 1000.0::double as w, h / 1000.0::double as h, w / 100.0::double * h / 100 as a from entities join boxes on box_id = entity_id)"


@query("P24_element_flags", f"""select entity_id, t = 'ARC' or (t = 'LINE' and n > 0.8 and n < 1.5) as door, case when t = 'ARC' then 'swing' when t = 'LINE' and n > 0.8 and n < 1.2 then 'single' when t = 'LINE' and n > 0.8 and n < 1.5 then 'standard' end as door_type,
  case when t = 'ARC' then 0.9 when t = 'LINE' and n > 0.8 and n < 1.2 then 0.8 when t = 'LINE' and n > 0.8 and n < 1.5 then 0.5 end::double as door_confidence, t = 'LINE' and n > 2 and n < 10 as stair, case when t = 'LINE' and n > 2 and n < 10 then floor(n / 0.3::double) else 0 end::bigint as steps,
  w * 10 * h * 10 > 1 and w * 10 * h * 10 < 10 as elevator, w * 10 * h * 10 > 2 and w * 10 * h * 10 < 8 and greatest(w * 10, h * 10) / least(w * 10, h * 10) < 2 as elevator_by_size, t = 'CIRCLE' or (abs(w * 10 - h * 10) < 0.1 and w * 10 < 0.5) as "column" from {_ELEMENTS} e""")
def p24(v):
    """Entities with the extent of their box; some hatches stand for arcs and circles."""
    kind = F.when((F.col("entity_type") == "HATCH") & (F.col("color") % 7 == 0), "ARC").when((F.col("entity_type") == "HATCH") & (F.col("color") % 7 == 1), "CIRCLE").otherwise(F.col("entity_type"))
    e = v.entities.join(v.boxes.select(F.col("box_id").alias("entity_id"), "w", "h"), "entity_id")
    e = e.select("entity_id", kind.alias("entity_type"), (F.col("len_cm") * (1 + F.col("color") % 3) / 100).alias("length"), (F.col("w") / 1000 * 10).alias("width"), (F.col("h") / 1000 * 10).alias("height"))
    return e.select("entity_id", *(c.alias(n) for n, c in catalogs.element_flags().items()))


@query("P27_suggestions", "with i as (select plan_id, 'Box ' || box_id || ' has area ' || (w * h) || ', minimum is 20000' as message from boxes where w * h < 20000 union all select plan_id, 'Corridor ' || corridor_id || ' width ' || least(w, h) || ' below minimum 120' from corridors where least(w, h) < 120) select plan_id, message, case when message like '%area%' then 'scale' when message like '%width%' then 'widen' end as action, case when message like '%area%' then round(sqrt(20000.0 / cast(regexp_extract(message, 'area ([0-9]+)', 1) as double)), 4) when message like '%width%' then 120.0 - cast(regexp_extract(message, 'width ([0-9]+)', 1) as double) end as amount from i")
def p27(v):
    """A suggestion and its amount for each message, from its words and numbers."""
    area, width = F.col("w") * F.col("h"), F.least("w", "h")
    a = v.boxes.where(area < 20000).select("plan_id", F.concat(F.lit("Box "), "box_id", F.lit(" has area "), area, F.lit(", minimum is 20000")).alias("message"))
    b = v.corridors.where(width < 120).select("plan_id", F.concat(F.lit("Corridor "), "corridor_id", F.lit(" width "), width, F.lit(" below minimum 120")).alias("message"))
    number = lambda word: F.regexp_extract("message", word + " ([0-9]+)", 1).try_cast("double")
    said = lambda word: F.col("message").contains(word)
    m = a.unionByName(b)
    return m.select("plan_id", "message", F.when(said("area"), "scale").when(said("width"), "widen").alias("action"), F.when(said("area"), F.round(F.sqrt(20000 / number("area")), 4)).when(said("width"), 120.0 - number("width")).alias("amount"))


@query("P28_preset_checks", "select plan_id, abs(sum(weight) - 100) <= 0.01 and bool_and(regexp_matches(size_range, '^\\d+-\\d+$')) and bool_and(weight between 0 and 100) as valid, sum(weight)::bigint as total, count(*) filter (not regexp_matches(size_range, '^\\d+-\\d+$')) as bad_keys from (select * from distributions where plan_id % 3 > 0 or size_range not in ('XL', 'bad')) t group by plan_id")
def p28(v):
    """Presets as maps: percents that sum to 100, keys like a-b."""
    d = v.distributions.where("plan_id % 3 > 0 or size_range not in ('XL', 'bad')").groupBy("plan_id").agg(F.map_from_entries(F.collect_list(F.struct("size_range", "weight"))).alias("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda s, x: s + x)
    ok_keys, ok_values = F.forall(F.map_keys("m"), lambda k: k.rlike(r"^\d+-\d+$")), F.forall(F.map_values("m"), lambda x: (x >= 0) & (x <= 100))
    return d.select("plan_id", ((F.abs(total - 100) <= 0.01) & ok_keys & ok_values).alias("valid"), total.alias("total"), F.size(F.filter(F.map_keys("m"), lambda k: ~k.rlike(r"^\d+-\d+$"))).cast("long").alias("bad_keys"))


_PRESETS = ", ".join(f"('{code}', " + ", ".join("null" if x is None else str(x).lower() for x in said) + ")" for code, said in catalogs.CODE_PRESETS.items())


@query("P29_code_presets", f"with p(code, corridor, egress, elevators, entrances) as (values {_PRESETS}) select plan_id, coalesce(p.corridor, 1.3 + plan_id % 7)::double as corridor_width, coalesce(p.egress, 50)::double as egress_limit, coalesce(p.elevators, plan_id % 2 = 0) as require_elevators, coalesce(p.entrances, 2)::int as accessible_entrances from plans left join p on p.code = case plan_id % 5 when 0 then 'ibc_common' when 1 then 'eurocode_style' when 2 then 'storage_warehouse' when 3 then 'none' else 'unknown' end")
def p29(v):
    """A preset of a building code laid over current values; what it leaves out is kept."""
    k = F.col("plan_id") % 5
    code = F.when(k == 0, "ibc_common").when(k == 1, "eurocode_style").when(k == 2, "storage_warehouse").when(k == 3, "none").otherwise("unknown")
    own = v.plans.select("plan_id", (1.3 + F.col("plan_id") % 7).cast("double").alias("corridor_width"), F.lit(50.0).alias("egress_limit"), (F.col("plan_id") % 2 == 0).alias("require_elevators"), F.lit(2).alias("accessible_entrances"))
    return catalogs.with_preset(own, code)


@query("P32_arrow_positions", "with c as (select corridor_id, w >= h as flat, x, y, w, h, greatest(w, h) as len from corridors), n as (select *, greatest(1, len // 200) as k from c) select corridor_id, i, round(case when flat then x + len * (i + 0.5) / k else x + w / 2.0 end, 4) as ax, round(case when flat then y + h / 2.0 else y + len * (i + 0.5) / k end, 4) as ay from (select *, unnest(range(k)) as i from n) t")
def p32(v):
    """Arrows every two metres, evenly along the centreline."""
    c = v.corridors.withColumn("len", F.greatest("w", "h")).withColumn("flat", F.col("w") >= F.col("h")).withColumn("k", F.greatest(F.lit(1).cast("long"), F.floor(F.col("len") / 200)))
    c = c.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    along = F.col("len") * (F.col("i") + 0.5) / F.col("k")
    return c.select("corridor_id", "i", F.round(F.when(F.col("flat"), F.col("x") + along).otherwise(F.col("x") + F.col("w") / 2), 4).alias("ax"), F.round(F.when(F.col("flat"), F.col("y") + F.col("h") / 2).otherwise(F.col("y") + along), 4).alias("ay"))


@query("P32_path_arrows", """with c as (select corridor_id, [{'x': x, 'y': y}, {'x': x + w, 'y': y}, {'x': x + w, 'y': y + h}, {'x': x + w, 'y': y + h}, {'x': x, 'y': y + 2 * h}] as p from corridors),
  s as (select corridor_id, unnest(range(1, 5)) as i, p from c), g as (select corridor_id, i, p[i].x as x1, p[i].y as y1, (p[i + 1].x - p[i].x)::double as dx, (p[i + 1].y - p[i].y)::double as dy from s), n as (select *, sqrt(dx * dx + dy * dy) as n from g where dx <> 0 or dy <> 0),
  u as (select *, sum(n) over (partition by corridor_id order by i rows unbounded preceding) as upto, sum(n) over (partition by corridor_id) as whole from n), a as (select *, least(200, whole * 0.6::double) as arrow from u), f as (select *, case when whole < 300 + arrow and whole > arrow then whole / 2 else 150 end as d0, whole < 300 + arrow as short from a),
  k as (select *, unnest(range(0, greatest(1, (whole / 300)::bigint + 2))) as arrow_no from f), d as (select *, d0 + arrow_no * 300 as d from k where not short or arrow_no = 0)
  select corridor_id, arrow_no as arrow, round(x1 + (d - upto + n) / n * dx, 4) as x, round(y1 + (d - upto + n) / n * dy, 4) as y, round(atan2(dy, dx), 6) as angle, round(whole, 4) as path_length from d where d < whole and d <= whole - arrow * 0.5 and d <= upto and (d > upto - n or (d = 0 and upto = n))""")
def p32_paths(v):
    """Arrows along bent centrelines, one of whose points repeats."""
    p = lambda x, y: F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"))
    lines = v.corridors.select("corridor_id", F.array(p("x", "y"), p("x + w", "y"), p("x + w", "y + h"), p("x + w", "y + h"), p("x", "y + 2 * h")).alias("points"))
    return path_arrows(lines, "corridor_id").withColumns({c: F.round(c, n) for c, n in (("x", 4), ("y", 4), ("angle", 6), ("path_length", 4))})


_TEXTS = """(select plan_id, zone_id as text_id, x + zone_id % 700 as x, y, case zone_id % 9 when 0 then 'RM-' || zone_id when 1 then 'ex' || zone_id % 10 when 2 then 'Loading bay' when 3 then (zone_id % 12) || '.5 m' when 4 then 'To exit' when 5 then (zone_id % 40)::varchar when 6 then 'Main access' when 7 then (zone_id % 26 + 1)::varchar else 'note' end as text from zones)"""


def _texts(v):
    k = F.col("zone_id") % 9
    said = F.when(k == 0, F.concat(F.lit("RM-"), "zone_id")).when(k == 1, F.concat(F.lit("ex"), F.col("zone_id") % 10)).when(k == 2, "Loading bay").when(k == 3, F.concat((F.col("zone_id") % 12).cast("string"), F.lit(".5 m")))
    said = said.when(k == 4, "To exit").when(k == 5, (F.col("zone_id") % 40).cast("string")).when(k == 6, "Main access").when(k == 7, (F.col("zone_id") % 26 + 1).cast("string")).otherwise("note")
    return v.zones.select("plan_id", F.col("zone_id").alias("text_id"), (F.col("x") + F.col("zone_id") % 700).alias("x"), "y", said.alias("text"))


@query("C17_label_kinds", f"""with t as (select * from {_TEXTS} u), n as (select plan_id, text_id, 'notice' as kind, text as label from t where regexp_matches(upper(text), 'ZERO LINE|ROOF THROUGH|EXIT AREA|TO EXIT') qualify row_number() over (partition by plan_id, text order by text_id) = 1)
  select plan_id, text_id, 'number' as kind, try_cast(text as int)::varchar as label from t where regexp_matches(text, '^[0-9]{{1,2}}$') and try_cast(text as int) between 1 and 26 union all select plan_id, text_id, 'room', text from t where regexp_matches(text, '^RM-[0-9]+$') union all select plan_id, text_id, 'green_zone', text from t where regexp_matches(text, '(?i)^Ex[0-9]+$')
  union all select plan_id, text_id, 'dimension', text from t where regexp_matches(text, '(?i)^[0-9]+([.][0-9]+)?\\s*m$') union all select * from n union all select plan_id, text_id, 'function', case when regexp_matches(upper(text), 'LOADING|BAY') then 'LOADING BAY' when regexp_matches(upper(text), 'MAIN.*ACCESS|ACCESS.*MAIN') then 'MAIN ACCESS' else 'EXIT DOOR' end from t where regexp_matches(upper(text), 'LOADING|BAY|MAIN.*ACCESS|ACCESS.*MAIN|EXIT|SORTIE')""")
def c17_kinds(v):
    return classify.text_labels(_texts(v)).select("plan_id", "text_id", "kind", "label")


@query("C17_room_numbers", f"""with t as (select * from {_TEXTS} u where regexp_matches(text, '^[0-9]{{1,2}}$') and try_cast(text as int) between 1 and 26), d as (select t.text_id, t.text, z.zone_id, pow(z.x + z.w / 2.0 - t.x, 2) + pow(z.y + z.h / 2.0 - t.y, 2) as d2 from t join zones z using (plan_id))
  select text_id, try_cast(text as int) as number, zone_id from d where d2 < 250000 qualify row_number() over (partition by text_id order by d2, zone_id) = 1""")
def c17_numbers(v):
    """A number belongs to the room whose centre is nearest, within 5 m."""
    t = spatial.points(classify.text_labels(_texts(v)).where("kind = 'number'"))
    rooms = spatial.points(v.zones.select("plan_id", "zone_id", (F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") / 2).alias("y")))
    pairs = spatial.within(t, rooms, ["plan_id"], 500)
    best = F.min(F.struct(geometry.gap_squared("a", "b").alias("d2"), F.col("b.zone_id").alias("zone_id")))
    return pairs.groupBy(F.col("a.text_id").alias("text_id"), F.col("a.label").cast("int").alias("number")).agg(best.alias("m")).select("text_id", "number", "m.zone_id")


@query("P33_building_report", "with f as (select building_id, plan_id, count(*) as n, sum(cast(w as bigint) * h) as area from boxes join plans using (plan_id) group by all) select building_id, '# Building ' || building_id || chr(10) || string_agg('- Plan ' || plan_id || ': ' || n || ' boxes, ' || area || ' cm2', chr(10) order by plan_id) as report from f group by building_id")
def p33(v):
    """A Markdown report for each building, a line for each plan in order."""
    f = v.boxes.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("w").cast("long") * F.col("h")).alias("area")).join(v.plans, "plan_id")
    line = F.concat(F.lit("- Plan "), "plan_id", F.lit(": "), "n", F.lit(" boxes, "), "area", F.lit(" cm2"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("plan_id", line.alias("line")))), lambda x: x["line"])
    return f.groupBy("building_id").agg(lines.alias("l")).select("building_id", F.concat(F.lit("# Building "), "building_id", F.lit("\n"), F.array_join("l", "\n")).alias("report"))


@query("P34_room_suitability", "select zone_id, case when p_size % 3 = 0 and w * h >= 100000 then 0.8 else 0.2 end as suitability, case when w * h / 40000 < 2 then 'single' when w * h / 40000 < 4 then 'double' when w * h / 40000 < 7 then 'team' else 'meeting' end as workspace from zones join part on p_partkey = zone_id")
def p34(v):
    area = F.col("w") * F.col("h")
    z = v.zones.join(v.raw("part").select(F.col("p_partkey").alias("zone_id"), "p_size"), "zone_id")
    seats = area / 40000
    return z.select("zone_id", F.when((F.col("p_size") % 3 == 0) & (area >= 100000), 0.8).otherwise(0.2).alias("suitability"), F.when(seats < 2, "single").when(seats < 4, "double").when(seats < 7, "team").otherwise("meeting").alias("workspace"))


@query("C7_usable_confidence", """with t as (select plan_id, sum(a) as taken, count(*) as n from (select plan_id, cast(w as bigint) * h as a from zones union all select plan_id, 10000 from connectors) x group by plan_id), e as (select plan_id, count(*) as n from exits group by plan_id), w as (select plan_id, count(*) as n from walls group by plan_id), u as (select plan_id, count(*) as n from entities where layer = 'Divers' and plan_id % 3 > 0 group by plan_id),
  j as (select p.plan_id, cast(greatest(0, cast(p.max_x - p.min_x as bigint) * (p.max_y - p.min_y) - coalesce(t.taken, 0)) as bigint) as usable, coalesce(t.n, 0) as t, coalesce(e.n, 0) as e, coalesce(w.n, 0) as w, coalesce(u.n, 0) as u from plans p left join t using (plan_id) left join e using (plan_id) left join w using (plan_id) left join u using (plan_id))
  select plan_id, usable, least(100, 50 + case when w > 0 then 20 else 0 end + case when e > 0 then 15 else 0 end + case when t > 0 then 10 else 0 end + case when usable > 0 then 5 else 0 end + case when u = 0 then 5 else 0 end) as confidence, concat_ws('; ', case when w = 0 then 'no walls' end, case when e = 0 then 'no exits' end, case when usable <= 0 then 'no usable area' end) as warnings from j""")
def c7(v):
    """Connectors (a square metre each) are obstacles; entities of the layer Divers are unknown, in two plans of three."""
    obstacles = v.connectors.select("plan_id", F.lit(100).alias("w"), F.lit(100).alias("h"))
    return catalogs.usable_area(v.plans, obstacles, v.zones, v.walls, v.exits, v.entities.where("layer = 'Divers' and plan_id % 3 > 0"))


_BOXES = ", ".join(f"({i}, '{n}', {', '.join(f'{x}::double' for x in t)})" for i, (n, t) in enumerate(catalogs.BOX_TEMPLATES.items()))
_UNITS = ", ".join(f"({i}, '{n}', {a}, {b})" for i, (n, (a, b)) in enumerate(catalogs.UNIT_TEMPLATES.items()))


@query("C13_box_template", f"""with t(ord, name, lo, hi, wlo, whi, dlo, dhi, door) as (values {_BOXES}), u(ord, name, lo, hi) as (values {_UNITS}), b as (select box_id, w * h * (1 + box_id % 3) / 10000.0::double as area from boxes)
  select box_id, (select arg_min(name, ord) from t where area between lo and hi) as box_template, coalesce((select arg_min(name, ord) from u where area between lo and hi), (select arg_min(name, least(abs(area - lo), abs(area - hi))) from u)) as unit_template from b""")
def c13(v):
    """Both catalogues: the first box template that holds the area or none, the first unit template or the nearest."""
    area = F.col("w") * F.col("h") * (1 + F.col("box_id") % 3) / 10000
    return v.boxes.select("box_id", catalogs.box_template(area).alias("box_template"), catalogs.unit_template(area).alias("unit_template"))


_RATIO = ", ".join(f"({i}, {r}::double)" for i, r in enumerate(catalogs.RATIOS))


@query("C14_box_dimensions", f"""with t(o, name, lo, hi, wlo, whi, dlo, dhi, door) as (values {_BOXES}), r(ord, ratio) as (values {_RATIO}), b as (select box_id, type as name, greatest(lo, least(hi, w * h / 10000.0::double)) as a, lo, hi, wlo, whi, dlo, dhi from boxes join t on t.name = type),
  s as (select *, floor(sqrt(a * ratio) / 0.1::double + 0.5) * 0.1::double as w1, floor(a / sqrt(a * ratio) / 0.1::double + 0.5) * 0.1::double as d1 from b cross join r),
  k as (select *, sqrt(floor(w1 * d1 / 0.5::double + 0.5) * 0.5::double / (w1 * d1)) as f from s where w1 between wlo and whi and d1 between dlo and dhi and w1 / d1 between 0.6::double * 0.8::double and 1.4::double * 1.2::double),
  m as (select *, floor(w1 * f / 0.1::double + 0.5) * 0.1::double as w2, floor(d1 * f / 0.1::double + 0.5) * 0.1::double as d2 from k),
  z as (select box_id, arg_min(struct_pack(w := w2, d := d2), ord) as p from m where w2 * d2 between lo * 0.8::double and hi * 1.2::double and w2 between wlo * 0.8::double and whi * 1.1::double and d2 between dlo * 0.8::double and dhi * 1.1::double group by box_id),
  y as (select b.*, z.p, least(a, whi * dhi * 0.9::double) as use from b left join z using (box_id)), x as (select *, greatest(wlo, least(whi, sqrt(use * 1.2::double))) as fw, greatest(dlo, least(dhi, use / sqrt(use * 1.2::double))) as fd from y),
  q as (select box_id, case when p is not null then p.w when fw * fd < use * 0.5 then least(whi, fw * 1.2::double) else fw end as width, case when p is not null then p.d when fw * fd < use * 0.5 then least(dhi, fd * 1.2::double) else fd end as depth from x)
  select box_id, round(greatest(0.5, width), 4) as width, round(greatest(0.5, depth), 4) as depth, round(width * depth, 4) as area from q""")
def c14(v):
    """Dimensions of boxes by their type's template, sides to 10 cm and areas to half a square metre."""
    d = catalogs.box_dimensions(v.boxes.withColumn("m2", F.col("w") * F.col("h") / 10000), "type", "m2", 0.1, 0.5)
    return d.select("box_id", F.round("width", 4).alias("width"), F.round("depth", 4).alias("depth"), F.round("box_area", 4).alias("area"))


@query("C17_text_labels", "with t as (select plan_id, zone_id, x, y, case zone_id % 5 when 0 then 'RM-' || zone_id when 1 then 'Ex' || zone_id % 10 when 2 then 'loading bay' when 3 then (w / 100.0)::double || ' m' else 'note' end as txt from zones) select plan_id, zone_id, case when regexp_matches(txt, '^RM-[0-9]+') then 'room' when regexp_matches(txt, '^Ex[0-9]+$') then 'exit' when regexp_matches(txt, '^[0-9.]+ ?m$') then 'dimension' when regexp_matches(lower(txt), 'loading|main access') then 'area' else 'notice' end as label, case when regexp_matches(txt, '^RM-[0-9]+') then cast(regexp_extract(txt, '([0-9]+)', 1) as bigint) else -1 end as room from t where zone_id % 5 <> 4")
def c17(v):
    """Labels of text entities: rooms with their number, exits, dimensions, areas, notices."""
    k = F.col("zone_id") % 5
    said = F.when(k == 0, F.concat(F.lit("RM-"), "zone_id")).when(k == 1, F.concat(F.lit("Ex"), F.col("zone_id") % 10)).when(k == 2, "loading bay").when(k == 3, F.concat((F.col("w") / 100.0).cast("double"), F.lit(" m"))).otherwise("note")
    t = v.zones.withColumn("said", said).where("zone_id % 5 <> 4")
    s = F.col("said")
    label = F.when(s.rlike("^RM-[0-9]+"), "room").when(s.rlike("^Ex[0-9]+$"), "exit").when(s.rlike("^[0-9.]+ ?m$"), "dimension").when(F.lower(s).rlike("loading|main access"), "area").otherwise("notice")
    return t.select("plan_id", "zone_id", label.alias("label"), F.when(s.rlike("^RM-[0-9]+"), F.regexp_extract(s, "([0-9]+)", 1).try_cast("long")).otherwise(-1).alias("room"))


_SEGMENT = "(select plan_id, wall_id, least(x1, x2) as x, least(y1, y2) as y, abs(x2 - x1) as w, abs(y2 - y1) as h from walls)"


def _segments(v):
    """Walls, which run along an axis, as rectangles without width."""
    return v.walls.select("plan_id", "wall_id", F.least("x1", "x2").alias("x"), F.least("y1", "y2").alias("y"), F.abs(F.col("x2") - F.col("x1")).alias("w"), F.abs(F.col("y2") - F.col("y1")).alias("h"))


@query("J8_corridor_crossings", f"select a.plan_id, a.corridor_id as h_id, b.corridor_id as v_id from corridors a join corridors b on a.plan_id = b.plan_id and a.w >= a.h and b.w < b.h and {_STRICT}")
def j8(v):
    """Horizontal corridors that cross vertical ones."""
    pairs = spatial.grid_join(v.corridors.where("w >= h"), v.corridors.where("w < h"), ["plan_id"], geometry.overlap("a", "b"))
    return pairs.select(F.col("a.plan_id").alias("plan_id"), F.col("a.corridor_id").alias("h_id"), F.col("b.corridor_id").alias("v_id"))


@query("J15_outer_boxes", f"select distinct a.plan_id, a.box_id from boxes a join boxes b on a.plan_id = b.plan_id and a.floor_level = b.floor_level and a.box_id <> b.box_id and {_TOUCH} and b.x + b.w / 2.0 between a.x and a.x + a.w and b.y + b.h / 2.0 between a.y and a.y + a.h and a.w * a.h >= b.w * b.h + 10000")
def j15(v):
    """Areas that hold another one's centre and are larger by a square metre: what a clean-up of nested zones drops."""
    c = lambda t, n: F.col(f"{t}.{n}")
    mid = lambda p, s: (c("b", p) + c("b", s) / 2).between(c("a", p), c("a", p) + c("a", s))
    test = geometry.overlap("a", "b", strict=False) & (c("a", "box_id") != c("b", "box_id")) & mid("x", "w") & mid("y", "h") & (c("a", "w") * c("a", "h") >= c("b", "w") * c("b", "h") + 10000)
    return spatial.grid_join(v.boxes, v.boxes, FLOOR, test).select(c("a", "plan_id").alias("plan_id"), c("a", "box_id").alias("box_id")).distinct()


@query("J18_boxes_in_envelope", "select box_id from boxes join plans using (plan_id) where (x + w / 2.0) / max_x + (y + h / 2.0) / max_y < 1.5 and x + w / 2.0 < max_x and y + h / 2.0 < max_y")
def j18(v):
    """Boxes whose centre is in the plan's envelope polygon (its rectangle with one corner cut off)."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    X, Y = F.col("max_x"), F.col("max_y")
    zero = F.lit(0)
    envelope = F.array(p(zero, zero), p(X, zero), p(X, Y / 2), p(X / 2, Y), p(zero, Y))
    b = v.boxes.join(v.plans.select("plan_id", envelope.alias("ring")), "plan_id")
    return b.where(geometry.inside(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, F.col("ring"))).select("box_id")


@query("J20_room_adjacency", f"select a.plan_id, a.zone_id, count(*) filter (b.kind = 'exit') as exits, count(*) filter (b.kind = 'corridor') as corridors from zones a join (select plan_id, 'exit' as kind, x, y, 0 as w, 0 as h from exits union all select plan_id, 'corridor', x, y, w, h from corridors) b on a.plan_id = b.plan_id and {_GAP2} < 10000 group by a.plan_id, a.zone_id")
def j20(v):
    """Exits and corridors within a metre of each zone."""
    other = spatial.points(v.exits).select("plan_id", F.lit("exit").alias("kind"), "x", "y", "w", "h").unionByName(v.corridors.select("plan_id", F.lit("corridor").alias("kind"), "x", "y", "w", "h"))
    pairs = spatial.within(v.zones, other, ["plan_id"], 100)
    n = lambda k: F.count(F.when(F.col("b.kind") == k, 1))
    return pairs.groupBy(F.col("a.plan_id").alias("plan_id"), F.col("a.zone_id").alias("zone_id")).agg(n("exit").alias("exits"), n("corridor").alias("corridors"))


@query("J21_corrected_classes", "select zone_id, case when zone_id % 10 = 0 then 'corrected' when w * h > 100000 then 'large' else 'small' end as class from zones")
def j21(v):
    """User corrections replace the class of the zone with the same centre."""
    key = [(2 * F.col("x") + F.col("w")).alias("cx"), (2 * F.col("y") + F.col("h")).alias("cy")]
    fixes = v.zones.where("zone_id % 10 = 0").select("plan_id", *key, F.lit("corrected").alias("own")).distinct()
    own = v.zones.select("plan_id", "zone_id", *key, F.when(F.col("w") * F.col("h") > 100000, "large").otherwise("small").alias("class"))
    return own.join(fixes, ["plan_id", "cx", "cy"], "left").select("zone_id", F.coalesce("own", "class").alias("class"))


@query("A24_numbering_stats", "select plan_id, count(*) as boxes, count(distinct type) as zones, count(distinct y // 300) as n_rows, string_agg(distinct type, ',' order by type) as zone_list from boxes group by plan_id")
def a24(v):
    return v.boxes.groupBy("plan_id").agg(F.count(F.lit(1)).alias("boxes"), F.countDistinct("type").alias("zones"), F.countDistinct(F.floor(F.col("y") / 300)).alias("n_rows"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("zone_list"))


@query("A26_junctions", """with f as (select plan_id, x, w, y + h / 2.0 as c from corridors where w >= h), u as (select plan_id, y, h, x + w / 2.0 as c from corridors where w < h), p as (select plan_id, x::double as px, c::double as py from f union all select plan_id, x + w, c from f union all select plan_id, c, y from u union all select plan_id, c, y + h from u
    union all select f.plan_id, u.c, f.c from f join u on f.plan_id = u.plan_id and u.c between f.x - 20 and f.x + f.w + 20 and f.c between u.y - 20 and u.y + u.h + 20)
  select plan_id, cast(floor(px / 20 + 0.5) as bigint) as kx, cast(floor(py / 20 + 0.5) as bigint) as ky, count(*) as degree, round(avg(px), 4) as x, round(avg(py), 4) as y, case when count(*) >= 4 then 'cross' when count(*) = 3 then 'T' else 'linear' end as kind from p group by 1, 2, 3 having count(*) >= 2""")
def a26(v):
    return catalogs.corridor_junctions(v.corridors).withColumns({"x": F.round("x", 4), "y": F.round("y", 4)})


@query("A29_zone_totals", "select plan_id, type as zone, cast(sum(cast(w as bigint) * h) as bigint) as area, round(avg(x + w / 2.0), 4) as cx, round(avg(y + h / 2.0), 4) as cy, type || ': ' || round(sum(cast(w as bigint) * h) / 10000)::bigint || ' m2' as label from boxes group by plan_id, type")
def a29(v):
    area = F.sum(F.col("w").cast("long") * F.col("h"))
    return v.boxes.groupBy("plan_id", F.col("type").alias("zone")).agg(area.alias("area"), F.round(F.avg(F.col("x") + F.col("w") / 2), 4).alias("cx"), F.round(F.avg(F.col("y") + F.col("h") / 2), 4).alias("cy")).withColumn("label", F.concat("zone", F.lit(": "), F.round(F.col("area") / 10000).cast("long"), F.lit(" m2")))


@query("A30_perimeter_walls", "with b as (select plan_id, min(least(x1, x2)) as ax, min(least(y1, y2)) as ay, max(greatest(x1, x2)) as bx, max(greatest(y1, y2)) as by_ from walls group by plan_id), s as (select w.plan_id, abs(x2 - x1) + abs(y2 - y1) as len, case when x1 = x2 and x1 - ax <= 150 then 'left' when x1 = x2 and bx - x1 <= 150 then 'right' when y1 = y2 and y1 - ay <= 150 then 'bottom' when y1 = y2 and by_ - y1 <= 150 then 'top' end as side from walls w join b using (plan_id)) select plan_id, side, count(*) as walls, cast(sum(len) as bigint) as length from s where side is not null group by all")
def a30(v):
    """Walls along the plan's bounds (1.5 m), by side."""
    b = v.walls.groupBy("plan_id").agg(F.min(F.least("x1", "x2")).alias("ax"), F.min(F.least("y1", "y2")).alias("ay"), F.max(F.greatest("x1", "x2")).alias("bx"), F.max(F.greatest("y1", "y2")).alias("by_"))
    up, flat = F.col("x1") == F.col("x2"), F.col("y1") == F.col("y2")
    side = F.when(up & (F.col("x1") - F.col("ax") <= 150), "left").when(up & (F.col("bx") - F.col("x1") <= 150), "right").when(flat & (F.col("y1") - F.col("ay") <= 150), "bottom").when(flat & (F.col("by_") - F.col("y1") <= 150), "top")
    w = v.walls.join(b, "plan_id").withColumn("side", side).where("side is not null")
    return w.groupBy("plan_id", "side").agg(F.count(F.lit(1)).alias("walls"), F.sum(F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))).alias("length"))


_BOUNDS = "(select plan_id, min(least(x1, x2)) as min_x, min(least(y1, y2)) as min_y, max(greatest(x1, x2)) as max_x, max(greatest(y1, y2)) as max_y from walls group by plan_id)"


def _wall_bounds(v):
    return v.walls.groupBy("plan_id").agg(F.min(F.least("x1", "x2")).alias("min_x"), F.min(F.least("y1", "y2")).alias("min_y"), F.max(F.greatest("x1", "x2")).alias("max_x"), F.max(F.greatest("y1", "y2")).alias("max_y"))


@query("A30_detected_perimeter", f"select plan_id, wall_id, side from (select w.plan_id, wall_id, case when abs(x1 - min_x) < 50 and abs(x2 - min_x) < 50 then 'left' when abs(x1 - max_x) < 50 and abs(x2 - max_x) < 50 then 'right' when abs(y1 - min_y) < 50 and abs(y2 - min_y) < 50 then 'bottom' when abs(y1 - max_y) < 50 and abs(y2 - max_y) < 50 then 'top' end as side from walls w join {_BOUNDS} b using (plan_id)) t where side is not null")
def a30_detected(v):
    """Walls within half a metre of the bounds of all walls."""
    return perimeter_walls(v.walls, _wall_bounds(v)).select("plan_id", "wall_id", "side")


_ENVELOPE = """(select plan_id, 0 as k, min_x as x1, min_y as y1, max_x as x2, min_y as y2 from plans union all select plan_id, 1, max_x, min_y, max_x, max_y + plan_id % 3 * 15 from plans union all select plan_id, 2, max_x, max_y, min_x, max_y from plans union all select plan_id, 3, min_x + plan_id % 2 * 40, max_y, min_x, min_y from plans union all select plan_id, 4, x1, y1, x2, y2 from walls where wall_id % 100 = 7)"""


@query("A30_synthetic_envelopes", f"select plan_id, count(*) as edges, count(*) filter (a) as aligned, count(*) between 4 and 8 and count(*) filter (a) >= 4 as synthetic from (select e.plan_id, (abs(x1 - min_x) <= 20 and abs(x2 - min_x) <= 20) or (abs(x1 - max_x) <= 20 and abs(x2 - max_x) <= 20) or (abs(y1 - min_y) <= 20 and abs(y2 - min_y) <= 20) or (abs(y1 - max_y) <= 20 and abs(y2 - max_y) <= 20) as a from {_ENVELOPE} e join plans using (plan_id)) t group by plan_id")
def a30_synthetic(v):
    """Four edges on or near the bounds, and some walls."""
    edge = lambda x1, y1, x2, y2: F.struct(*(F.expr(c).cast("long").alias(n) for c, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"), strict=True)))
    four = F.array(edge("min_x", "min_y", "max_x", "min_y"), edge("max_x", "min_y", "max_x", "max_y + plan_id % 3 * 15"), edge("max_x", "max_y", "min_x", "max_y"), edge("min_x + plan_id % 2 * 40", "max_y", "min_x", "min_y"))
    e = v.plans.select("plan_id", F.inline(four)).unionByName(v.walls.where("wall_id % 100 = 7").select("plan_id", *(F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2"))))
    return synthetic_envelopes(e, v.plans)


@query("A13_pipeline_metrics", "with b as (select plan_id, count(*) as n, sum(cast(w as bigint) * h) as a from boxes group by plan_id), c as (select plan_id, sum(cast(w as bigint) * h) as a from corridors group by plan_id) select plan_id, b.n as boxes, round(b.a * 1.0 / (cast(max_x - min_x as bigint) * (max_y - min_y)), 6) as yield_ratio, round(c.a * 1.0 / b.a, 6) as circulation_ratio, round((b.a + c.a) * 1.0 / (cast(max_x - min_x as bigint) * (max_y - min_y)), 6) as efficiency from b join c using (plan_id) join plans using (plan_id)")
def a13(v):
    area = F.sum(F.col("w").cast("long") * F.col("h"))
    b = v.boxes.groupBy("plan_id").agg(F.count(F.lit(1)).alias("boxes"), area.alias("ba"))
    j = b.join(v.corridors.groupBy("plan_id").agg(area.alias("ca")), "plan_id").join(v.plan_areas, "plan_id")
    r = lambda c, n: F.round(c, 6).alias(n)
    return j.select("plan_id", "boxes", r(F.col("ba") / F.col("plan_area"), "yield_ratio"), r(F.col("ca") / F.col("ba"), "circulation_ratio"), r((F.col("ba") + F.col("ca")) / F.col("plan_area"), "efficiency"))


_ROW = "cast(floor((y + h / 2.0) / 400 + 0.5) as bigint)"


@query("W7_facing_rows", f"with r as (select plan_id, floor_level, {_ROW} as k, min(y) as y1, max(y + h) as y2, min(x) as x1, max(x + w) as x2 from boxes group by all) select a.plan_id, a.floor_level, a.k as row_a, b.k as row_b, b.y1 - a.y2 as distance, round((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * 1.0 / least(a.x2 - a.x1, b.x2 - b.x1), 6) as overlap from r a join r b on a.plan_id = b.plan_id and a.floor_level = b.floor_level and a.k < b.k and b.y1 - a.y2 between 150 and 800 and least(a.x2, b.x2) - greatest(a.x1, b.x1) >= 0.5 * least(a.x2 - a.x1, b.x2 - b.x1)")
def w7(v):
    """Rows that face each other across 1.5 to 8 m and overlap by half; a floor has few rows."""
    key = F.floor((F.col("y") + F.col("h") / 2.0) / 400 + 0.5).alias("k")
    r = v.boxes.groupBy(*FLOOR, key).agg(F.min("y").alias("y1"), F.max(F.col("y") + F.col("h")).alias("y2"), F.min("x").alias("x1"), F.max(F.col("x") + F.col("w")).alias("x2"))
    c = lambda t, n: F.col(f"{t}.{n}")
    common, least = F.least(c("a", "x2"), c("b", "x2")) - F.greatest(c("a", "x1"), c("b", "x1")), F.least(c("a", "x2") - c("a", "x1"), c("b", "x2") - c("b", "x1"))
    gap = c("b", "y1") - c("a", "y2")
    on = (c("a", "plan_id") == c("b", "plan_id")) & (c("a", "floor_level") == c("b", "floor_level")) & (c("a", "k") < c("b", "k")) & gap.between(150, 800) & (common >= 0.5 * least)
    return r.alias("a").join(r.alias("b"), on).select(c("a", "plan_id").alias("plan_id"), c("a", "floor_level").alias("floor_level"), c("a", "k").alias("row_a"), c("b", "k").alias("row_b"), gap.alias("distance"), F.round(common / least, 6).alias("overlap"))


@query("U2_distinct_points", "select distinct plan_id, round(x / 100.0, 4) as x, round(y / 100.0, 4) as y from (select plan_id, x1 as x, y1 as y from walls union all select plan_id, x2, y2 from walls) t")
def u2(v):
    ends = v.walls.select("plan_id", "x1", "y1").union(v.walls.select("plan_id", "x2", "y2")).toDF("plan_id", "x", "y")
    return ends.select("plan_id", F.round(F.col("x") / 100.0, 4).alias("x"), F.round(F.col("y") / 100.0, 4).alias("y")).dropDuplicates()


@query("U3_training_sets", "select 'walls' as origin, wall_id as id, layer, '' as area from walls union all select 'zones', zone_id, null, (w * h)::varchar from zones")
def u3(v):
    a = v.walls.select(F.lit("walls").alias("origin"), F.col("wall_id").alias("id"), "layer")
    return a.unionByName(v.zones.select(F.lit("zones").alias("origin"), F.col("zone_id").alias("id"), (F.col("w") * F.col("h")).cast("string").alias("area")), allowMissingColumns=True).fillna("", ["area"])
