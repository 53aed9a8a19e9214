"""Queries on rows and columns of boxes that an ordered scan forms, and on the spans between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from planfold.catalog import query
from planfold.operators import rows, spans
from planfold.plans.layout import _ISLANDS, FLOOR, _islands

_JOINS = "abs(2 * n.y + n.h - r.lo - r.hi) < 600"
_ROWS = f"""with recursive n as (select plan_id, floor_level, box_id, x, y, w, h, row_number() over (partition by plan_id, floor_level order by y, box_id) as k from boxes),
  r(plan_id, floor_level, k, row_id, lo, hi) as (select plan_id, floor_level, k, box_id, y, y + h from n where k = 1 union all
    select n.plan_id, n.floor_level, n.k, case when {_JOINS} then r.row_id else n.box_id end, case when {_JOINS} then r.lo else n.y end, case when {_JOINS} then greatest(r.hi, n.y + n.h) else n.y + n.h end
    from r join n on n.plan_id = r.plan_id and n.floor_level = r.floor_level and n.k = r.k + 1),
  m as (select plan_id, floor_level, row_id, count(*) as n, min(x) as min_x, max(x + w) as max_x, min(y) as min_y, max(y + h) as max_y, 1 / (1 + var_pop(y / 100.0)) as alignment,
    count(*) / greatest((max(x + w) - min(x)) / 100.0, pow(2.0, -52)) as density, row_number() over (partition by plan_id, floor_level order by min(y), row_id) - 1 as row_no from n join r using (plan_id, floor_level, k) group by plan_id, floor_level, row_id)"""
_PAIRS = """, t as (select a.plan_id, a.floor_level, a.row_no as row_a, b.row_no as row_b, a.n as n_a, b.n as n_b, a.max_y as low_y, b.min_y as high_y, a.alignment as la, b.alignment as lb, a.density as da, b.density as db,
    (abs(b.min_y + b.max_y - a.min_y - a.max_y) / 2.0 + greatest(0, b.min_y - a.max_y, a.min_y - b.max_y)) / 2.0 as distance, greatest(a.min_x, b.min_x) as overlap_start,
    greatest(0, least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x)) as overlap_width, greatest(a.max_x - a.min_x, b.max_x - b.min_x) as widest
    from m a join m b on a.plan_id = b.plan_id and a.floor_level = b.floor_level and a.row_no < b.row_no),
  f as (select *, overlap_width * 1.0 / widest as overlap_ratio, 0.35 * (1 - abs(distance - 475) / 475) + 0.35 * overlap_width / widest + 0.2 * (la + lb) / 2 + 0.1 * least(da, db) / greatest(da, db) as quality from t
    where distance between 150 and 800 and overlap_width >= 0.5 * widest)"""


def _rows(v):
    return rows.row_metrics(rows.running_rows(v.boxes))


@query("W5_running_rows", _ROWS + " select plan_id, floor_level, row_no, n, min_x, max_x, min_y, max_y from m")
def w5_running(v):
    return _rows(v).select(*FLOOR, "row_no", "n", "min_x", "max_x", "min_y", "max_y")


@query("W6_running_row_metrics", _ROWS + " select plan_id, floor_level, row_no, round(density, 6) as density, round(alignment, 6) as alignment from m")
def w6_running(v):
    return _rows(v).select(*FLOOR, "row_no", F.round("density", 6).alias("density"), F.round("alignment", 6).alias("alignment"))


@query("W7_facing_pairs", _ROWS + _PAIRS + " select plan_id, floor_level, row_a, row_b, distance, overlap_start, overlap_width, round(overlap_ratio, 6) as overlap_ratio, round(quality, 6) as quality from f")
def w7_pairs(v):
    p = rows.facing_pairs(_rows(v))
    return p.select(*FLOOR, "row_a", "row_b", "distance", "overlap_start", "overlap_width", F.round("overlap_ratio", 6).alias("overlap_ratio"), F.round("quality", 6).alias("quality"))


@query("W7_facing_statistics", _ROWS + _PAIRS + """, p as (select plan_id, floor_level, count(*) as pairs, sum(n_a + n_b) as facing_boxes, avg(quality) as q from f group by all) select plan_id, floor_level, cast(sum(n) as bigint) as boxes, count(*) as rows, coalesce(any_value(pairs), 0) as pairs,
  cast(coalesce(any_value(facing_boxes), 0) as bigint) as facing_boxes, round(coalesce(any_value(facing_boxes), 0) * 1.0 / sum(n), 6) as facing_coverage, round(sum(n) * 1.0 / count(*), 6) as mean_row_size, round(coalesce(any_value(q), 0), 6) as mean_quality from m left join p using (plan_id, floor_level) group by plan_id, floor_level""")
def w7_statistics(v):
    from planfold.operators.graph import cut

    r = cut(_rows(v))
    s = rows.facing_statistics(r, rows.facing_pairs(r))
    return s.select(*FLOOR, "boxes", "rows", "pairs", "facing_boxes", *(F.round(c, 6).alias(c) for c in ("facing_coverage", "mean_row_size", "mean_quality")))


@query("W7_recommended_corridors", _ROWS + _PAIRS + """, g as (select *, high_y - low_y as gap, least(150, high_y - low_y) as height from f where row_b = row_a + 1 and high_y - low_y >= 30)
  select plan_id, floor_level, row_a, row_b, overlap_start as x, low_y + (gap - height) / 2.0 as y, overlap_width as width, height::double as height, overlap_width * height::double as area, distance, round(least(1, greatest(0, quality)), 6) as priority from g""")
def w7_recommended(v):
    return rows.recommended_corridors(_rows(v)).withColumn("priority", F.round("priority", 6))


_ANCHORS = """with recursive d as (select plan_id, floor_level, x, row_number() over (partition by plan_id, floor_level order by x) as k from (select distinct plan_id, floor_level, x from boxes) t),
  r(plan_id, floor_level, k, x, anchor) as (select plan_id, floor_level, k, x, x from d where k = 1 union all select d.plan_id, d.floor_level, d.k, d.x, case when d.x >= r.anchor + 50 then d.x else r.anchor end from r join d on d.plan_id = r.plan_id and d.floor_level = r.floor_level and d.k = r.k + 1),
  c as (select b.plan_id, b.floor_level, r.anchor, b.box_id, b.y, b.h, lead(b.box_id) over w as next_id, lead(b.y) over w as ny, min(b.x) over (partition by b.plan_id, b.floor_level, r.anchor) as lo, max(b.x + b.w) over (partition by b.plan_id, b.floor_level, r.anchor) as hi
    from boxes b join r on r.plan_id = b.plan_id and r.floor_level = b.floor_level and r.x = b.x window w as (partition by b.plan_id, b.floor_level, r.anchor order by b.y, b.box_id))"""


@query("W4_tolerance_columns", _ANCHORS + " select plan_id, floor_level, anchor, box_id, next_id, lo as x, y + h + 20 as y, hi - lo as w, 120 as h from c where ny - y - h >= 140")
def w4_tolerance(v):
    return rows.column_corridors(v.boxes)


_COMMON = "case when g.a is not null then greatest(0, least(g.b, e.x + e.w) - greatest(g.a, e.x)) end"


@query("W8_edge_cover", _ISLANDS + f""" select e.plan_id, cast(e.y // 500 as bigint) as band, e.box_id, coalesce(bool_or(g.a <= e.x - 0.1 and g.b >= e.x + e.w + 0.1), false) as covered, round(coalesce(sum({_COMMON}), 0) * 1.0 / max(e.w), 6) as ratio, coalesce(sum({_COMMON}), 0) >= 0.3 * max(e.w) or max(e.w) < 10 as partly
  from boxes e left join g on g.plan_id = e.plan_id and g.band = e.y // 500 and g.a <= e.x + e.w and g.b >= e.x group by e.plan_id, e.y // 500, e.box_id""")
def w8_cover(v):
    """Do the merged corridors of its band of 5 m cover a box along x?"""
    edges = v.boxes.select("plan_id", F.floor(F.col("y") / 500).alias("band"), "box_id", F.col("x").alias("lo"), (F.col("x") + F.col("w")).alias("hi"))
    s = _islands(v).select("plan_id", "band", F.col("a").alias("lo"), F.col("b").alias("hi"))
    return spans.coverage(edges, s, ["plan_id", "band"], "box_id").withColumn("ratio", F.round("ratio", 6))


_NEAR_LINE = "abs(r.total - n.c * r.n) <= 20 * r.n"


@query("W8_level_walls", f"""with recursive n as (select *, row_number() over (partition by plan_id, flat order by c, wall_id) as k from (select plan_id, wall_id, y1 = y2 as flat, case when y1 = y2 then y1 else x1 end as c, case when y1 = y2 then least(x1, x2) else least(y1, y2) end as lo, case when y1 = y2 then greatest(x1, x2) else greatest(y1, y2) end as hi from walls where x1 = x2 or y1 = y2) t),
  r(plan_id, flat, k, line, total, n) as (select plan_id, flat, k, wall_id, c, 1 from n where k = 1 union all select n.plan_id, n.flat, n.k, case when {_NEAR_LINE} then r.line else n.wall_id end, case when {_NEAR_LINE} then r.total + n.c else n.c end, case when {_NEAR_LINE} then r.n + 1 else 1 end from r join n on n.plan_id = r.plan_id and n.flat = r.flat and n.k = r.k + 1),
  g as (select n.*, r.line from n join r using (plan_id, flat, k)), m as (select plan_id, flat, line, avg(c) as c from g group by all),
  s as (select *, max(hi) over (partition by plan_id, flat, line order by lo, hi rows between unbounded preceding and 1 preceding) as seen from g), i as (select *, sum(case when seen is null or lo > seen + 25 then 1 else 0 end) over (partition by plan_id, flat, line order by lo, hi rows unbounded preceding) as island from s)
  select plan_id, flat, round(any_value(m.c), 6) as c, min(lo) as lo, max(hi) as hi from i join m using (plan_id, flat, line) group by plan_id, flat, line, island having max(hi) - min(lo) >= 50""")
def w8_level(v):
    return spans.level_walls(v.walls).withColumn("c", F.round("c", 6))


@query("W8_collinear_runs")
def w8_runs(v):
    """Walls, every third turned by a slope, merged along their lines."""
    return spans.collinear_runs(v.walls.withColumn("y2", F.col("y2") + F.when(F.col("wall_id") % 3 == 0, F.floor((F.col("x2") - F.col("x1")) / 4)).otherwise(0)))


def _free(keys: str, least: str, gap: str) -> str:
    """CTEs after d(keys, lo, hi) and b(keys, lo, hi): what is free, as q(..., lo2, hi2)."""
    return f"""ins as (select {keys}, greatest(b.lo, d.lo) as lo, least(b.hi, d.hi) as hi from b join d using ({keys}) where least(b.hi, d.hi) > greatest(b.lo, d.lo)),
  seen as (select *, max(hi) over (partition by {keys} order by lo, hi rows between unbounded preceding and 1 preceding) as seen from ins), isl as (select *, sum(case when seen is null or lo > seen + {gap} then 1 else 0 end) over (partition by {keys} order by lo, hi rows unbounded preceding) as island from seen),
  k as (select {keys}, min(lo) as lo, max(hi) as hi from isl group by {keys}, island), sp as (select {keys}, lag(hi) over (partition by {keys} order by lo) as sa, lo as sb from k union all select {keys}, max(hi), null from k group by {keys}),
  q as (select d.*, coalesce(sa, lo) as lo2, coalesce(sb, hi) as hi2 from d left join sp using ({keys}) where (sa is null and sb is null) or coalesce(sb, hi) - coalesce(sa, lo) {least})"""


_AISLE = """with st as (select plan_id, min_x, max_x, min_y, (max_y - min_y)::double as high, floor((max_y - min_y) / 390.0)::bigint as n from plans), dd as (select *, high / n as each, unnest(range(n)) as aisle from st),
  d as (select plan_id, aisle, min_y + aisle * each + 160 * each / 390 as y, 70 * each / 390 as h, min_y + aisle * each as below_y, 160 * each / 390 as row_h, min_x::double as lo, max_x::double as hi from dd),
  bl as (select plan_id, true as wall, least(x1, x2) as bx1, greatest(x1, x2) as bx2, least(y1, y2) as by1, greatest(y1, y2) as by2 from walls union all select plan_id, false, x, x + w, y, y + h from zones union all select plan_id, false, x, x + 100, y, y + 100 from exits),
  b as (select d.plan_id, d.aisle, bx1 - 5 as lo, bx2 + 5 as hi from bl join d on d.plan_id = bl.plan_id and by2 >= d.y and by1 <= d.y + d.h where case when not wall then bx2 >= d.lo and bx1 <= d.hi when bx2 - bx1 > 2 * (by2 - by1) then not (abs((by1 + by2) / 2.0 - d.y - d.h) < 30 or abs((by1 + by2) / 2.0 - d.y) < 30)
    else not (abs((bx1 + bx2) / 2.0 - d.lo) < 50 or abs((bx1 + bx2) / 2.0 - d.hi) < 50) end), """


@query("W9_aisle_shadows", _AISLE + _free("plan_id, aisle", "> 35", "1") + " select plan_id, aisle, round(y, 4) as y, round(h, 4) as h, round(below_y, 4) as below_y, round(y + h, 4) as above_y, round(row_h, 4) as row_h, round(lo2, 4) as lo, round(hi2, 4) as hi from q where hi2 - lo2 >= 140")
def w9_shadows(v):
    """Zones and a metre about each exit are obstacles."""
    exits = v.exits.select("plan_id", "x", "y", F.lit(100).alias("w"), F.lit(100).alias("h"))
    s = spans.aisle_shadows(v.plans, v.walls, v.zones.select("plan_id", "x", "y", "w", "h").unionByName(exits))
    return s.select("plan_id", "aisle", *(F.round(c, 4).alias(c) for c in ("y", "h", "below_y", "above_y", "row_h", "lo", "hi")))


_SPLIT = f"""with d as (select plan_id, corridor_id, x, y, w, h, w >= h as flat, case when w >= h then y + h / 2.0 else x + w / 2.0 end as line, (case when w >= h then x else y end)::double as lo, (case when w >= h then x + w else y + h end)::double as hi from corridors),
  b as (select corridor_id, case when flat and y1 = y2 then least(x1, x2) - 4.5 when flat then x1 + (x2 - x1) * (line - y1) / (y2 - y1) - 4.5 when x1 = x2 then least(y1, y2) - 4.5 else y1 + (y2 - y1) * (line - x1) / (x2 - x1) - 4.5 end as lo,
    case when flat and y1 = y2 then greatest(x1, x2) + 4.5 when flat then x1 + (x2 - x1) * (line - y1) / (y2 - y1) + 4.5 when x1 = x2 then greatest(y1, y2) + 4.5 else y1 + (y2 - y1) * (line - x1) / (x2 - x1) + 4.5 end as hi
    from d join walls using (plan_id) where case when flat and y1 = y2 then abs(y1 - line) <= 4.5 when flat then line between least(y1, y2) and greatest(y1, y2) when x1 = x2 then abs(x1 - line) <= 4.5 else line between least(x1, x2) and greatest(x1, x2) end), """


@query("W9_split_corridors", _SPLIT + _free("corridor_id", ">= 90", "0.0001") + """ select plan_id, corridor_id, row_number() over (partition by corridor_id order by lo2) as part, round(case when flat then lo2 else x end, 4) as x, round(case when flat then y else lo2 end, 4) as y, round(case when flat then hi2 - lo2 else w end, 4) as w, round(case when flat then h else hi2 - lo2 end, 4) as h from q""")
def w9_split(v):
    parts = spans.split_corridors(v.corridors, v.walls)
    return parts.select("plan_id", "corridor_id", "part", *(F.round(c, 4).alias(c) for c in "xywh"))
