"""Queries on the scores of placed layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from planfold.catalog import query
from planfold.operators import scores
from planfold.plans.layout import _GAP2, _NEAR, _STRICT, _TOUCH, FLOOR


def _band(x: str, low: float, high: float, fall: float) -> str:
    return f"case when {x} between {low} and {high} then 1.0 when {x} < {low} then greatest(0, {x} / {low}) else greatest(0, 1 - ({x} - {high}) / {fall}) end"


_FIT = f"""with g as (select a.plan_id, a.floor_level, avg(sqrt({_GAP2}) / 100) as gap from boxes a join boxes b on a.plan_id = b.plan_id and a.floor_level = b.floor_level and a.box_id < b.box_id and {_GAP2} < 1000000 and {_GAP2} > 0 group by all),
  v1 as (select a.plan_id, a.floor_level, count(*) as n from boxes a join boxes b on a.plan_id = b.plan_id and a.floor_level = b.floor_level and a.box_id < b.box_id and {_TOUCH} group by all),
  v2 as (select a.plan_id, a.floor_level, count(*) as n from boxes a join (select plan_id, x, y, w, h from zones union all select plan_id, x, y, 100, 100 from exits) b on a.plan_id = b.plan_id and {_TOUCH} group by all),
  b as (select plan_id, floor_level, sum(w * h / 10000.0::double) as area, any_value((max_x - min_x)::double * (max_y - min_y) / 10000) as floor, avg(distance / 100) as d, avg(case when (x % 50 < 10 or x % 50 > 40) and (y % 50 < 10 or y % 50 > 40) then 1.0 else 0 end) as straight, avg(w * h / 10000.0::double) as mean, stddev_pop(w * h / 10000.0::double) as sd,
    count(*) filter (x < min_x or x + w > max_x or y < min_y or y + h > max_y) as v3 from {_NEAR} t join plans using (plan_id) group by all),
  p as (select b.plan_id, b.floor_level, {_band('area / floor', 0.6, 0.75, 0.25)} as utilization, {_band('coalesce(gap, 0)', 1.5, 2.5, 5)} as circulation, case when d is null then 1.0 else {_band('d', 5, 15, 30)} end as accessibility, 0.5 * straight + 0.5 * greatest(0, 1 - sd / mean) as aesthetics, greatest(0, 1 - (coalesce(v1.n, 0) + coalesce(v2.n, 0) + v3) / 10.0) as constraints
    from b left join g using (plan_id, floor_level) left join v1 using (plan_id, floor_level) left join v2 using (plan_id, floor_level))
  select plan_id, floor_level, round(utilization, 6) as utilization, round(circulation, 6) as circulation, round(accessibility, 6) as accessibility, round(aesthetics, 6) as aesthetics, round(constraints, 6) as constraints, round(0.30 * utilization + 0.25 * circulation + 0.20 * accessibility + 0.15 * aesthetics + 0.10 * constraints, 6) as total from p"""


def _near(df, keys):
    return df.select(*keys, *(F.round(c, 6).alias(c) for c in df.columns if c not in keys))


@query("A22_search_fitness", _FIT)
def a22_fitness(v):
    return _near(scores.fitness(v.plans, v.boxes, v.zones, v.exits), FLOOR)


_PLACED = f"""with bad as (select distinct a.box_id from boxes a join zones b on a.plan_id = b.plan_id and {_STRICT}),
  nn as (select a.box_id, sqrt(min(pow(a.x + a.w / 2.0 - b.x - b.w / 2.0, 2) + pow(a.y + a.h / 2.0 - b.y - b.h / 2.0, 2))) / 100 as apart from boxes a join boxes b on a.plan_id = b.plan_id and a.floor_level = b.floor_level and a.box_id <> b.box_id group by a.box_id),
  g as (select plan_id, floor_level, sum(w * h / 10000.0::double) as area, any_value((max_x - min_x)::double * (max_y - min_y) / 10000) as floor, avg(case when distance is null then 50.0 else greatest(0, 100 - distance / 100) end) as accessibility, avg(apart) as apart, avg(w * h / 10000.0::double) as mean,
    avg(case when x >= min_x and x + w <= max_x and y >= min_y and y + h <= max_y and bad.box_id is null then 1.0 else 0 end) * 100 as validity from {_NEAR} t join plans using (plan_id) left join bad using (box_id) left join nn using (box_id) group by all),
  s as (select plan_id, floor_level, least(1, area / floor) * 100 as density, accessibility, case when apart is null then 100 else greatest(0, 100 - 2 * abs(apart - 2 * sqrt(mean))) end as distribution, validity from g)
  select plan_id, floor_level, round(density, 6) as density, round(accessibility, 6) as accessibility, round(distribution, 6) as distribution, round(validity, 6) as validity, round(0.3 * density + 0.3 * accessibility + 0.2 * distribution + 0.2 * validity, 6) as total from s"""


@query("A22_placement_score", _PLACED)
def a22_placement(v):
    return _near(scores.placement_score(v.plans, v.boxes, v.zones, v.exits), FLOOR)


_SAMPLES = f"""with b as (select plan_id, count(*) as nb, sum(w * h / 10000.0::double) as ab, avg(distance / 100) as d, var_pop((x + w / 2.0::double) / 100) + var_pop((y + h / 2.0::double) / 100) as var, avg(least(least((x + w / 2.0::double) / 100, (y + h / 2.0::double) / 100) / 20, 1.0)) as edges from {_NEAR} t group by plan_id),
  c as (select plan_id, count(*) as nc, sum(w * h / 10000.0::double) as ac from corridors group by plan_id), r as (select plan_id, count(*) as nr from zones group by plan_id),
  j as (select p.plan_id, (max_x - min_x) / 100.0::double * ((max_y - min_y) / 100.0::double) as floor, (max_x - min_x)::double / (max_y - min_y) as aspect, coalesce(nb, 0) as nb, coalesce(ab, 0) as ab, coalesce(nc, 0) as nc, coalesce(ac, 0) as ac, coalesce(nr, 0) as nr, d, var, coalesce(edges, 0) as edges from plans p left join b using (plan_id) left join c using (plan_id) left join r using (plan_id))
  select plan_id, round(greatest(0, least(1, 0.30 * greatest(0, 1 - abs(ab / floor - 0.6) / 0.4) + 0.25 * greatest(0, 1 - abs(coalesce(d, 0) - 10) / 15) + 0.25 * greatest(0, 1 - abs(ac / floor - 0.15) / 0.15) + 0.10 * least(1, nb / 30.0) + 0.10 * least(1, nc / 5.0))), 6) as quality,
    round(case when nb < 2 then 0.5 else greatest(0, 1 - sqrt(var) / 50) end, 6) as spread, round(edges, 6) as edges, round({_band('((ab + ac) / floor)', 0.6, 0.8, 0.2)}, 6) as efficiency, round(case when nr > 0 then least(1, floor / (nr * 20)) else 1 end * 0.4 + (1 - abs(aspect - 1)) * 0.3 + least(1, nr / 15.0) * 0.3, 6) as layout from j"""


@query("A22_sample_scores", _SAMPLES)
def a22_samples(v):
    return _near(scores.sample_scores(v.plans, v.boxes, v.corridors, v.exits, v.zones), ["plan_id"])
