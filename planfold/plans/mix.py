"""Unit-mix queries: lines, targets against placed boxes, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planfold.catalog import query
from planfold.functions import text
from planfold.operators import mix

_NUM = "try_cast(regexp_extract(regexp_replace(trim({}), '^([^,]*),', '\\1.'), '^([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+))', 1) as double)"
_LINES = f"""with l as (
  select *, trim(coalesce(nullif(trim(typologie), ''), nullif(trim(surface_cible), ''))) as name, {_NUM.format("coalesce(surface_cible, '')")} as target,
    replace(coalesce(nullif(trim(tolerance), ''), '0'), ',', '.') as tol from mix_lines),
m as (select *, {_NUM.format("replace(tol, '%', '')")} as said from l),
n as (select *, case when tol like '%\\%%' escape '\\' then coalesce(target * said / 100, 0) else said end as share from m),
o as (select *, case when share is null or share < 0 then target * 0.1 else share end as allowed,
  regexp_matches(lower(coalesce(priorite, 'souhaitable')), 'oblig|required|mandatory') as required,
  case when name is null then 'missing name' when coalesce(target <= 0, true) then concat('invalid surface ', coalesce(surface_cible, '')) end as error from n)
"""  # fmt: skip


@query("S2_mix_lines", _LINES + "select plan_id, line_no, name, round(target, 4) as target, round(allowed, 4) as allowed, round(greatest(0, target - allowed), 4) as min_area, round(target + allowed, 4) as max_area, required from o where error is null")
def s2_lines(v):
    r = lambda c: F.round(c, 4).alias(c)
    return mix.read_lines(v.mix_lines).where("error is null").select("plan_id", "line_no", "name", r("target"), r("allowed"), r("min_area"), r("max_area"), "required")


@query("S2_mix_rejects", _LINES + "select plan_id, line_no + 1 as line_no, error from o where error is not null")
def s2_rejects(v):
    return mix.read_lines(v.mix_lines).where("error is not null").select("plan_id", (F.col("line_no") + 1).alias("line_no"), "error")


@query("S2_mix_totals", _LINES + """, u as (select plan_id, count(*) as n, sum(cast(floor(target * 10000 + 0.5) as bigint)) as t, sum(cast(floor(allowed * 10000 + 0.5) as bigint)) as a from o where error is null group by plan_id)
  select plan_id, n as n_types, t / 10000.0 as target, a / 10000.0 as allowed, (t - a) / 10000.0 as min_area, (t + a) / 10000.0 as max_area from u""")
def s2_totals(v):
    """Sums in whole square centimetres, so the order of rows doesn't show."""
    units = lambda c: F.sum(F.floor(F.col(c) * 10000 + 0.5))
    good = mix.read_lines(v.mix_lines).where("error is null").groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_types"), units("target").alias("t"), units("allowed").alias("a"))
    return good.selectExpr("plan_id", "n_types", "cast(t / 10000D as double) as target", "a / 10000D as allowed", "(t - a) / 10000D as min_area", "(t + a) / 10000D as max_area")


@query("S3_mix_errors", f"""with r as (select plan_id, line_no, coalesce(typologie, '') as type, case when line_no % 2 = 0 then surface_cible end as area, case when plan_id % 3 = 0 then surface_cible end as count from mix_lines),
  s as (select *, {_NUM.format('area')} as a, try_cast(nullif(regexp_extract(count, '^\\s*([+-]?\\d+)', 1), '') as int) as c from r),
  t as (select *, coalesce(area <> '', false) as ga, coalesce(count <> '', false) as gc from s)
  select plan_id, line_no, concat_ws('; ', case when type = '' then 'missing type' end, case when ga and not coalesce(a > 0, false) then 'invalid area' end, case when gc and not coalesce(c >= 0, false) then 'invalid count' end,
    case when not (ga and coalesce(a > 0, false)) and not (gc and coalesce(c > 0, false)) then 'needs area or count' end) as errors from t
  where type = '' or (ga and not coalesce(a > 0, false)) or (gc and not coalesce(c >= 0, false)) or (not (ga and coalesce(a > 0, false)) and not (gc and coalesce(c > 0, false)))""")
def s3_errors(v):
    rows = v.mix_lines.selectExpr("plan_id", "line_no", "coalesce(typologie, '') as type", "case when line_no % 2 = 0 then surface_cible end as area", "case when plan_id % 3 = 0 then surface_cible end as count")
    return mix.line_errors(rows).where(F.size("errors") > 0).select("plan_id", "line_no", F.array_join("errors", "; ").alias("errors"))


@query("P2_base_type", "select p_partkey as part_id, case when regexp_extract(trim(p_type), '^([A-Za-z0-9]+)', 1) <> '' then regexp_extract(trim(p_type), '^([A-Za-z0-9]+)', 1) else nullif(trim(p_type), '') end as base from part")
def p2(v):
    return v.raw("part").select(F.col("p_partkey").alias("part_id"), text.base_type(F.col("p_type")).alias("base"))


@query("P3_tolerance", "select plan_id, type, case when tolerance like '%\\%%' escape '\\' then 'percentage' else 'absolute' end as kind, case when tolerance like '%\\%%' escape '\\' then target_area_cm2 * cast(replace(tolerance, '%', '') as double) / 100 else cast(tolerance as double) end as allowed from unit_mix")
def p3(v):
    t = v.unit_mix.withColumn("t", text.tolerance(F.col("tolerance")))
    return t.select("plan_id", "type", F.col("t.kind").alias("kind"), text.allowed(F.col("t"), F.col("target_area_cm2")).alias("allowed"))


_MID = "case upper(trim(size_range)) when 'S' then 1.0 when 'M' then 3.5 when 'L' then 7.5 when 'XL' then 12.0 else (try_cast(regexp_extract(trim(size_range), '^(-?\\d+(?:\\.\\d+)?)\\s*-\\s*(-?\\d+(?:\\.\\d+)?)$', 1) as double) + try_cast(regexp_extract(trim(size_range), '^(-?\\d+(?:\\.\\d+)?)\\s*-\\s*(-?\\d+(?:\\.\\d+)?)$', 2) as double)) / 2 end"


@query("P4_range_midpoint", f"select distinct size_range, cast({_MID} as double) as midpoint from distributions")
def p4(v):
    return v.distributions.select("size_range", text.range_midpoint(F.col("size_range")).alias("midpoint")).distinct()


@query("P5_distribution", "with d as (select *, case when weight > 1.01 then weight / 100.0 else weight end as w from distributions) select plan_id, size_range, round(cast(w / sum(w) over (partition by plan_id) as double), 6) as share from d")
def p5(v):
    return mix.normalised_distribution(v.distributions).select("plan_id", "size_range", F.round("share", 6).alias("share"))


@query("P6_bucketed_distribution", f"""with d as (select plan_id, cast(case when weight > 1.01 then weight / 100.0 else weight end as double) as w, cast({_MID} as double) as mid from distributions),
  s as (select plan_id, sum(w) as t, sum(case when mid <= 2 then w else 0 end) as s, sum(case when mid > 2 and mid <= 5 then w else 0 end) as m, sum(case when mid > 5 and mid <= 10 then w else 0 end) as l, sum(case when mid > 10 then w else 0 end) as xl from d where mid is not null group by plan_id)
  select plan_id, floor(s / t * 10000 + 0.5) / 100 as s, floor(m / t * 10000 + 0.5) / 100 as m, floor(l / t * 10000 + 0.5) / 100 as l, floor(xl / t * 10000 + 0.5) / 100 as xl from s""")
def p6(v):
    return mix.bucketed_distribution(v.distributions)


_SIZES = ", ".join(f"({float(s)})" for s in text.UNIT_SIZES)


@query("P7_unit_size", f"""with b as (select box_id, w * h / 10000.0 as area from boxes), n as (select b.box_id, arg_min(s, abs(area - s) * 1000 + s / 1000000) as nearest, any_value(area) as area from b cross join (values {_SIZES}) as u(s) group by b.box_id),
  z as (select box_id, case when area <= 0 then 0.5 when area > 25 then floor(area * 2 + 0.5) / 2 else nearest end as size_label from n)
  select box_id, cast(size_label as double) as size_label, case when size_label <= 1 then 'A' when size_label <= 2 then 'B' when size_label <= 5 then 'C' when size_label <= 10 then 'D' when size_label <= 15 then 'E' else 'F' end as size_group from z""")
def p7(v):
    sized = v.boxes.select("box_id", text.unit_size(F.col("w") * F.col("h") / 10000.0).alias("size_label"))
    return sized.withColumn("size_group", text.size_group(F.col("size_label")))


_ACTUAL = "act as (select plan_id, type, sum(cast(w as bigint) * h) as area, count(*) as n from boxes group by plan_id, type)"
_VAR = f"""with {_ACTUAL}, j as (select m.plan_id, m.type, m.ord, m.priority, m.target_area_cm2 as target, coalesce(a.area, 0) as actual, coalesce(a.n, 0) as actual_count,
    case when tolerance like '%\\%%' escape '\\' then m.target_area_cm2 * cast(replace(tolerance, '%', '') as double) / 100 else cast(tolerance as double) end as allowed
  from unit_mix m left join act a on a.plan_id = m.plan_id and a.type = m.type), k as (select *, actual - target as deviation from j)
"""  # fmt: skip


def _variance(v):
    m = v.unit_mix.withColumnRenamed("target_area_cm2", "target_area")
    return mix.against_targets(m, v.boxes).withColumn("allowed", text.allowed(F.col("tol"), F.col("target_area")))


def _conformity():
    return F.when(F.col("within"), 100.0).otherwise(F.greatest(F.lit(0.0), 100 - F.abs("delta") / F.col("target_area") * 100))


@query("A1_variance", _VAR + """select plan_id, type, target, cast(actual as bigint) as actual, cast(deviation as bigint) as deviation, round(deviation * 100.0 / target, 4) as deviation_pct, abs(deviation) <= allowed as within,
  round(case when abs(deviation) <= allowed then 100 else greatest(0, 100 - abs(deviation) * 100.0 / target) end, 4) as conformity,
  round(case when deviation < -allowed then abs(deviation + allowed) end, 4) as missing, round(case when deviation > allowed then deviation - allowed end, 4) as excess from k""")
def a1(v):
    d, a = F.col("delta"), F.col("allowed")
    return _variance(v).select("plan_id", "type", F.col("target_area").alias("target"), F.col("actual_area").alias("actual"), d.alias("deviation"), F.round(d / F.col("target_area") * 100, 4).alias("deviation_pct"), "within", F.round(_conformity(), 4).alias("conformity"), F.round(F.when(d < -a, F.abs(d + a)), 4).alias("missing"), F.round(F.when(d > a, d - a), 4).alias("excess"))


@query("A11_overall_conformity", _VAR + "select plan_id, round(avg(case when abs(deviation) <= allowed then 100 else greatest(0, 100 - abs(deviation) * 100.0 / target) end), 4) as conformity, count(*) as n_types from k group by plan_id")
def a11(v):
    return _variance(v).groupBy("plan_id").agg(F.round(F.avg(_conformity()), 4).alias("conformity"), F.count(F.lit(1)).alias("n_types"))


@query("A2_mix_report", _VAR + """select plan_id, type, target as target_area, cast(actual as bigint) as actual_area, actual_count, cast(deviation as bigint) as delta_area, abs(deviation) <= allowed as within_tolerance,
  round(avg(greatest(0, 1 - abs(deviation) * 1.0 / target)) over (partition by plan_id), 6) as compliance, cast(sum(target) over (partition by plan_id) as bigint) as total_target, cast(sum(actual) over (partition by plan_id) as bigint) as total_actual from k""")
def a2(v):
    """Text priorities weigh 1, so a plan's compliance is the plain mean of its ratios."""
    found = _variance(v)
    totals = found.groupBy("plan_id").agg(F.round(F.avg("ratio"), 6).alias("compliance"), F.sum("target_area").cast("long").alias("total_target"), F.sum("actual_area").alias("total_actual"))
    return found.select("plan_id", "type", "target_area", "actual_area", "actual_count", F.col("delta").alias("delta_area"), F.col("within").alias("within_tolerance")).join(totals, "plan_id")


@query("A2_discrepancies", _VAR + "select plan_id, string_agg(type || ':' || cast(-deviation as bigint), ',' order by ord) filter (deviation < 0) as missing, string_agg(type || ':' || cast(deviation as bigint), ',' order by ord) filter (deviation > 0) as excess from k group by plan_id")
def a2_lists(v):
    said = F.concat("type", F.lit(":"), F.abs("delta").cast("string"))
    listed = lambda c: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("ord", said.alias("said"))))), lambda x: x["said"]), ","), F.lit(""))
    return _variance(v).groupBy("plan_id").agg(listed(F.col("delta") < 0).alias("missing"), listed(F.col("delta") > 0).alias("excess"))


_STATUS = "case when abs(deviation) <= allowed then 'ok' when priority = 'obligatoire' then case when deviation < 0 then 'critical_missing' else 'critical_excess' end when deviation < 0 then 'missing' else 'excess' end"


@query("A3_typology_status", _VAR + f"select plan_id, type, {_STATUS} as status from k")
def a3(v):
    short = F.col("delta") < 0
    status = F.when(F.col("within"), "ok").when(F.col("priority") == "obligatoire", F.when(short, "critical_missing").otherwise("critical_excess")).otherwise(F.when(short, "missing").otherwise("excess"))
    return _variance(v).select("plan_id", "type", status.alias("status"))


@query("A3_deviation_summary", _VAR + """, s as (select plan_id, sum(case when priority = 'obligatoire' then 2 else 1 end) as wt, sum((case when priority = 'obligatoire' then 2 else 1 end) * case when abs(deviation) <= allowed then 1 else greatest(0, 1 - abs(deviation) * 1.0 / target) end) as c, sum(target) as t, sum(actual) as a from k group by plan_id)
  select plan_id, round(c / wt * 100, 4) as compliance, cast(greatest(0, (cast(max_x - min_x as bigint) * (max_y - min_y)) - a) as bigint) as lost_area, round(a * 1.0 / (cast(max_x - min_x as bigint) * (max_y - min_y)), 6) as yield_ratio, case when c / wt * 100 >= 95 then 'excellent' when c / wt * 100 >= 85 then 'good' when c / wt * 100 >= 70 then 'acceptable' else 'needs_improvement' end as band from s join plans using (plan_id)""")
def a3_summary(v):
    """Usable area: the plan's bounds."""
    weight = F.when(F.col("priority") == "obligatoire", 2).otherwise(1)
    sums = _variance(v).groupBy("plan_id").agg((F.sum(weight * F.when(F.col("within"), 1.0).otherwise(F.col("ratio"))) / F.sum(weight) * 100).alias("c"), F.sum("actual_area").alias("a"))
    usable = v.plans.select("plan_id", ((F.col("max_x") - F.col("min_x")).cast("long") * (F.col("max_y") - F.col("min_y"))).alias("usable"))
    band = F.when(F.col("c") >= 95, "excellent").when(F.col("c") >= 85, "good").when(F.col("c") >= 70, "acceptable").otherwise("needs_improvement")
    return sums.join(usable, "plan_id").select("plan_id", F.round("c", 4).alias("compliance"), F.greatest(F.lit(0).cast("long"), F.col("usable") - F.col("a")).alias("lost_area"), F.round(F.col("a") / F.col("usable"), 6).alias("yield_ratio"), band.alias("band"))


@query("A9_by_type", "select plan_id, type, count(*) as n, sum(cast(w as bigint) * h)::bigint as total_area, round(avg(cast(w as bigint) * h), 4) as avg_area, min(cast(w as bigint) * h) as min_area, max(cast(w as bigint) * h) as max_area from boxes group by plan_id, type")
def a9(v):
    area = F.col("w").cast("long") * F.col("h")
    return v.boxes.groupBy("plan_id", "type").agg(F.count(F.lit(1)).alias("n"), F.sum(area).alias("total_area"), F.round(F.avg(area), 4).alias("avg_area"), F.min(area).alias("min_area"), F.max(area).alias("max_area"))


@query("A10_typology_summary", f"with {_ACTUAL} select m.plan_id, coalesce(m.type, 'TOTAL') as type, cast(sum(coalesce(a.n, 0)) as bigint) as n, cast(sum(coalesce(a.area, 0)) as bigint) as area, cast(sum(target_area_cm2) as bigint) as target, cast(sum(coalesce(a.area, 0) - target_area_cm2) as bigint) as deviation from unit_mix m left join act a on a.plan_id = m.plan_id and a.type = m.type group by grouping sets ((m.plan_id, m.type), (m.plan_id))")
def a10(v):
    found = _variance(v).select("plan_id", "type", "actual_count", "actual_area", "target_area", "delta")
    both = found.unionByName(found.withColumn("type", F.lit("TOTAL")))
    total = lambda c: F.sum(c).cast("long")
    return both.groupBy("plan_id", "type").agg(total("actual_count").alias("n"), total("actual_area").alias("area"), total("target_area").alias("target"), total("delta").alias("deviation"))


@query("A12_export_metrics", """with b as (select plan_id, count(*) as n, sum(cast(w as bigint) * h) as a from boxes group by plan_id), c as (select plan_id, count(*) as n, sum(cast(w as bigint) * h) as a from corridors group by plan_id),
  j as (select p.plan_id, coalesce(b.n, 0) as boxes, coalesce(b.a, 0) as box_area, coalesce(c.n, 0) as corridors, coalesce(c.a, 0) as corridor_area from plans p left join b using (plan_id) left join c using (plan_id))
  select plan_id, metric, cast(value as bigint) as value from (select plan_id, unnest(['boxes', 'box_area', 'corridors', 'corridor_area']) as metric, unnest([boxes, box_area, corridors, corridor_area]) as value from j)""")
def a12(v):
    area = F.sum(F.col("w").cast("long") * F.col("h"))
    b = v.boxes.groupBy("plan_id").agg(F.count(F.lit(1)).alias("boxes"), area.alias("box_area"))
    c = v.corridors.groupBy("plan_id").agg(F.count(F.lit(1)).alias("corridors"), area.alias("corridor_area"))
    names = ["boxes", "box_area", "corridors", "corridor_area"]
    return v.plans.select("plan_id").join(b, "plan_id", "left").join(c, "plan_id", "left").fillna(0, names).unpivot("plan_id", names, "metric", "value")


@query("A12_summary_metrics", _VAR + """, q as (select plan_id, round(sum(case when priority = 'obligatoire' then 2 else 1 end * case when abs(deviation) <= allowed then 1.0 else greatest(0, 1 - abs(deviation) * 1.0 / target) end) * 100 / sum(case when priority = 'obligatoire' then 2 else 1 end), 4) as rate from k group by plan_id),
  b as (select plan_id, count(*) as n, sum(w * h / 10000.0::double) as a from boxes group by plan_id), jj as (select p.plan_id, coalesce(b.n, 0) as n, coalesce(b.a, 0) as a, coalesce(q.rate, 0) as rate, greatest(0, (max_x - min_x)::double * (max_y - min_y) / 10000 - coalesce(b.a, 0)) as lost from plans p left join b using (plan_id) left join q using (plan_id))
  select plan_id, unnest(['Total Boxes', 'Total Area (m²)', 'Compliance Rate (%)', 'Lost Area (m²)']) as metric, unnest([n, round(a, 4), rate, round(lost, 4)]::double[]) as value, null::varchar as status from jj
  union all select plan_id, 'Status', null, case when rate >= 95 then 'excellent' when rate >= 85 then 'good' when rate >= 70 then 'acceptable' else 'needs_improvement' end from jj""")
def a12_summary(v):
    """The five lines of an export's summary."""
    weight = F.when(F.col("priority") == "obligatoire", 2).otherwise(1)
    rate = F.round(F.sum(weight * _conformity() / 100) * 100 / F.sum(weight), 4)
    q = _variance(v).groupBy("plan_id").agg(rate.alias("rate"))
    b = v.boxes.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("w") * F.col("h") / 10000).alias("a"))
    j = v.plan_areas.join(b, "plan_id", "left").join(q, "plan_id", "left").fillna(0, ["n", "a", "rate"])
    lost = F.greatest(F.lit(0.0), F.col("plan_area") / 10000 - F.col("a"))
    status = F.when(F.col("rate") >= 95, "excellent").when(F.col("rate") >= 85, "good").when(F.col("rate") >= 70, "acceptable").otherwise("needs_improvement")
    line = lambda name, value, said=None: F.struct(F.lit(name).alias("metric"), (F.lit(None) if value is None else value).cast("double").alias("value"), (F.lit(None) if said is None else said).cast("string").alias("status"))
    return j.select("plan_id", F.inline(F.array(line("Total Boxes", F.col("n")), line("Total Area (m²)", F.round("a", 4)), line("Compliance Rate (%)", F.col("rate")), line("Lost Area (m²)", F.round(lost, 4)), line("Status", None, status))))


@query("A31_fulfilment", f"with {_ACTUAL}, j as (select m.plan_id, m.type, 40 + m.plan_id % 50 as target, coalesce(a.n, 0) as placed from unit_mix m left join act a on a.plan_id = m.plan_id and a.type = m.type) select plan_id, type, target, placed, round((placed - target) * 100.0 / target, 4) as deviation_pct, case when placed >= target then 'FULFILLED' else 'SHORTFALL' end as status, round(sum(least(placed, target)) over (partition by plan_id) * 1.0 / sum(target) over (partition by plan_id), 6) as overall from j")
def a31(v):
    found = _variance(v).select("plan_id", "type", (40 + F.col("plan_id") % 50).alias("target"), F.col("actual_count").alias("placed"))
    w = Window.partitionBy("plan_id")
    return found.select("plan_id", "type", "target", "placed", F.round((F.col("placed") - F.col("target")) / F.col("target") * 100, 4).alias("deviation_pct"), F.when(F.col("placed") >= F.col("target"), "FULFILLED").otherwise("SHORTFALL").alias("status"), F.round(F.sum(F.least("placed", "target")).over(w) / F.sum("target").over(w), 6).alias("overall"))


@query("A27_apportioned", """with t as (select plan_id, size_range, weight, 137 + plan_id as total, sum(weight) over (partition by plan_id) as s from distributions), r as (select *, cast(floor(total * weight * 1.0 / s + 0.5) as bigint) as n from t),
  k as (select *, row_number() over (partition by plan_id order by n desc, size_range) as rk, total - sum(n) over (partition by plan_id) as residual from r) select plan_id, size_range, cast(n + case when rk = 1 then residual else 0 end as bigint) as n from k""")
def a27(v):
    """Rounded shares of a count; the largest share takes what is left."""
    w = Window.partitionBy("plan_id")
    d = v.distributions.withColumn("total", 137 + F.col("plan_id")).withColumn("n", F.floor(F.col("total") * F.col("weight") / F.sum("weight").over(w) + 0.5))
    first = F.row_number().over(w.orderBy(F.desc("n"), "size_range")) == 1
    return d.select("plan_id", "size_range", (F.col("n") + F.when(first, F.col("total") - F.sum("n").over(w)).otherwise(0)).cast("long").alias("n"))
