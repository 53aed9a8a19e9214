"""Queries on mixes read from files, reports and their bundles, versions, presets, layout scores and unions of issues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planfold.catalog import query
from planfold.functions import text
from planfold.operators import checks, mix
from planfold.operators.graph import shared_folder as _folder
from planfold.plans.layout import _ISSUES, _audit
from planfold.plans.mix import _VAR, _variance
from planfold.sources import files


@query("S1_mix_csv", "select type as typologie, cast(target_area_cm2 // 10000 as bigint)::varchar as surface_cible, tolerance, priority as priorite, count(*) as n from unit_mix group by all")
def s1(v):
    """Unit mixes written as CSV files of two dialects, with other headers in another order, and read back by header aliases."""
    path = _folder(v.spark)
    m = v.unit_mix.withColumn("area", F.floor(F.col("target_area_cm2") / 10000))
    even = F.col("plan_id") % 2 == 0
    m.where(even).select(F.col("type").alias("Type"), F.col("area").alias("AREA"), F.col("tolerance").alias("Tolerance"), F.col("priority").alias("PRIORITY")).write.option("header", True).csv(path)
    m.where(~even).select(F.col("priority").alias(" priorite "), F.col("area").alias("Surface_Cible"), F.lit("a, b").alias("note"), F.col("tolerance").alias("tolerance"), F.col("type").alias("Designation")).write.option("header", True).mode("append").csv(path)
    return files.read_mix_csv(v.spark, path).groupBy("typologie", "surface_cible", "tolerance", "priorite").agg(F.count(F.lit(1)).alias("n"))


_SAVES = "(select project_id, status, updated_at, row_number() over (partition by project_id order by updated_at, version_key) as rn from versions)"


@query("S5_saved_versions", f"""with s as {_SAVES}, a as (select * from s where rn = 1 and project_id % 7 > 0), b as (select * from s where rn = 2)
  select project_id, 1.0::double as version, updated_at as created_at, updated_at, status as payload from a union all select b.project_id, case when a.project_id is null then 1.0 else 1.1 end::double, coalesce(a.updated_at, b.updated_at), b.updated_at, b.status from b left join a using (project_id)""")
def s5_saved(v):
    """The first save of most projects, and then the second of all: versions rise by 0.1 and keep their time of creation."""
    w = Window.partitionBy("project_id").orderBy("updated_at", "version_key")
    s = v.versions.withColumn("rn", F.row_number().over(w))
    stored = s.where("rn = 1 and project_id % 7 > 0").select("project_id", F.lit(1.0).alias("version"), F.col("updated_at").alias("created_at"), "updated_at", F.col("status").alias("payload"))
    return files.save_version(stored, s.where("rn = 2").select("project_id", "updated_at", F.col("status").alias("payload")))


@query("S5_project_stats", "select project_id, count(*) as saves, min(updated_at) as created_at, max(updated_at) as updated_at, count(distinct status) as statuses, round(1.0 + 0.1 * (count(*) - 1), 1)::double as version from versions group by project_id")
def s5_stats(v):
    """Saves, times and the version each project has reached."""
    n = F.count(F.lit(1))
    return v.versions.groupBy("project_id").agg(n.alias("saves"), F.min("updated_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.countDistinct("status").alias("statuses"), F.round(1 + 0.1 * (n - 1), 1).alias("version"))


@query("S6_upserted_metadata", "with l as (select project_id, status, max(struct_pack(u := updated_at, k := version_key)) as m from versions group by all) select project_id, string_agg(status || '=' || m.k, ',' order by status) as metadata, max(m).k as last_key from l group by project_id")
def s6(v):
    """Transforms stored and written again under the same keys: metadata is merged, later values on top."""
    at = F.struct("updated_at", "version_key")
    row = v.versions.select(F.col("project_id").alias("key"), at.alias("updated_at"), F.create_map("status", F.col("version_key").cast("string")).alias("metadata"), "version_key")
    out = files.upserted(row.where("version_key % 2 = 0").drop("version_key"), row.where("version_key % 2 = 1").drop("version_key"))
    pairs = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return out.select(F.col("key").alias("project_id"), F.array_join(pairs, ",").alias("metadata"), F.col("updated_at.version_key").alias("last_key"))


@query("S8_report_bundle", _VAR + """select 'box_list' as part, count(*) as n, cast(sum(w) as double) as total from boxes union all select 'by_type', count(*), cast(sum(n) as double) from (select count(*) as n from boxes group by plan_id, type) t
  union all select 'discrepancies', count(*), cast(sum(abs(deviation)) as double) from k where abs(deviation) > allowed union all select 'summary', count(*), cast(sum(actual) as double) from (select plan_id, sum(actual) as actual from k group by plan_id) t""")
def s8(v):
    """The four tables of a report written side by side and read back."""
    path = _folder(v.spark)
    found = _variance(v)
    tables = {
        "box_list": v.boxes.select("plan_id", "box_id", "type", "x", "y", F.col("w").alias("value"), "h"),
        "by_type": v.boxes.groupBy("plan_id", "type").agg(F.count(F.lit(1)).alias("value")),
        "discrepancies": found.where("not within").select("plan_id", "type", F.abs("delta").alias("value")),
        "summary": found.groupBy("plan_id").agg(F.sum("actual_area").alias("value")),
    }
    files.write_bundle(tables, path)
    parts = [v.spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("double").alias("total")).select(F.lit(name).alias("part"), "n", "total") for name in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("S9_building_documents", """with f as (select plan_id, floor_level, count(*) as n, cast(sum(cast(w as bigint) * h) as bigint) as area from boxes group by all), p as (select building_id, plan_id, max_x, max_y, string_agg(floor_level || ':' || n || ':' || area, ';' order by floor_level) as floors from plans left join f using (plan_id) group by all)
  select building_id, count(*) as plans, string_agg(plan_id || '[' || coalesce(floors, '') || ']', ',' order by plan_id) as floors from p group by building_id""")
def s9(v):
    """One nested JSON document for each building with its plans and their floors, read back."""
    f = v.boxes.groupBy("plan_id", "floor_level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("w").cast("long") * F.col("h")).alias("area"))
    floors = f.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("floor_level", "n", "area"))).alias("floors"))
    p = v.plans.join(floors, "plan_id", "left")
    docs = p.groupBy("building_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("plan_id", "max_x", "max_y", "floors"))).alias("plans"))).alias("document"))
    d = docs.select("building_id", F.from_json("document", "plans array<struct<plan_id: long, max_x: int, max_y: int, floors: array<struct<floor_level: int, n: long, area: long>>>>").alias("d"))
    level = lambda x: F.concat_ws(":", x["floor_level"].cast("string"), x["n"].cast("string"), x["area"].cast("string"))
    said = F.transform("d.plans", lambda q: F.concat(q["plan_id"].cast("string"), F.lit("["), F.coalesce(F.array_join(F.transform(q["floors"], level), ";"), F.lit("")), F.lit("]")))
    return d.select("building_id", F.size("d.plans").cast("long").alias("plans"), F.array_join(said, ",").alias("floors"))


@query("S10_appended_samples", "select k.step, cast(count(*) filter (zone_id % 2 = k.step - 1) as bigint) as appended, cast(count(*) filter (zone_id % 2 < k.step) as bigint) as total from zones cross join (values (1), (2)) as k(step) group by k.step")
def s10(v):
    """Samples appended to a training set in two steps, with what each adds and the total."""
    path = _folder(v.spark)
    rows = [(k + 1, *files.append_samples(v.zones.where(f"zone_id % 2 = {k}").select("zone_id", "w", "h"), path)) for k in (0, 1)]
    return v.spark.createDataFrame(rows, "step int, appended long, total long")


_WANTED = "(select plan_id, ord, case ord when 1 then type when 2 then type || ' (large)' when 3 then lower(type) || '-x' else 'none' end as type from unit_mix)"
_BASED = "coalesce(nullif(regexp_extract({0}, '^([A-Za-z0-9]+)', 1), ''), {0})"


@query("J9_match_rules", f"""with m as (select *, {_BASED.format('type')} as base from {_WANTED} t), b as (select plan_id, type, count(*) as n, cast(sum(cast(w as bigint) * h) as bigint) as area from boxes group by all)
  select m.plan_id, m.ord, m.type, coalesce(e.n, f.n, g.n, 0) as actual_count, coalesce(e.area, f.area, g.area, 0) as actual_area, case when e.n > 0 then 'exact' when f.n > 0 then 'base' when g.n > 0 then 'any case' else 'none' end as rule
  from m left join b e on e.plan_id = m.plan_id and e.type = m.type left join b f on f.plan_id = m.plan_id and f.type = m.base left join b g on g.plan_id = m.plan_id and lower(g.type) = lower(m.base)""")
def j9(v):
    """Mix lines under other names against box types: exact, by base name, then whatever the case."""
    t = F.col("type")
    wanted = v.unit_mix.select("plan_id", "ord", F.when(F.col("ord") == 1, t).when(F.col("ord") == 2, F.concat(t, F.lit(" (large)"))).when(F.col("ord") == 3, F.concat(F.lower(t), F.lit("-x"))).otherwise("none").alias("type"))
    return mix.matched(wanted, v.boxes).select("plan_id", "ord", "type", "actual_count", "actual_area", "rule")


_COUNTED = "(select plan_id, ord, type, case when ord <> 3 then target_area_cm2 end as ta, case when (plan_id + ord) % 2 = 0 or ord = 3 then 20 + plan_id % 30 * ord end as tc, tolerance, case ord when 1 then '3' when 2 then '0' when 3 then 'high' else '2,5' end as priority, case ord when 1 then 3.0 when 4 then 2.5 else 1.0 end as weight from unit_mix)"


@query("A2_area_and_count_targets", f"""with m as (select m.*, coalesce(b.n, 0) as n, coalesce(b.area, 0) as area, case when contains(tolerance, '%') then cast(replace(tolerance, '%', '') as double) / 100 end as share, try_cast(tolerance as double) as fixed from {_COUNTED} m left join (select plan_id, type, count(*) as n, sum(cast(w as bigint) * h) as area from boxes group by all) b on b.plan_id = m.plan_id and b.type = m.type),
  d as (select *, area - ta as da, n - tc as dc, abs(area - ta) <= coalesce(share * ta, fixed) as wa, abs(n - tc) <= coalesce(share * tc, fixed) as wc, case when ta is not null then greatest(0, 1 - abs(area - ta) * 1.0 / ta) when tc is not null then greatest(0, 1 - abs(n - tc) * 1.0 / tc) else 0 end as ratio from m)
  select plan_id, type, cast(da as bigint) as delta_area, cast(dc as bigint) as delta_count, case when wa is null then wc when wc is null then wa else wa and wc end as within, round(ratio, 6) as ratio, weight, round(sum(ratio * weight) over (partition by plan_id) / sum(weight) over (partition by plan_id), 6) as compliance from d""")
def a2_counts(v):
    """Targets of area, of count, or both, weighed by priorities (those that are no number, or 0, weigh 1)."""
    o = F.col("ord")
    m = v.unit_mix.select("plan_id", "type", F.when(o != 3, F.col("target_area_cm2")).alias("target_area"), F.when(((F.col("plan_id") + o) % 2 == 0) | (o == 3), 20 + F.col("plan_id") % 30 * o).alias("target_count"), "tolerance", F.when(o == 1, "3").when(o == 2, "0").when(o == 3, "high").otherwise("2,5").alias("priority"))
    r = mix.report(m, v.boxes)
    total = r.groupBy("plan_id").agg(F.round(F.sum(F.col("ratio") * F.col("weight")) / F.sum("weight"), 6).alias("compliance"))
    return r.join(total, "plan_id").select("plan_id", "type", F.col("delta_area").cast("long").alias("delta_area"), F.col("delta_count").cast("long").alias("delta_count"), "within", F.round("ratio", 6).alias("ratio"), "weight", "compliance")


_TARGETS = [("S", 1.0, 2.0, 1.5), ("M", 2.5, 4.0, 3.0), ("L", 5.0, 7.0, 6.0), ("XL", 30.0, 40.0, 35.0)]


@query("C12_type_by_target", """select box_id, case when a between 1 and 2 then 'S' when a between 2.5 and 4 then 'M' when a between 5 and 7 then 'L' when a between 30 and 40 then 'XL'
    when abs(a - 1.5) <= least(abs(a - 3), abs(a - 6), abs(a - 35)) and abs(a - 1.5) <= 0.75 then 'S' when abs(a - 3) < abs(a - 1.5) and abs(a - 3) <= least(abs(a - 6), abs(a - 35)) and abs(a - 3) <= 1.5 then 'M'
    when abs(a - 6) < least(abs(a - 1.5), abs(a - 3)) and abs(a - 6) <= abs(a - 35) and abs(a - 6) <= 3 then 'L' when abs(a - 35) < least(abs(a - 1.5), abs(a - 3), abs(a - 6)) and abs(a - 35) <= 17.5 then 'XL' when a < 6 then 'single' when a < 12 then 'double' when a < 20 then 'team' else 'meeting' end as type from (select box_id, w * h / 10000.0 as a from boxes) t""")
def c12_target(v):
    """By ranges with gaps between them, then by the nearest target, then by general limits."""
    return v.boxes.select("box_id", mix.type_by_target(F.col("w") * F.col("h") / 10000.0, _TARGETS).alias("type"))


@query("U1_issue_union", _ISSUES + "select plan_id, code, severity, count(*) as n from i group by all")
def u1(v):
    """The union of all checks' issues, counted."""
    return _audit(v).groupBy("plan_id", "code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("T3_top_sizes", "with c as (select plan_id, w, h, count(*) as n from boxes group by all), r as (select *, row_number() over (partition by plan_id order by n desc, w, h) as place from c) select plan_id, w, h, n, place from r where place <= 5")
def t3_sizes(v):
    counts = v.boxes.groupBy("plan_id", "w", "h").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("plan_id").orderBy(F.desc("n"), "w", "h"))).where("place <= 5")


@query("T3_top_spacings", """with x as (select distinct plan_id, x1 // 10 * 10 as c from walls), d as (select plan_id, c - lag(c) over (partition by plan_id order by c) as spacing from x), c as (select plan_id, cast(spacing as bigint) as spacing, count(*) as n from d where spacing is not null group by all), r as (select *, row_number() over (partition by plan_id order by n desc, spacing) as place from c) select * from r where place <= 5""")
def t3_spacings(v):
    xs = v.walls.select("plan_id", (F.floor(F.col("x1") / 10) * 10).alias("c")).distinct()
    gaps = xs.withColumn("spacing", F.col("c") - F.lag("c").over(Window.partitionBy("plan_id").orderBy("c"))).where("spacing is not null").groupBy("plan_id", "spacing").agg(F.count(F.lit(1)).alias("n"))
    return gaps.withColumn("place", F.row_number().over(Window.partitionBy("plan_id").orderBy(F.desc("n"), "spacing"))).where("place <= 5")


@query("C16_preset_lookup", """with p as (select preset, 'mix ' || preset % 3 as category, size_range, weight from (select plan_id as preset, size_range, weight from distributions) t where preset in (select min(plan_id) from plans group by plan_id % 3)), s as (select d.plan_id, p.preset, p.category, sum(abs(d.weight - p.weight)) as off, sum(d.weight) as total from distributions d join p using (size_range) group by all)
  select plan_id, preset, category, round(1 - off * 1.0 / total, 6) as score, row_number() over (partition by plan_id order by 1 - off * 1.0 / total desc, preset) as place from s""")
def c16(v):
    """Presets (the three distributions that plans have) recommended to each plan by how much of its weight they share."""
    d = v.distributions
    presets = d.join(d.groupBy((F.col("plan_id") % 3).alias("k")).agg(F.min("plan_id").alias("plan_id")), "plan_id").select(F.col("plan_id").alias("preset"), F.concat(F.lit("mix "), F.col("k")).alias("category"), "size_range", F.col("weight").alias("p"))
    s = d.join(presets, "size_range").groupBy("plan_id", "preset", "category").agg((1 - F.sum(F.abs(F.col("weight") - F.col("p"))) / F.sum("weight")).alias("score"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("plan_id").orderBy(F.desc("score"), "preset")).cast("long")).withColumn("score", F.round("score", 6))


@query("C16_recommended_presets", """with a as (select plan_id, cast(max_x - min_x as bigint) * (max_y - min_y) / 40000.0 * (1 + plan_id % 4) / 2 as area from plans), r as (select plan_id, count(*) as n from zones group by plan_id), f as (select plan_id, area, case when plan_id % 3 = 0 then coalesce(n, 0) else coalesce(n, 0) // 8 end as rooms from a left join r using (plan_id)),
  s as (select plan_id, 'modern-office' as preset, 0.9 as score from f where area > 500 and area < 5000 union all select plan_id, 'hotel-standard', 0.85 from f where area > 1000 and rooms > 10 union all select plan_id, 'warehouse', 0.8 from f where area > 2000 and rooms < 5) select plan_id, preset, score::double as score from s""")
def c16_recommended(v):
    """Presets by area (in square metres of a drawing at another scale) and number of rooms."""
    rooms = v.zones.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))
    f = v.plan_areas.join(rooms, "plan_id", "left").fillna(0, ["n"]).select("plan_id", (F.col("plan_area") / 40000.0 * (1 + F.col("plan_id") % 4) / 2).alias("area"), F.when(F.col("plan_id") % 3 == 0, F.col("n")).otherwise(F.floor(F.col("n") / 8)).alias("rooms"))
    return checks.recommended_presets(f)


_SCORED = """with g as (select plan_id, floor_level, count(*) as n, sum(cast(w as bigint) * h) as area, avg(case when x % 10 = 0 then 1.0 else 0 end) as ax, avg(case when y % 10 = 0 then 1.0 else 0 end) as ay from boxes group by all), t as (select plan_id, floor_level, type, sum(cast(w as bigint) * h) as actual from boxes group by all),
  m as (select *, case when contains(tolerance, '%') then target_area_cm2 * 0.1 else 5 end as allowed, case when priority = 'obligatoire' then 2 else 1 end as wt from unit_mix), c as (select g.plan_id, g.floor_level, greatest(0, 1 - sum(least(1, abs(coalesce(actual, 0) - target_area_cm2) * 1.0 / (target_area_cm2 + allowed)) * wt) / sum(wt)) as compliance from g join m using (plan_id) left join t on t.plan_id = g.plan_id and t.floor_level = g.floor_level and t.type = m.type group by all),
  s as (select g.*, coalesce(compliance, 0) as compliance, least(1, area * 1.0 / (cast(max_x - min_x as bigint) * (max_y - min_y)) / 0.8) as yield_score, (case when n < 2 then 1 else ax end + case when n < 2 then 1 else ay end) / 2 as readability from g left join c using (plan_id, floor_level) join plans using (plan_id)), z as (select *, 0.4 * compliance + 0.3 * yield_score + 0.2 * 0.375 + 0.1 * readability as score from s)
"""  # fmt: skip


def _solutions(v):
    tol = text.tolerance(F.col("tolerance"))
    m = v.unit_mix.select("plan_id", "type", F.col("target_area_cm2").alias("target_area"), text.allowed(tol, F.col("target_area_cm2")).alias("allowed"), "priority")
    return checks.solution_scores(["plan_id", "floor_level"], m, v.boxes, v.plan_areas)


@query("A22_solution_scores", _SCORED + "select plan_id, floor_level, round(compliance, 6) as compliance, round(yield_score, 6) as yield_score, round(readability, 6) as readability, round(score, 6) as score from z")
def a22_solutions(v):
    """The optimiser's score of each floor's layout and its parts."""
    return _solutions(v).select("plan_id", "floor_level", *(F.round(c, 6).alias(c) for c in ("compliance", "yield_score", "readability", "score")))


@query("A23_best_layout", _SCORED + "select plan_id, floor_level, round(score, 6) as score from (select *, row_number() over (partition by plan_id order by round(score, 9) desc, floor_level) as rn from z) t where rn = 1")
def a23(v):
    """The best-scored layout of each plan; ties go to the lower floor."""
    best = _solutions(v).groupBy("plan_id").agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("floor_level")).alias("k"))).alias("m"))
    return best.select("plan_id", (-F.col("m.k")).alias("floor_level"), F.round("m.score", 6).alias("score"))
