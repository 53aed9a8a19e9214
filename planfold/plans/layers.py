"""Queries on layers and entities: names, classes, coverage, profiles, features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planfold.catalog import query
from planfold.functions.geometry import once
from planfold.functions import text
from planfold.operators import classify

_NAME = f"regexp_replace(regexp_replace(regexp_replace(upper(trim(translate(coalesce(layer, ''), '{text.ACCENTS}', '{text.PLAIN}'))), '[^A-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"


@query("P1_layer_name", f"select plan_id, wall_id, {_NAME} as name from (select plan_id, wall_id, concat(' é', layer, '-Zône ') as layer from walls) t")
def p1(v):
    return v.walls.select("plan_id", "wall_id", text.layer_name(F.concat(F.lit(" é"), "layer", F.lit("-Zône "))).alias("name"))


_CLASS = f"""(select *, case when regexp_matches(n, 'ENVELOPE|PERIMETER|BOUNDARY|EXTERNAL|OUTLINE') then 'envelope:0.95' when regexp_matches(n, 'ENTRANCE|EXIT|DOOR|OPENING|RED') or n = 'ENTREE_SORTIE' then 'entrance:0.9'
  when regexp_matches(n, 'FORBIDDEN|STAIR|ELEVATOR|LIFT|BLUE|RESTRICT') or n in ('NO_ENTREE', 'CABINETRY', 'LIGHTING', 'POWER', 'APPLIANCES') then 'forbidden:0.9' when n like '%WALL%' or n in ('MUR', '0') then 'wall:0.9'
  when color = 3 and entity_type = 'LWPOLYLINE' then 'envelope:0.8' when color = 4 or n like '%CYAN%' then 'entrance:0.95' when n like '%DASHED%' then 'forbidden:0.95' else 'wall:0.6' end as c from (select *, {_NAME} as n from entities) t)"""


def _classed(v):
    return v.entities.withColumn("c", classify.entity_class(F.col("layer"), F.col("color"), F.col("entity_type") == "LWPOLYLINE"))


@query("C1_entity_class", f"select plan_id, entity_id, split_part(c, ':', 1) as type, cast(split_part(c, ':', 2) as double) as confidence from {_CLASS} u")
def c1(v):
    return _classed(v).select("plan_id", "entity_id", F.col("c.type").alias("type"), F.col("c.confidence").cast("double").alias("confidence"))


@query("C1_class_counts", f"select plan_id, split_part(c, ':', 1) as type, count(*) as n from {_CLASS} u group by all")
def c1_counts(v):
    return _classed(v).groupBy("plan_id", F.col("c.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


def _contains(names):
    return " or ".join(f"contains(upper(trim(layer)), '{n}')" for n in names)


_STANDARD = "case " + " ".join(f"when {_contains(names)} then '{kind}'" for kind, names in classify.STANDARD) + " end"


@query("C4_standard_type", f"select distinct plan_id, layer, case when layer = 'Divers' and plan_id % 2 = 0 then 'TEXT' else {_STANDARD} end as standard from entities where plan_id % 2 = 0 union select distinct plan_id, layer, {_STANDARD} as standard from entities where plan_id % 2 = 1")
def c4(v):
    """Plans with even ids have an override for one layer."""
    layers = v.entities.select("plan_id", "layer").distinct()
    own = layers.sparkSession.createDataFrame([("divers", "TEXT")], "layer string, standard string")
    even = F.col("plan_id") % 2 == 0
    return classify.with_standard_type(layers.where(even), own).unionByName(classify.with_standard_type(layers.where(~even)))


@query("C5_mapping_coverage", f"""with l as (select distinct plan_id, layer, {_STANDARD} as standard from entities) select plan_id, count(*) filter (standard is not null) as mapped, string_agg(layer, ',' order by layer) filter (standard is null) as unmapped,
  count(*) filter (standard is null) = 0 as complete, string_agg(distinct standard, ',' order by standard) as types from l group by plan_id""")
def c5(v):
    found = classify.with_standard_type(v.entities.select("plan_id", "layer").distinct())
    agg = found.groupBy("plan_id").agg(F.count("standard").alias("mapped"), F.array_sort(F.collect_set(F.when(F.col("standard").isNull(), F.col("layer")))).alias("u"), F.array_sort(F.collect_set("standard")).alias("t"))
    return agg.select("plan_id", "mapped", F.nullif(F.array_join("u", ","), F.lit("")).alias("unmapped"), (F.size("u") == 0).alias("complete"), F.array_join("t", ",").alias("types"))


_ROLE = "case " + " ".join(f"when regexp_matches(lower(layer), '{words}') then '{name}'" for name, words in classify.ROLES.items()) + " else 'other' end"


@query("C6_semantic_role", f"select plan_id, {_ROLE} as role, count(*) as n from (select plan_id, layer from entities union all select plan_id, layer from walls) t group by all")
def c6(v):
    both = v.entities.select("plan_id", "layer").unionByName(v.walls.select("plan_id", "layer"))
    return both.groupBy("plan_id", classify.role(F.col("layer")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query("C9_forbidden_layers", "select plan_id, entity_id, layer from entities where upper(layer) in ('NO_ENTREE', 'FORBIDDEN') or upper(layer) like '%STAIR%' or color in (5, 150)")
def c9(v):
    up = F.upper("layer")
    return v.entities.where(up.isin("NO_ENTREE", "FORBIDDEN") | up.contains("STAIR") | F.col("color").isin(5, 150)).select("plan_id", "entity_id", "layer")


@query("C9_line_classes", f"select plan_id, entity_id, case when color = 1 or regexp_matches(n, 'ENTRANCE|EXIT|DOOR|OPENING') then 'entrance' when color = 5 or regexp_matches(n, 'FORBIDDEN|STAIR|ELEVATOR|LIFT|SHAFT|COLUMN|OBSTACLE') then 'forbidden' else 'wall' end as class from (select *, {_NAME} as n from entities) t")
def c9_lines(v):
    return v.entities.select("plan_id", "entity_id", classify.line_class(F.col("layer"), F.col("color")).alias("class"))


@query("C12_type_by_ranges", """with r(type, lo, hi, ord) as (values ('S', 0.0, 2.0, 1), ('M', 2.0, 5.0, 2), ('L', 5.0, 10.0, 3), ('XL', 10.0, 9999.0, 4)), a as (select box_id, w * h / 10000.0 as area from boxes),
  c as (select box_id, type, row_number() over (partition by box_id order by ord) as rn from a join r on area >= lo - 1e-6 and area <= hi + 1e-6) select box_id, type from c where rn = 1""")
def c12(v):
    """First range, in order, that holds the area with a slack of 1e-6; a few fixed ranges, so a when chain does the range join."""
    ranges = [("S", 0.0, 2.0), ("M", 2.0, 5.0), ("L", 5.0, 10.0), ("XL", 10.0, 9999.0)]
    area = F.col("w") * F.col("h") / 10000.0
    return v.boxes.select("box_id", F.coalesce(*(F.when(area.between(lo - 1e-6, hi + 1e-6), kind) for kind, lo, hi in ranges), F.lit("M")).alias("type"))


@query("A20_layer_profile", """select plan_id, layer, entity_type, count(*) as n, cast(sum(case when entity_type = 'LINE' then len_cm else 0 end) as bigint) as line_length, min(len_cm) as min_len, max(len_cm) as max_len from entities group by grouping sets ((plan_id, layer, entity_type), (plan_id, layer), (plan_id, entity_type), (plan_id))""")
def a20(v):
    sets = [[F.col("plan_id"), F.col("layer"), F.col("entity_type")], [F.col("plan_id"), F.col("layer")], [F.col("plan_id"), F.col("entity_type")], [F.col("plan_id")]]
    line = F.when(F.col("entity_type") == "LINE", F.col("len_cm")).otherwise(0)
    grouped = v.entities.groupingSets(sets, "plan_id", "layer", "entity_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(line).cast("long").alias("line_length"), F.min("len_cm").alias("min_len"), F.max("len_cm").alias("max_len"))


@query("T3_top_colors", "with c as (select plan_id, color, count(*) as n from entities group by all), r as (select *, row_number() over (partition by plan_id order by n desc, color) as place from c) select * from r where place <= 10")
def t3(v):
    counts = v.entities.groupBy("plan_id", "color").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("plan_id").orderBy(F.desc("n"), "color"))).where("place <= 10")


@query("U4_distinct_layers", "select distinct layer from entities union select distinct layer from walls")
def u4(v):
    return v.entities.select("layer").union(v.walls.select("layer")).distinct()


@query("S11_long_entities", """select plan_id, 'wall' as role, wall_id as source_id, x1 as x, y1 as y from walls union all select plan_id, 'exit', exit_id, x, y from exits union all select plan_id, 'zone', zone_id, x, y from zones union all select plan_id, 'box', box_id, x, y from boxes""")
def s11(v):
    parts = [v.walls.selectExpr("plan_id", "'wall' as role", "wall_id as source_id", "x1 as x", "y1 as y"), v.exits.selectExpr("plan_id", "'exit' as role", "exit_id as source_id", "x", "y"), v.zones.selectExpr("plan_id", "'zone' as role", "zone_id as source_id", "x", "y"), v.boxes.selectExpr("plan_id", "'box' as role", "box_id as source_id", "x", "y")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("P30_layer_hash", """with recursive l as (select distinct layer from entities), h(layer, i, v) as (select layer, 0, cast(0 as bigint) from l union all select layer, i + 1, ((v * 31 + ord(layer[i + 1]) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 from h where i < length(layer)),
  f as (select layer, ((v % 4294967296 + 4294967296) % 4294967296) % 1000 / 1000.0 as s from h where i = length(layer)) select layer, case when s = 0 then 0.001 else s end as feature from f""")
def p30(v):
    return v.entities.select("layer").distinct().select("layer", text.layer_hash(F.col("layer")).alias("feature"))


@query("W12_grid_spacings", """with x as (select distinct plan_id, x1 / 10 * 10 as c from (select plan_id, x1 // 10 * 10 as x1 from walls) t), d as (select plan_id, c - lag(c) over (partition by plan_id order by c) as spacing from x) select plan_id, cast(spacing as bigint) as spacing, count(*) as n from d where spacing is not null group by all""")
def w12(v):
    xs = v.walls.select("plan_id", (F.floor(F.col("x1") / 10) * 10).alias("c")).distinct()
    gaps = xs.withColumn("spacing", F.col("c") - F.lag("c").over(Window.partitionBy("plan_id").orderBy("c")))
    return gaps.where("spacing is not null").groupBy("plan_id", "spacing").agg(F.count(F.lit(1)).alias("n"))


@query("M3_one_hot", f"select entity_id, case when t = 'envelope' then 1 else 0 end || ',' || case when t = 'entrance' then 1 else 0 end || ',' || case when t = 'forbidden' then 1 else 0 end || ',' || case when t = 'wall' then 1 else 0 end as label from (select entity_id, split_part(c, ':', 1) as t from {_CLASS} u) w")
def m3(v):
    classes = F.array(*(F.lit(c) for c in ("envelope", "entrance", "forbidden", "wall")))
    label = once(F.col("c.type"), lambda t: F.array_join(F.transform(classes, lambda k: (k == t).cast("int").cast("string")), ","))
    return _classed(v).select("entity_id", label.alias("label"))


@query("M6_confusion", f"""with e as (select split_part(c, ':', 1) as t, case when color % 5 = 0 then 'wall' else split_part(c, ':', 1) end as p from {_CLASS} u) select t as truth, count(*) filter (p = 'envelope') as envelope, count(*) filter (p = 'entrance') as entrance, count(*) filter (p = 'forbidden') as forbidden, count(*) filter (p = 'wall') as wall from e group by t""")
def m6(v):
    found = _classed(v).select(F.col("c.type").alias("truth"), F.when(F.col("color") % 5 == 0, "wall").otherwise(F.col("c.type")).alias("said"))
    return found.groupBy("truth").pivot("said", ["envelope", "entrance", "forbidden", "wall"]).count().fillna(0)


@query("M7_training_stats", f"select split_part(c, ':', 1) as label, count(*) as n, count(distinct plan_id) as plans, round(avg(cast(split_part(c, ':', 2) as double)), 4) as confidence from {_CLASS} u group by 1")
def m7(v):
    return _classed(v).groupBy(F.col("c.type").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("plan_id").alias("plans"), F.round(F.avg("c.confidence"), 4).alias("confidence"))
