"""Floor-plan tables derived from the driver's tables; the same SQL text runs in Spark and in the SQL twins. Units: centimetres."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_FIRST = "row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)"

VIEWS = {
    "plans": "select s_suppkey as plan_id, 0 as min_x, 0 as min_y, 12000 - 300 * (s_suppkey % 3) as max_x, 9000 - 250 * (s_suppkey % 2) as max_y, s_nationkey as building_id from {supplier}",
    "boxes": f"""select plan_id, floor_level, box_id, x, y, w, h,
        case when w * h <= 20000 then 'S' when w * h <= 50000 then 'M' when w * h <= 100000 then 'L' else 'XL' end as type
      from (select l_suppkey as plan_id, l_linenumber % 3 as floor_level, l_orderkey * 10 + l_linenumber as box_id,
          (l_partkey * 37) % 12000 as x, (l_orderkey * 53) % 9000 as y, 60 + 8 * cast(l_quantity as int) as w, 80 + 40 * l_linenumber as h, {_FIRST} as rn
        from {{lineitem}}) t where rn = 1""",
    "exits": """select s_suppkey as plan_id, r_regionkey as exit_id, (s_suppkey * 97 + r_regionkey * 3100) % 12000 as x, (s_suppkey * 61 + r_regionkey * 2300) % 9000 as y
      from {supplier} cross join {region} where r_regionkey < s_suppkey % 4""",
    "zones": """select p_partkey % (select count(*) from {supplier}) as plan_id, p_partkey as zone_id, (p_partkey * 71) % 11000 as x, (p_partkey * 43) % 8000 as y, 100 + 10 * p_size as w, 100 + 5 * p_size as h from {part}""",
    "corridors": """select o_custkey % (select count(*) from {supplier}) as plan_id, o_orderkey as corridor_id, (o_orderkey * 29) % 11000 as x, (o_orderkey * 17) % 8000 as y,
        case when o_orderkey % 2 = 0 then 600 else 100 + o_orderkey % 80 end as w, case when o_orderkey % 2 = 0 then 100 + o_orderkey % 80 else 600 end as h from {orders}""",
    "walls": """select plan_id, wall_id, x1, y1, x1 + case when p_size % 2 = 0 then 20 * p_size else 0 end as x2, y1 + case when p_size % 2 = 0 then 0 else 20 * p_size end as y2,
        case p_size % 5 when 0 then 'A-WALL' when 1 then 'Mur porteur' when 2 then 'cloison' when 3 then 'STRUCTURE' else 'Murs' end as layer
      from (select p_partkey % (select count(*) from {supplier}) as plan_id, p_partkey as wall_id, (p_partkey * 67) % 2000 as x1, (p_partkey * 31) % 1500 as y1, p_size from {part}) t""",
    "entities": f"""select plan_id, entity_id, entity_type, layer, color, len_cm
      from (select l_suppkey as plan_id, l_orderkey * 10 + l_linenumber as entity_id,
          case when l_linenumber % 3 = 0 then 'LWPOLYLINE' when l_linenumber % 3 = 1 then 'LINE' else 'HATCH' end as entity_type,
          case l_partkey % 8 when 0 then 'MUR' when 1 then 'ENTREE__SORTIE' when 2 then 'NO_ENTREE' when 3 then 'Stairs main' when 4 then 'TOLE GRISE' when 5 then 'dashed-zone' when 6 then '0' else 'Divers' end as layer,
          l_partkey % 256 as color, 10 * cast(l_quantity as int) as len_cm, {_FIRST} as rn
        from {{lineitem}}) t where rn = 1""",
    "unit_mix": """select s_suppkey as plan_id, m.type as type, m.base * 10000 + (s_suppkey % 7) * 50000 as target_area_cm2, case when s_suppkey % 2 = 0 then '10%' else '5' end as tolerance,
        case when m.ord <= 2 then 'obligatoire' else 'souhaitable' end as priority, m.ord as ord
      from {supplier} cross join (values (1, 'S', 40), (2, 'M', 600), (3, 'L', 1400), (4, 'XL', 1000)) as m(ord, type, base)""",
    "versions": "select o_custkey as project_id, o_orderkey as version_key, o_orderdate as updated_at, o_orderpriority as status from {orders}",
    "connectors": """select p_partkey % (select count(*) from {supplier}) as plan_id, p_partkey as connector_id, p_size % 4 as floor_level,
        case p_size % 5 when 0 then 'elevator' when 1 then 'escalator' when 2 then 'shaft' else 'stair' end as type, (p_partkey % 3) * 900 + (p_partkey * 13) % 150 as x, (p_partkey * 7) % 100 as y from {part}""",
    "webhook_events": """select event_id, ts, user_id, event_type, value from {events}
      union all select event_id, ts, user_id, event_type, value from {events} where event_id % 7 = 0""",
    "mix_lines": """select s_suppkey as plan_id, m.ord as line_no, case when (s_suppkey + m.ord) % 11 = 0 then null else m.type end as typologie,
        case when (s_suppkey + m.ord) % 13 = 0 then '0' when (s_suppkey * m.ord) % 17 = 5 then 'n/a' else concat(cast(m.base + s_suppkey % 9 as varchar(9)), case when s_suppkey % 3 = 0 then ',5' else '.25' end) end as surface_cible,
        case s_suppkey % 5 when 0 then '10%' when 1 then '5' when 2 then '-3' when 3 then null else '2,5%' end as tolerance,
        case when m.ord = 1 then 'Obligatoire' when m.ord = 2 then 'mandatory' when m.ord = 3 then null else 'souhaitable' end as priorite
      from {supplier} cross join (values (1, ' S (petit)', 40), (2, 'M', 60), (3, 'L-loft', 140), (4, 'XL', 100)) as m(ord, type, base)""",
    "distributions": """select s_suppkey as plan_id, d.size_range as size_range, d.weight + s_suppkey % 3 as weight
      from {supplier} cross join (values ('0-2', 25), ('2-5', 35), ('5-10', 25), ('10-20', 15), ('XL', 4), ('bad', 9)) as d(size_range, weight)""",
}


class Views:
    """The derived tables of one scale: views.boxes, views.exits, ... as DataFrames over the Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def plan_areas(self) -> DataFrame:
        """plan_id, plan_area: the area of each plan's bounds."""
        return self.plans.selectExpr("plan_id", "cast(max_x - min_x as bigint) * (max_y - min_y) as plan_area")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        text = VIEWS[name]
        return self.spark.sql(text, **{t: self.raw(t) for t in TABLES if "{" + t + "}" in text})


def twin(body: str) -> str:
    """The SQL twin of a query: the derived views it names, as common table expressions before it."""
    import re

    names = [n for n in VIEWS if re.search(rf"\b(?:from|join|,)\s+{n}\b", body)]
    ctes = [f"{n} as ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names]
    own = body.strip()
    if own.lower().startswith("with recursive "):
        return f"with recursive {', '.join(ctes)}{', ' if ctes else ''}{own[15:]}"
    if own.lower().startswith("with "):
        return f"with {', '.join(ctes)}{', ' if ctes else ''}{own[5:]}"
    return f"with {', '.join(ctes)} {own}" if ctes else own
