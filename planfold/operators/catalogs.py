"""Catalogues and rules with fixed values: box templates and their dimensions, clearances, building-code presets, element shapes, accessibility,
confidence of an interpretation, junctions, density. Lengths in metres here, centimetres where columns are plan coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planfold.operators import spatial

#: Box templates: least and greatest area, width and depth, and door width.
BOX_TEMPLATES = {
    "S": (0.5, 2.0, 0.8, 1.5, 0.8, 2.0, 0.9),
    "M": (2.0, 5.0, 1.2, 2.5, 1.0, 3.0, 1.0),
    "L": (5.0, 10.0, 1.5, 3.5, 1.5, 4.0, 1.2),
    "XL": (10.0, 20.0, 2.0, 5.0, 2.0, 5.0, 1.5),
}
#: Aspect of every template, and the ratios of width to depth that are tried in order.
ASPECT, RATIOS = (0.6, 1.4), (1.2, 1.5, 1.8, 2.0, 0.8, 0.6, 1.0)
#: Unit templates: least and greatest area.
UNIT_TEMPLATES = {"S": (0, 2), "M": (2, 5), "L": (5, 10), "XL": (10, 20)}
#: Clearance (metres) by the first pattern found in an obstacle's name; DEFAULT_CLEARANCE without one.
CLEARANCES = [
    ("stair|escalier|marche", 2.5),
    ("elevator|ascenseur|lift", 2.0),
    ("column|poteau|pillar|pilier", 0.5),
    ("radiateur|radiator|chauffage|heating", 0.8),
    ("exit|sortie|door|porte|entrance", 1.5),
    ("shaft|gaine|duct|conduit", 1.0),
]
DEFAULT_CLEARANCE = 0.5
#: Building-code presets: corridor width, egress limit, elevators required, accessible entrances; None keeps what is there.
CODE_PRESETS = {
    "none": (None, None, None, None),
    "ibc_common": (1.2, 45.0, True, 1),
    "eurocode_style": (1.2, 40.0, True, 1),
    "storage_warehouse": (1.5, 60.0, False, 0),
}


def box_template(area: Column) -> Column:
    """The first box template whose range holds the area (square metres); null for none."""
    return F.coalesce(*(F.when(area.between(lo, hi), name) for name, (lo, hi, *_) in BOX_TEMPLATES.items()))


def unit_template(area: Column) -> Column:
    """The first unit template whose range holds the area, else the one with the nearest end of its range (the first of those as near)."""
    inside = [F.when(area.between(lo, hi), name) for name, (lo, hi) in UNIT_TEMPLATES.items()]
    near = [F.struct(F.least(F.abs(area - lo), F.abs(area - hi)).cast("double").alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, (lo, hi)) in enumerate(UNIT_TEMPLATES.items())]
    return F.coalesce(*inside, F.least(*near)["name"])


def _rounded(x: Column, step: float | None) -> Column:
    return x if not step else F.floor(x / step + 0.5) * step


def box_dimensions(boxes: DataFrame, kind: str, area: str, dimension: float | None = None, area_step: float | None = None) -> DataFrame:
    """boxes with width, depth, box_area: of the template that column `kind` names (S, M, L, XL), for the square metres in column `area`, which
    are kept within the template's range.

    Ratios are tried in order: sides rounded to `dimension`, then within the template's ranges and aspect (20 % relaxed); with area_step the
    area is rounded and the sides scaled to it. Without a fit a box of ratio 1.2 clamped to the ranges; unknown templates: 2 by 1.5."""
    names = ["_lo", "_hi", "_w0", "_w1", "_d0", "_d1"]
    known = boxes.sparkSession.createDataFrame([(n, *t[:6]) for n, t in BOX_TEMPLATES.items()], "_kind string, " + ", ".join(f"{c} double" for c in names))
    b = boxes.withColumn("_kind", F.upper(kind)).join(F.broadcast(known), "_kind", "left")  # four fixed rows
    c = F.col
    b = b.withColumn("_a", F.greatest("_lo", F.least("_hi", area)))
    within = lambda x, lo, hi, less=1.0, more=1.0: x.between(c(lo) * less, c(hi) * more)
    sides = F.transform(F.array(*map(F.lit, RATIOS)), lambda r: F.struct(_rounded(F.sqrt(c("_a") * r), dimension).alias("w"), _rounded(c("_a") / F.sqrt(c("_a") * r), dimension).alias("d")))
    b = b.withColumn("_s", F.filter(sides, lambda x: within(x["w"], "_w0", "_w1") & within(x["d"], "_d0", "_d1") & (x["w"] / x["d"]).between(ASPECT[0] * 0.8, ASPECT[1] * 1.2)))
    if area_step:
        b = b.withColumn("_s", F.transform("_s", lambda x: F.struct(x["w"].alias("w"), x["d"].alias("d"), F.sqrt(_rounded(x["w"] * x["d"], area_step) / (x["w"] * x["d"])).alias("f"))))
        b = b.withColumn("_s", F.transform("_s", lambda x: F.struct(_rounded(x["w"] * x["f"], dimension).alias("w"), _rounded(x["d"] * x["f"], dimension).alias("d"))))
    fits = F.filter("_s", lambda x: within(x["w"] * x["d"], "_lo", "_hi", 0.8, 1.2) & within(x["w"], "_w0", "_w1", 0.8, 1.1) & within(x["d"], "_d0", "_d1", 0.8, 1.1))
    b = b.withColumn("_fit", F.get(fits, F.lit(0))).withColumn("_use", F.least("_a", c("_w1") * c("_d1") * 0.9))
    b = b.withColumn("_w", F.greatest("_w0", F.least("_w1", F.sqrt(c("_use") * 1.2)))).withColumn("_d", F.greatest("_d0", F.least("_d1", c("_use") / F.sqrt(c("_use") * 1.2))))
    small = c("_w") * c("_d") < c("_use") * 0.5
    side = lambda fit, own, most, other: F.coalesce(fit, F.when(small, F.least(c(most), c(own) * 1.2)), F.when(c("_lo").isNotNull(), c(own)), F.lit(other))
    b = b.withColumn("width", side(c("_fit.w"), "_w", "_w1", 2.0)).withColumn("depth", side(c("_fit.d"), "_d", "_d1", 1.5)).withColumn("box_area", c("width") * c("depth"))
    return b.withColumns({x: F.greatest(F.lit(0.5), x) for x in ("width", "depth")}).drop("_kind", *names, "_a", "_s", "_fit", "_use", "_w", "_d")


def clearance(name: Column) -> Column:
    said = F.lower(F.coalesce(name, F.lit("")))
    return F.coalesce(*(F.when(said.rlike(p), c) for p, c in CLEARANCES), F.lit(DEFAULT_CLEARANCE))


def exclusion_zones(obstacles: DataFrame) -> DataFrame:
    """obstacles(..., name, x, y, w, h) with clearance (centimetres) and the box x1, y1, x2, y2 grown by it."""
    o = obstacles.withColumn("clearance", (clearance(F.col("name")) * 100).cast("int"))
    c = F.col("clearance")
    return o.withColumns({"x1": F.col("x") - c, "y1": F.col("y") - c, "x2": F.col("x") + F.col("w") + c, "y2": F.col("y") + F.col("h") + c})


def with_preset(values: DataFrame, preset: Column) -> DataFrame:
    """values(corridor_width, egress_limit, require_elevators, accessible_entrances) with those that the preset names laid over; unknown presets and
    'none' keep all."""
    names = ["corridor_width", "egress_limit", "require_elevators", "accessible_entrances"]
    over = {c: [F.when(preset == code, F.lit(said[i])) for code, said in CODE_PRESETS.items() if said[i] is not None] for i, c in enumerate(names)}
    return values.withColumns({c: F.coalesce(*found, c) for c, found in over.items()})


def element_flags() -> dict[str, Column]:
    """Heuristics over columns entity_type, length, width, height (metres): door with its subtype and confidence, stair with its steps,
    elevator (as a shaft; by_size: a nearly square enclosure), column."""
    kind, n, w, h = F.col("entity_type"), F.col("length"), F.col("width"), F.col("height")
    arc, line = kind == "ARC", kind == "LINE"
    door = arc | (line & (n > 0.8) & (n < 1.5))
    stair = line & (n > 2) & (n < 10)
    single = line & (n > 0.8) & (n < 1.2)
    area = w * h
    return {
        "door": door, "door_type": F.when(door, F.when(arc, "swing").when(single, "single").otherwise("standard")), "door_confidence": F.when(door, F.when(arc, 0.9).when(single, 0.8).otherwise(0.5)),
        "stair": stair, "steps": F.when(stair, F.floor(n / 0.3)).otherwise(0), "elevator": (area > 1) & (area < 10), "elevator_by_size": (area > 2) & (area < 8) & (F.greatest(w, h) / F.least(w, h) < 2),
        "column": (kind == "CIRCLE") | ((F.abs(w - h) < 0.1) & (w < 0.5)),
    }


def accessibility(floors: DataFrame, connectors: DataFrame, entrances: DataFrame, require_elevators: bool = True, entrances_least: int = 1) -> DataFrame:
    """floors(plan_id, floor_level), connectors(plan_id, floor_level, type), entrances(plan_id, floor_level, width in metres) -> elevator, stairs
    (escalators count), accessible entrances (90 cm wide), pass and notes of each floor."""
    keys = ["plan_id", "floor_level"]
    c = connectors.groupBy(*keys).agg(F.bool_or(F.col("type") == "elevator").alias("elevator"), F.count(F.when(F.col("type").isin("stair", "escalator"), 1)).alias("stairs"), F.count(F.lit(1)).alias("connectors"))
    e = entrances.where("width >= 0.9").groupBy(*keys).agg(F.count(F.lit(1)).alias("entrances"))
    j = floors.select(*keys).distinct().join(c, keys, "left").join(e, keys, "left").fillna(0, ["stairs", "connectors", "entrances"]).fillna(False, ["elevator"])
    upper, ground = F.col("floor_level") > 0, F.col("floor_level") == 0
    none, no_lift, few = upper & (F.col("connectors") == 0), upper & F.lit(require_elevators) & ~F.col("elevator"), ground & (F.col("entrances") < entrances_least)
    notes = F.concat_ws(" ", F.when(none, "No vertical connector."), F.when(no_lift, "Elevator missing."), F.when(few, f"Needs {entrances_least} accessible entrances."))
    return j.select(*keys, "elevator", "stairs", "entrances", (~(none | no_lift | few)).alias("passes"), notes.alias("notes"))


def usable_area(plans: DataFrame, obstacles: DataFrame, forbidden: DataFrame, walls: DataFrame, exits: DataFrame, unknown: DataFrame) -> DataFrame:
    """plans(plan_id, min_x, ...), obstacles and forbidden (plan_id, w, h), others by plan_id -> usable (bounds less both, not under 0), confidence
    (percent) and warnings."""
    n = lambda df, name: df.groupBy("plan_id").agg(F.count(F.lit(1)).alias(f"n_{name}"))
    taken = obstacles.select("plan_id", "w", "h").unionByName(forbidden.select("plan_id", "w", "h")).groupBy("plan_id").agg(F.sum(F.col("w").cast("long") * F.col("h")).alias("taken"), F.count(F.lit(1)).alias("n_taken"))
    j = plans.join(taken, "plan_id", "left")
    for df, name in ((walls, "walls"), (exits, "exits"), (unknown, "unknown")):
        j = j.join(n(df, name), "plan_id", "left")
    j = j.fillna(0, ["taken", "n_taken", "n_walls", "n_exits", "n_unknown"])
    usable = F.greatest(F.lit(0).cast("long"), (F.col("max_x") - F.col("min_x")).cast("long") * (F.col("max_y") - F.col("min_y")) - F.col("taken"))
    plus = lambda test, k: F.when(test, k).otherwise(0)
    score = 50 + plus(F.col("n_walls") > 0, 20) + plus(F.col("n_exits") > 0, 15) + plus(F.col("n_taken") > 0, 10) + plus(usable > 0, 5) + plus(F.col("n_unknown") == 0, 5)
    warnings = F.concat_ws("; ", F.when(F.col("n_walls") == 0, "no walls"), F.when(F.col("n_exits") == 0, "no exits"), F.when(usable <= 0, "no usable area"))
    return j.select("plan_id", usable.alias("usable"), F.least(F.lit(100), score).alias("confidence"), warnings.alias("warnings"))


def corridor_junctions(corridors: DataFrame, tolerance: int = 20) -> DataFrame:
    """plan_id, kx, ky, degree, x, y, kind: ends of corridors' centrelines, and places where a horizontal one crosses a vertical one (with
    tolerance), that fall on one key of tolerance; two or more make a junction."""
    c = corridors.where("w > 0 and h > 0")
    flat = c.where("w >= h").withColumn("c", F.col("y") + F.col("h") / 2)
    up = c.where("w < h").withColumn("c", F.col("x") + F.col("w") / 2)
    point = lambda x, y: F.struct(x.cast("double").alias("px"), y.cast("double").alias("py"))
    ends = flat.select("plan_id", F.inline(F.array(point(F.col("x"), F.col("c")), point(F.col("x") + F.col("w"), F.col("c"))))).union(up.select("plan_id", F.inline(F.array(point(F.col("c"), F.col("y")), point(F.col("c"), F.col("y") + F.col("h"))))))
    inside = lambda v, t, p, s: v.between(F.col(f"{t}.{p}") - tolerance, F.col(f"{t}.{p}") + F.col(f"{t}.{s}") + tolerance)
    meet = spatial.grid_join(flat, up, ["plan_id"], inside(F.col("b.c"), "a", "x", "w") & inside(F.col("a.c"), "b", "y", "h"), pad=tolerance + 1)
    points = ends.union(meet.select(F.col("a.plan_id").alias("plan_id"), F.col("b.c").cast("double").alias("px"), F.col("a.c").cast("double").alias("py")))
    key = lambda v: F.floor(F.col(v) / tolerance + 0.5)
    g = points.groupBy("plan_id", key("px").alias("kx"), key("py").alias("ky")).agg(F.count(F.lit(1)).alias("degree"), F.avg("px").alias("x"), F.avg("py").alias("y")).where("degree >= 2")
    return g.withColumn("kind", F.when(F.col("degree") >= 4, "cross").when(F.col("degree") == 3, "T").otherwise("linear"))


def density_grid(plans: DataFrame, boxes: DataFrame, size: int = 32) -> DataFrame:
    """plan_id, gx, gy, n: boxes by their centre on a grid of size by size cells over the plan's bounds; those outside are left out."""
    cell = lambda p, s, a, z: F.floor((F.col(p) + F.col(s) / 2 - F.col(a)) / (F.col(z) - F.col(a)) * size).cast("int")
    b = boxes.join(plans.select("plan_id", "min_x", "min_y", "max_x", "max_y"), "plan_id").select("plan_id", cell("x", "w", "min_x", "max_x").alias("gx"), cell("y", "h", "min_y", "max_y").alias("gy"))
    return b.where(F.col("gx").between(0, size - 1) & F.col("gy").between(0, size - 1)).groupBy("plan_id", "gx", "gy").agg(F.count(F.lit(1)).alias("n"))


def valid_corridors(corridors: DataFrame, zones: DataFrame, entrances: DataFrame, boxes: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """Corridors that overlap no zone and no entrance, and no box of any floor by more than 1 - tolerance of their own area."""
    c = lambda t, n: F.col(f"{t}.{n}")
    strict = (c("a", "x") < c("b", "x") + c("b", "w")) & (c("b", "x") < c("a", "x") + c("a", "w")) & (c("a", "y") < c("b", "y") + c("b", "h")) & (c("b", "y") < c("a", "y") + c("a", "h"))
    side = lambda p, s: F.least(c("a", p) + c("a", s), c("b", p) + c("b", s)) - F.greatest(c("a", p), c("b", p))
    blocked = [t.select("plan_id", "x", "y", "w", "h", F.lit(k).alias("cuts")) for t, k in ((zones, False), (entrances, False), (boxes, True))]
    other = blocked[0].unionByName(blocked[1]).unionByName(blocked[2])
    bad = strict & (~c("b", "cuts") | (side("x", "w") * side("y", "h") > (1 - tolerance) * c("a", "w") * c("a", "h")))
    gone = spatial.grid_join(corridors, other, ["plan_id"], bad).select(c("a", "corridor_id").alias("corridor_id")).distinct()
    return corridors.join(gone, "corridor_id", "left_anti")
