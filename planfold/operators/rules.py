"""Checks of layouts. Each gives issues(plan_id, code, severity, element_id, actual, required); a report is their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planfold.functions.geometry import gap_squared, overlap
from planfold.operators import graph, spatial

#: Side of the cells in which boxes and corridors meet: few of their rectangles lie in more than one.
CELL = 2000
#: Largest side of the boxes that go to the cell of their lower corner only; larger ones go to all their cells.
LARGEST = 500
#: Fixed value: how near a box must have a corridor.
REACH = 100


def issue(code: str, severity: str, element: str, actual: Column, required: Column | None = None) -> list[Column]:
    return [F.col("plan_id"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(element).cast("long").alias("element_id"), actual.cast("double").alias("actual"), (F.lit(None) if required is None else required).cast("double").alias("required")]


def narrow_corridors(corridors: DataFrame, main: int = 150, other: int = 120) -> DataFrame:
    """Main corridors (along the plan's longer axis: wider than high) narrower than main, others than other."""
    width, least = F.least("w", "h"), F.when(F.col("w") > F.col("h"), main).otherwise(other)
    return corridors.where(width < least).select(*issue("corridor_width", "MAJOR", "corridor_id", width, least))


def _by_size(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boxes up to LARGEST, all others)."""
    small = f"plan_id is not null and x is not null and y is not null and w <= {LARGEST} and h <= {LARGEST}"
    return boxes.where(small), boxes.where(f"not coalesce({small}, false)")


def boxes_in_zones(boxes: DataFrame, zones: DataFrame, pad: int = 0) -> DataFrame:
    """Boxes with a corner or the centre in a zone's rectangle. With the reach of another join of the same boxes as pad the larger ones share one shuffle."""
    small, rest = _by_size(boxes)
    spots = [("x", "y", 0, 0), ("x", "y", 1, 0), ("x", "y", 0, 1), ("x", "y", 1, 1), ("x", "y", 0.5, 0.5)]
    test = F.lit(False)
    for _, _, i, j in spots:
        px, py = F.col("a.x") + F.col("a.w") * i, F.col("a.y") + F.col("a.h") * j
        test = test | ((px >= F.col("b.x")) & (px <= F.col("b.x") + F.col("b.w")) & (py >= F.col("b.y")) & (py <= F.col("b.y") + F.col("b.h")))
    test = overlap("a", "b", strict=False) & test
    ids = lambda pairs: pairs.select(F.col("a.plan_id").alias("plan_id"), F.col("a.box_id").alias("box_id"), F.col("b.zone_id").alias("zone_id"))
    return ids(spatial.corner_join(small, zones, ["plan_id"], test, LARGEST, CELL)).unionByName(ids(spatial.grid_join(rest, zones, ["plan_id"], test, CELL, pad)))


def box_issues(boxes: DataFrame, exits: DataFrame, fire_doors: DataFrame, area: int = 5000, side: int = 50, limit: int = 3000, door: int = 150) -> DataFrame:
    """What a box shows by itself, in one pass: too small, too narrow, too far from the plan's nearest exit (over the limit a MAJOR issue, over
    80 % of it a MINOR one; plans without exits have none here), its centre less than `door` from a fire door (as near_fire_doors)."""
    d = F.col("distance")
    one = lambda test, code, severity, actual, required: F.when(test, F.struct(F.lit(code).alias("code"), severity.alias("severity"), actual.cast("double").alias("actual"), F.lit(float(required)).alias("required")))
    w_h, least = F.col("w") * F.col("h"), F.least("w", "h")
    found = F.array_compact(
        F.array(
            one(w_h < area, "box_area", F.lit("MINOR"), w_h, area),
            one(least < side, "box_side", F.lit("MINOR"), least, side),
            one(d > 0.8 * limit, "exit_distance", F.when(d > limit, "MAJOR").otherwise("MINOR"), F.round(d, 4), limit),
        )
    )
    by_plan = fire_doors.groupBy("plan_id").agg(F.collect_list(F.struct("x", "y")).alias("_doors"))
    dx, dy = (lambda e: F.col("x") + F.col("w") / 2 - e["x"]), (lambda e: F.col("y") + F.col("h") / 2 - e["y"])
    close = F.filter("_doors", lambda e: dx(e) * dx(e) + dy(e) * dy(e) < door * door)
    doors = F.transform(close, lambda e: F.struct(F.lit("box_fire_door").alias("code"), F.lit("MAJOR").alias("severity"), F.round(F.hypot(dx(e), dy(e)), 4).alias("actual"), F.lit(float(door)).alias("required")))
    # few rows a plan, written so that Spark sees how small they are before it deals out the boxes
    by_plan = graph.cut(spatial.exits_by_plan(exits).join(by_plan, "plan_id", "full"))
    j = boxes.join(by_plan, "plan_id", "left").withColumn("distance", F.sqrt(spatial.best_exit()["d2"])).withColumn("_all", F.when(F.col("_doors").isNull(), found).otherwise(F.concat(found, doors)))
    return j.select("plan_id", F.col("box_id").cast("long").alias("element_id"), F.inline("_all")).select("plan_id", "code", "severity", "element_id", "actual", "required")


def exits_missing(plans: DataFrame, exits: DataFrame) -> DataFrame:
    n = plans.select("plan_id").join(exits.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n")), "plan_id", "left").fillna(0)
    none = n.where("n = 0").select(*issue("no_exit", "CRITICAL", "plan_id", F.col("n"), F.lit(1)))
    return none.unionByName(n.where("n = 1").select(*issue("single_exit", "MAJOR", "plan_id", F.col("n"), F.lit(2))))


def without_access(boxes: DataFrame, corridors: DataFrame, exits: DataFrame, reach: int = REACH) -> DataFrame:
    """Boxes with no corridor within reach, in plans that have exits. Corridors go to all cells for larger boxes only where a plan has such."""
    small, rest = _by_size(boxes)
    far = spatial.corner_join(small, corridors, ["plan_id"], gap_squared("a", "b") < reach * reach, LARGEST, CELL, reach, "left_anti")
    beside = corridors.join(graph.cut(rest.select("plan_id").distinct()), "plan_id", "left_semi")
    near = spatial.within(rest, beside, ["plan_id"], reach, cell=CELL).select(F.col("a.box_id").alias("box_id")).distinct()
    alone = far.select("plan_id", "box_id").unionByName(rest.select("plan_id", "box_id").join(near, "box_id", "left_anti"))
    with_exits = graph.cut(exits.select("plan_id").distinct())
    return alone.join(with_exits, "plan_id", "left_semi").select(*issue("box_access", "MINOR", "box_id", F.lit(None), F.lit(reach)))


def dead_ends(corridors: DataFrame, reach: int = 50, least: int = 3) -> DataFrame:
    """Corridors linked to one other at most, in plans with at least three."""
    pairs = spatial.near_each_other(corridors, ["plan_id"], reach, F.col("a.corridor_id") != F.col("b.corridor_id"), CELL)
    links = pairs.groupBy(F.col("a.corridor_id").alias("corridor_id")).agg(F.count(F.lit(1)).alias("links"))
    many = graph.cut(corridors.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("plan_id"))  # as in box_issues
    ends = corridors.join(many, "plan_id", "left_semi").join(links, "corridor_id", "left").fillna(0, ["links"]).where("links <= 1")
    return ends.select(*issue("corridor_dead_end", "MINOR", "corridor_id", F.col("links"), F.lit(2)))


def audit(plans: DataFrame, boxes: DataFrame, corridors: DataFrame, zones: DataFrame, exits: DataFrame, fire_doors: DataFrame) -> DataFrame:
    """All issues of all plans. Boxes and corridors are read by several rules: they are derived and written once, and boxes go to their cell,
    where zones and corridors are, in one shuffle; what is found needs no join back."""
    boxes, corridors = graph.cut(boxes.select("plan_id", "box_id", "x", "y", "w", "h")), graph.cut(corridors.select("plan_id", "corridor_id", "x", "y", "w", "h"))
    hits = boxes_in_zones(boxes, zones, REACH).select(*issue("forbidden_zone", "CRITICAL", "box_id", F.col("zone_id")))
    out = narrow_corridors(corridors)
    for part in (dead_ends(corridors), box_issues(boxes, exits, fire_doors), without_access(boxes, corridors, exits, REACH), hits, exits_missing(plans, exits)):
        out = out.unionByName(part)
    return out


#: Least area (square feet) and least side (feet) of a room by type.
ROOM_MINIMUMS = {"office": (70, 7), "meeting": (120, 10), "restroom": (30, 5), "utility": (20, 4)}
FOOT = 30.48


def room_minimums(rooms: DataFrame) -> DataFrame:
    """rooms(plan_id, zone_id, type, w, h) -> issues of rooms that are too small (room_area) or too narrow (room_dimension)."""
    area, side = F.col("w") * F.col("h") / FOOT**2, F.least("w", "h") / FOOT
    of = lambda i: F.coalesce(*(F.when(F.col("type") == kind, F.lit(float(least[i]))) for kind, least in ROOM_MINIMUMS.items()))
    small = rooms.where(area < of(0)).select(*issue("room_area", "MAJOR", "zone_id", F.round(area, 4), of(0)))
    return small.unionByName(rooms.where(side < of(1)).select(*issue("room_dimension", "MINOR", "zone_id", F.round(side, 4), of(1))))


def fire_compartments(boxes: DataFrame, most: int = 500) -> DataFrame:
    """plan_id, area (square metres), walls: fire walls that plans with more box area than a compartment may have need."""
    area = boxes.groupBy("plan_id").agg((F.sum(F.col("w").cast("long") * F.col("h")) / 10000).alias("area"))
    return area.where(F.col("area") > most).withColumn("walls", (F.ceil(F.col("area") / most) - 1).cast("long"))


def near_fire_doors(boxes: DataFrame, doors: DataFrame, least: int = 150) -> DataFrame:
    """Boxes whose centre is less than `least` from a fire door: plan_id, box_id, exit_id, distance."""
    centres = spatial.points(boxes.withColumns({"x": F.col("x") + F.col("w") / 2, "y": F.col("y") + F.col("h") / 2}))
    pairs = spatial.within(centres, spatial.points(doors), ["plan_id"], least)
    return pairs.select(F.col("a.plan_id").alias("plan_id"), F.col("a.box_id").alias("box_id"), F.col("b.exit_id").alias("exit_id"), F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")).alias("distance"))
