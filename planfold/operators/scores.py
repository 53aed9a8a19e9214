"""Scores of placed layouts (plan and floor), each kept apart as its formula has it. Coordinates in centimetres, formulas in metres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planfold.functions.geometry import gap_squared, overlap
from planfold.operators import graph, spatial
from planfold.operators.rules import CELL

FLOOR = ["plan_id", "floor_level"]


def _count(pairs: DataFrame, name: str, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*(F.col(f"a.{k}").alias(k) for k in keys)).agg(F.count(F.lit(1)).alias(name))


def _band(x: Column, low: float, high: float, fall: float) -> Column:
    """1 between low and high, x / low under it, falling to 0 over `fall` beyond."""
    return F.when(x.between(low, high), 1.0).when(x < low, F.greatest(F.lit(0.0), x / low)).otherwise(F.greatest(F.lit(0.0), 1 - (x - high) / fall))


def fitness(plans: DataFrame, boxes: DataFrame, zones: DataFrame, exits: DataFrame, keys: list[str] = FLOOR) -> DataFrame:
    """keys, utilization, circulation, accessibility, aesthetics, constraints, total: an evolutionary search's objectives.

    utilization: box area of the plan's, best from 60 to 75 %; circulation: mean gap of boxes less than 10 m apart that don't overlap, best from
    1.5 to 2.5 m; accessibility: mean distance from the nearest exit, best from 5 to 15 m, 1 without exits; aesthetics: boxes with both
    coordinates within 10 cm of a half metre, and evenness of areas; constraints: a tenth off for each pair of boxes, box and zone or box and
    exit (a metre) that touch, and for each box that leaves the bounds."""
    boxes = graph.cut(boxes.select(*keys, "box_id", "x", "y", "w", "h"))
    near = spatial.within(boxes, boxes, keys, 1000, F.col("a.box_id") < F.col("b.box_id"), cell=4000)
    gap = F.sqrt(gap_squared("a", "b")) / 100
    # pairs that touch are those without a gap
    gaps = near.groupBy(*(F.col(f"a.{k}").alias(k) for k in keys)).agg(F.avg(F.when(gap > 0, gap)).alias("gap"), F.count(F.when(gap == 0, 1)).alias("v1"))
    other = zones.select("plan_id", "x", "y", "w", "h").unionByName(exits.select("plan_id", "x", "y", F.lit(100).alias("w"), F.lit(100).alias("h")))
    hits = _count(spatial.grid_join(boxes, other, ["plan_id"], overlap("a", "b", strict=False), CELL), "v2", keys)
    area = F.col("w").cast("double") * F.col("h") / 10000
    off = lambda c: F.pmod(F.col(c), F.lit(50))
    straight = (((off("x") < 10) | (off("x") > 40)) & ((off("y") < 10) | (off("y") > 40))).cast("double")
    out = (F.col("x") < F.col("min_x")) | (F.col("x") + F.col("w") > F.col("max_x")) | (F.col("y") < F.col("min_y")) | (F.col("y") + F.col("h") > F.col("max_y"))
    floor = ((F.col("max_x") - F.col("min_x")).cast("double") * (F.col("max_y") - F.col("min_y")) / 10000).alias("floor")
    b = spatial.nearest_exit(boxes, exits).join(plans, "plan_id").groupBy(*keys).agg(F.sum(area).alias("area"), F.max(floor).alias("floor"), F.avg(F.col("distance") / 100).alias("d"), F.avg(straight).alias("straight"), F.avg(area).alias("mean"), F.stddev_pop(area).alias("sd"), F.count(F.when(out, 1)).alias("v3"))
    for df in (gaps, hits):
        b = b.join(df, keys, "left")
    b = b.fillna(0, ["gap", "v1", "v2"])
    parts = {
        "utilization": _band(F.col("area") / F.col("floor"), 0.6, 0.75, 0.25), "circulation": _band(F.col("gap"), 1.5, 2.5, 5), "accessibility": F.when(F.col("d").isNull(), 1.0).otherwise(_band(F.col("d"), 5, 15, 30)),
        "aesthetics": 0.5 * F.col("straight") + 0.5 * F.greatest(F.lit(0.0), 1 - F.col("sd") / F.col("mean")), "constraints": F.greatest(F.lit(0.0), 1 - (F.col("v1") + F.col("v2") + F.col("v3")) / 10),
    }
    b = b.select(*keys, *(c.alias(n) for n, c in parts.items()))
    weights = {"utilization": 0.30, "circulation": 0.25, "accessibility": 0.20, "aesthetics": 0.15, "constraints": 0.10}
    return b.withColumn("total", sum(F.col(n) * w for n, w in weights.items()))


def nearest_other(boxes: DataFrame, keys: list[str] = FLOOR) -> DataFrame:
    """keys, box_id, d2: squared distance of each box's centre from the nearest other one of its keys, where there is one."""
    centres = spatial.points(boxes.select(*keys, "box_id", (F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") / 2).alias("y")))
    each = Window.partitionBy(*keys)
    some = graph.cut(centres.withColumn("_n", F.count(F.lit(1)).over(each)).where("_n > 1").drop("_n"))
    return spatial.nearest(some, "box_id", some, keys, gap_squared("a", "b"), more=F.col("a.box_id") != F.col("b.box_id"))


def placement_score(plans: DataFrame, boxes: DataFrame, zones: DataFrame, exits: DataFrame, keys: list[str] = FLOOR) -> DataFrame:
    """keys, density, accessibility, distribution, validity, total (0 to 100): share of the plan taken; 100 less the metres to the nearest exit
    (50 without exits); 100 less twice the metres by which the mean distance of nearest neighbours differs from twice the root of the mean
    area (100 for a single box); share of boxes inside the bounds that meet no zone."""
    boxes = graph.cut(boxes.select(*keys, "box_id", "x", "y", "w", "h"))
    inside = (F.col("x") >= F.col("min_x")) & (F.col("x") + F.col("w") <= F.col("max_x")) & (F.col("y") >= F.col("min_y")) & (F.col("y") + F.col("h") <= F.col("max_y"))
    area, floor = F.col("w").cast("double") * F.col("h") / 10000, (F.col("max_x") - F.col("min_x")).cast("double") * (F.col("max_y") - F.col("min_y")) / 10000
    # each part is counted by floor, so that boxes are not joined with what was found for them
    hit = spatial.grid_join(boxes, zones, ["plan_id"], overlap("a", "b"), CELL).select(*(F.col(f"a.{c}").alias(c) for c in boxes.columns)).distinct()
    hit = hit.join(plans, "plan_id").where(inside).groupBy(*keys).agg(F.count(F.lit(1)).alias("_bad"))
    apart = nearest_other(boxes, keys).groupBy(*keys).agg(F.avg(F.sqrt("d2") / 100).alias("apart"))
    access = F.when(F.col("distance").isNull(), 50.0).otherwise(F.greatest(F.lit(0.0), 100 - F.col("distance") / 100))
    g = spatial.nearest_exit(boxes, exits).join(plans, "plan_id").groupBy(*keys).agg(F.sum(area).alias("area"), F.max(floor).alias("floor"), F.avg(access).alias("accessibility"), F.avg(area).alias("mean"), F.count(F.when(inside, 1)).alias("_inside"), F.count(F.lit(1)).alias("_n"))
    g = g.join(hit, keys, "left").join(apart, keys, "left").withColumn("valid", (F.col("_inside") - F.coalesce("_bad", F.lit(0))) / F.col("_n"))
    distribution = F.when(F.col("apart").isNull(), 100.0).otherwise(F.greatest(F.lit(0.0), 100 - 2 * F.abs(F.col("apart") - 2 * F.sqrt("mean"))))
    g = g.select(*keys, (F.least(F.lit(1.0), F.col("area") / F.col("floor")) * 100).alias("density"), "accessibility", distribution.alias("distribution"), (F.col("valid") * 100).alias("validity"))
    return g.withColumn("total", 0.3 * F.col("density") + 0.3 * F.col("accessibility") + 0.2 * F.col("distribution") + 0.2 * F.col("validity"))


def sample_scores(plans: DataFrame, boxes: DataFrame, corridors: DataFrame, exits: DataFrame, rooms: DataFrame) -> DataFrame:
    """plan_id and the scores by which training samples are rated: quality (density near 60 %, exits 10 m away, corridors of 15 %, 30 boxes, 5
    corridors), spread (root of the variance of centres against 50 m), edges (centres 20 m from the plan's lower sides), efficiency (60 to 80 %
    used), layout (area to 20 square metres a room, square plans, 15 rooms)."""
    area = F.col("w").cast("double") * F.col("h") / 10000
    n = lambda df, name: df.groupBy("plan_id").agg(F.count(F.lit(1)).alias(name), F.sum(area).alias(f"{name}_area"))
    cx, cy = (F.col("x") + F.col("w") / 2) / 100, (F.col("y") + F.col("h") / 2) / 100
    b = spatial.nearest_exit(boxes, exits).groupBy("plan_id").agg(F.avg(F.col("distance") / 100).alias("d"), (F.var_pop(cx) + F.var_pop(cy)).alias("var"), F.avg(F.least(F.least(cx, cy) / 20, F.lit(1.0))).alias("edges"))
    wide, high = (F.col("max_x") - F.col("min_x")) / 100, (F.col("max_y") - F.col("min_y")) / 100
    j = plans.select("plan_id", (wide * high).alias("floor"), (wide / high).alias("aspect"))
    for df in (n(boxes, "boxes"), n(corridors, "corridors"), n(rooms, "rooms"), b):
        j = j.join(df, "plan_id", "left")
    counts = [f"{c}{e}" for c in ("boxes", "corridors", "rooms") for e in ("", "_area")]
    j = j.fillna(0, [*counts, "edges"])
    near = lambda x, ideal, width: F.greatest(F.lit(0.0), 1 - F.abs(x - ideal) / width)
    c, one = F.col, F.lit(1.0)
    quality = 0.30 * near(c("boxes_area") / c("floor"), 0.6, 0.4) + 0.25 * near(F.coalesce("d", F.lit(0.0)), 10, 15) + 0.25 * near(c("corridors_area") / c("floor"), 0.15, 0.15) + 0.10 * F.least(one, c("boxes") / 30) + 0.10 * F.least(one, c("corridors") / 5)
    spread = F.when(c("boxes") < 2, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.sqrt("var") / 50))
    layout = F.when(c("rooms") > 0, F.least(one, c("floor") / (c("rooms") * 20))).otherwise(1.0) * 0.4 + (1 - F.abs(c("aspect") - 1)) * 0.3 + F.least(one, c("rooms") / 15) * 0.3
    return j.select("plan_id", F.greatest(F.lit(0.0), F.least(one, quality)).alias("quality"), spread.alias("spread"), "edges", _band((c("boxes_area") + c("corridors_area")) / c("floor"), 0.6, 0.8, 0.2).alias("efficiency"), layout.alias("layout"))
