"""Joins of rectangles and points by grid cells: an equi-join on plan and cell, then the exact test.

Every shape goes to each cell its rectangle meets; a pair is tested only in the cell that holds the larger of the two lower corners,
so nothing needs to be made distinct. Cells spread one large plan over many keys, so a skewed plan is no hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planfold.functions.geometry import gap_squared, overlap
from planfold.operators import graph


def in_cells(shapes: DataFrame, cell: int, pad: float = 0) -> DataFrame:
    """shapes(x, y, w, h) with cx, cy for each cell that the rectangle, grown by pad, meets."""
    low = lambda p: F.floor((F.col(p) - pad) / cell)
    high = lambda p, s: F.floor((F.col(p) + F.col(s) + pad) / cell)
    return shapes.withColumn("cx", F.explode(F.sequence(low("x"), high("x", "w")))).withColumn("cy", F.explode(F.sequence(low("y"), high("y", "h"))))


def grid_join(left: DataFrame, right: DataFrame, keys: list[str], test: Column, cell: int = 1000, pad: float = 0, how: str = "inner", right_pad: float = 0) -> DataFrame:
    """Pairs a, b (struct columns) of rectangles at most pad + right_pad apart that pass test (over aliases a and b)."""
    a, b = in_cells(left, cell, pad).alias("a"), in_cells(right, cell, right_pad).alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "cx", "cy"]]
    lower = lambda p: F.floor(F.greatest(F.col(f"a.{p}") - pad, F.col(f"b.{p}") - right_pad) / cell)
    corner = (lower("x") == F.col("a.cx")) & (lower("y") == F.col("a.cy"))
    condition = corner & test
    for s in same:
        condition = condition & s
    return a.join(b, condition, how)


def corner_join(left: DataFrame, right: DataFrame, keys: list[str], test: Column, most: int, cell: int = 1000, pad: int = 0, how: str = "inner") -> DataFrame:
    """As grid_join for a left side without nulls in keys, x, y whose rectangles are at most `most` wide and high: each goes to the one cell of
    its lower corner, the right side to all from which it can be reached. So how may be left_semi or left_anti, and joins of one left side
    share its shuffle."""
    at = lambda p: F.coalesce(F.floor(F.col(p) / cell), F.lit(0).cast("long"))
    a = left.withColumns({"cx": at("x"), "cy": at("y")}).alias("a")
    grown = right.withColumns({"_x": F.col("x") - pad - most, "_y": F.col("y") - pad - most, "_w": F.col("w") + 2 * pad + most, "_h": F.col("h") + 2 * pad + most})
    span = lambda p, s: F.sequence(F.floor(F.col(p) / cell), F.floor((F.col(p) + F.col(s)) / cell))
    b = grown.withColumn("cx", F.explode(span("_x", "_w"))).withColumn("cy", F.explode(span("_y", "_h"))).drop("_x", "_y", "_w", "_h").alias("b")
    for k in [*keys, "cx", "cy"]:
        test = test & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, test, how)


def overlapping(boxes: DataFrame, keys: list[str], key: str = "box_id", strict: bool = True) -> DataFrame:
    """Pairs of the same table that overlap: keys, a_id, b_id, once for each pair."""
    pairs = grid_join(boxes, boxes, keys, overlap("a", "b", strict) & (F.col(f"a.{key}") < F.col(f"b.{key}")))
    return pairs.select(*(F.col(f"a.{k}") for k in keys), F.col(f"a.{key}").alias("a_id"), F.col(f"b.{key}").alias("b_id"))


def within(left: DataFrame, right: DataFrame, keys: list[str], distance: int, more: Column | None = None, cell: int = 1000) -> DataFrame:
    """Pairs a, b whose rectangles are less than distance apart. Cells twice as wide as a long distance keep the left side's copies few."""
    test = gap_squared("a", "b") < distance * distance
    return grid_join(left, right, keys, test if more is None else test & more, cell=max(cell, 2 * distance), pad=distance)


def near_each_other(shapes: DataFrame, keys: list[str], distance: int, more: Column, cell: int = 1000) -> DataFrame:
    """As within for a table and itself, where `more` asks the same of both sides: each is grown by half the distance, so that one shuffle
    serves both. No side is broadcast: a file looks far smaller than its shapes in all their cells."""
    shapes, half = graph.spread(shapes), distance / 2
    return grid_join(shapes, shapes, keys, (gap_squared("a", "b") < distance * distance) & more, max(cell, 2 * distance), half, right_pad=half)


def points(df: DataFrame) -> DataFrame:
    """Points as rectangles without extent."""
    return df.withColumn("w", F.lit(0)).withColumn("h", F.lit(0))


def exits_by_plan(exits: DataFrame) -> DataFrame:
    return exits.groupBy("plan_id").agg(F.collect_list(F.struct("x", "y", "exit_id")).alias("_exits"))


def best_exit() -> Column:
    """struct(d2, exit_id) of the nearest of _exits to a rectangle's centre."""
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    return F.array_min(F.transform("_exits", lambda e: F.struct((F.pow(e["x"] - cx, 2) + F.pow(e["y"] - cy, 2)).alias("d2"), e["exit_id"].alias("exit_id"))))


def nearest_exit(boxes: DataFrame, exits: DataFrame) -> DataFrame:
    """boxes with the distance of their centre from the plan's nearest exit (ties: the smallest id); null without exits.

    A plan has few exits: they are gathered by plan, so the join is an equi-join of one row for each plan."""
    joined = boxes.join(exits_by_plan(exits), "plan_id", "left").withColumn("_best", best_exit())
    return joined.withColumn("exit_id", F.col("_best.exit_id")).withColumn("distance", F.sqrt("_best.d2")).drop("_exits", "_best")


def nearest(sources: DataFrame, key: str, shapes: DataFrame, keys: list[str], squared: Column, reach: int = 500, more: Column | None = None) -> DataFrame:
    """keys, key, d2: for each point of sources(keys, key, x, y) the least of `squared` (over aliases a: the point, b: a shape with its
    rectangle) among the shapes of its keys (that pass `more`: there must be one for each point); points whose keys have no shape are left out.

    Points look within reach by grid cells; those that find nothing look on with four times the reach. A point is done once it has found a
    shape within the reach looked at, as nothing outside can be nearer, so pairs stay few however many shapes a plan has."""
    some = points(sources) if more is not None else points(sources).join(shapes.select(*keys).distinct(), keys, "left_semi")
    some = graph.cut(some.select(*keys, key, "x", "y", "w", "h"))
    done = None
    while True:
        test = squared < reach * reach
        near = grid_join(some, shapes, keys, test if more is None else test & more, cell=max(1000, 4 * reach), pad=reach)
        found = graph.cut(near.groupBy(*(F.col(f"a.{k}").alias(k) for k in [*keys, key])).agg(F.min(squared).alias("d2")))
        done = found if done is None else done.unionByName(found)
        some = graph.cut(some.join(found, [*keys, key], "left_anti"))
        if some.isEmpty():
            return done
        reach *= 4
