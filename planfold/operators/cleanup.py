"""Clean-up of a finished layout: corridors first, then the boxes that what is left of them leaves room for. Centimetres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planfold.functions.geometry import point_segment_squared, seldom
from planfold.operators import graph, spans, spatial

#: Corridor width and wall clearance of a layout, from which the others follow.
WIDTH, CLEARANCE = 120, 10
GUARD, ENTRANCE_PAD, LEAST_COMPONENT, JOIN = max(3, min(22, 0.18 * WIDTH)), max(24, 0.26 * WIDTH), max(180, 1.5 * WIDTH), max(8, 0.1 * WIDTH)
#: Side of the cells in which boxes meet walls, zones, entrances and corridors.
CELL = 2000
#: Reasons in the order in which they count.
CORRIDOR_REASONS = ["small", "bounds", "wall", "obstacle", "conflict", "unreachable"]
BOX_REASONS = ["bounds", "wall", "obstacle", "corridor", "overlap"]


def _c(t: str, n: str) -> Column:
    return F.col(f"{t}.{n}")


def _overlap(a: str, b: str, inset: float = 0) -> Column:
    """Do rectangles overlap by more than inset on both axes?"""
    side = lambda p, s: (_c(a, p) < _c(b, p) + _c(b, s) - inset) & (_c(a, p) + _c(a, s) > _c(b, p) + inset)
    return side("x", "w") & side("y", "h")


def _segment_meets(s: str, x: Column, y: Column, x2: Column, y2: Column) -> Column:
    """Does the segment x1, y1, x2, y2 of s meet a rectangle (edges included)? The part of it that lies between both sides of each axis."""
    low, high = F.lit(0.0), F.lit(1.0)
    outside = F.lit(False)
    for p, a, b in (("x", x, x2), ("y", y, y2)):
        from_, d = _c(s, f"{p}1"), _c(s, f"{p}2") - _c(s, f"{p}1")
        flat = F.abs(d) < 1e-8
        outside = outside | (flat & ((from_ < a) | (from_ > b)))
        d = F.when(~flat, d)
        ta, tb = (a - from_) / d, (b - from_) / d
        low, high = F.greatest(low, F.least(ta, tb)), F.least(high, F.greatest(ta, tb))
    return ~outside & (low <= high)


def _wall_boxes(walls: DataFrame) -> DataFrame:
    d = lambda c: F.col(c).cast("double").alias(c)
    return walls.select("plan_id", F.least("x1", "x2").alias("x"), F.least("y1", "y2").alias("y"), F.abs(F.col("x2") - F.col("x1")).alias("w"), F.abs(F.col("y2") - F.col("y1")).alias("h"), d("x1"), d("y1"), d("x2"), d("y2"))


def _meet(a: str, b: str, more: float = 1) -> Column:
    """Do rectangles come within more of each other on both axes? Tested before what costs more, for all that can pass."""
    return _overlap(a, b, -more)


def _centreline(t: str) -> list[Column]:
    """x1, y1, x2, y2 along the longer side."""
    flat, mid = _c(t, "w") >= _c(t, "h"), lambda p, s: _c(t, p) + _c(t, s) / 2
    pick = lambda a, b: F.when(flat, a).otherwise(b)
    return [pick(_c(t, "x"), mid("x", "w")), pick(mid("y", "h"), _c(t, "y")), pick(_c(t, "x") + _c(t, "w"), mid("x", "w")), pick(mid("y", "h"), _c(t, "y") + _c(t, "h"))]


def _crosses(t: str, s: str) -> Column:
    """Does the wall s cross the centreline of t away from the ends of both (between 1 % and 99 %)?"""
    x1, y1, x2, y2 = _centreline(t)
    rx, ry, sx, sy = x2 - x1, y2 - y1, _c(s, "x2") - _c(s, "x1"), _c(s, "y2") - _c(s, "y1")
    d = rx * sy - ry * sx
    d = F.when(F.abs(d) >= 1e-6, d)
    qx, qy = _c(s, "x1") - x1, _c(s, "y1") - y1
    inner = lambda v: (v > 0.01) & (v < 0.99)
    return F.coalesce(inner((qx * sy - qy * sx) / d) & inner((qx * ry - qy * rx) / d), F.lit(False))


def _ids(pairs: DataFrame, name: str, key: str = "id") -> DataFrame:
    return pairs.select(_c("a", key).alias(key)).distinct().withColumn(name, F.lit(True))


def _flagged(df: DataFrame, **pairs: DataFrame) -> DataFrame:
    """df(id, ...) with a column for each of the pairs(a, b): is the row in one as a? All of them are gathered in one aggregate."""
    hits = None
    for name, p in pairs.items():
        one = p.select(_c("a", "id").alias("id"), F.lit(name).alias("_flag"))
        hits = one if hits is None else hits.unionByName(one)
    return df.join(hits.groupBy("id").agg(*(F.bool_or(F.col("_flag") == name).alias(name) for name in pairs)), "id", "left")


def _conflict() -> Column:
    """Corridors of one direction on about one line that share 45 % of the shorter one."""
    flat = lambda t: _c(t, "w") >= _c(t, "h")

    def on(p, s, q, r):
        near = F.abs(_c("a", p) + _c("a", s) / 2 - _c("b", p) - _c("b", s) / 2) <= F.greatest(F.lit(3.0), F.least(_c("a", s), _c("b", s)) * 0.45)
        common = F.least(_c("a", q) + _c("a", r), _c("b", q) + _c("b", r)) - F.greatest(_c("a", q), _c("b", q))
        return near & (common > 0) & (common >= F.least(_c("a", r), _c("b", r)) * 0.45)

    return (flat("a") == flat("b")) & F.when(flat("a"), on("y", "h", "x", "w")).otherwise(on("x", "w", "y", "h"))


def _judged(df: DataFrame, reasons: dict[str, Column], out: str = "reason") -> DataFrame:
    return df.withColumn(out, F.coalesce(*(F.when(F.coalesce(test, F.lit(False)), name) for name, test in reasons.items())))


def cleaned_corridors(plans: DataFrame, corridors: DataFrame, walls: DataFrame, zones: DataFrame, entrances: DataFrame, retain: bool = False) -> DataFrame:
    """Parts of corridors (cut by walls) with the reason why they go, null for those that stay: plan_id, corridor_id, part, x, y, w, h, reason.

    A part goes if it is too small, leaves the bounds, crosses a wall, meets a zone, or lies along one that is kept and comes before it (by
    corridor_id and part). Of the others, unless all are retained, components of connected parts stay that touch an entrance or are
    LEAST_COMPONENT long; in plans where none touches one, those long enough or of several parts, and else the longest."""
    parts = spans.split_corridors(corridors, walls, CLEARANCE, max(60, 0.75 * WIDTH)).withColumn("id", F.concat_ws("/", F.lpad(F.col("corridor_id").cast("string"), 20, "0"), F.lpad(F.col("part").cast("string"), 6, "0")))
    parts = graph.cut(parts.join(plans, "plan_id"))
    crossed = spatial.grid_join(parts, _wall_boxes(walls), ["plan_id"], _meet("a", "b") & seldom(_crosses("a", "b") & _segment_meets("b", _c("a", "x"), _c("a", "y"), _c("a", "x") + _c("a", "w"), _c("a", "y") + _c("a", "h"))))
    hit = spatial.grid_join(parts, zones, ["plan_id"], _overlap("a", "b"))
    out = (F.col("x") < F.col("min_x")) | (F.col("y") < F.col("min_y")) | (F.col("x") + F.col("w") > F.col("max_x")) | (F.col("y") + F.col("h") > F.col("max_y"))
    first = graph.cut(_judged(_flagged(parts, _wall=crossed, _zone=hit), {"small": (F.col("w") < 5) | (F.col("h") < 5), "bounds": out, "wall": F.col("_wall"), "obstacle": F.col("_zone")}, "_first").drop("_wall", "_zone", "min_x", "min_y", "max_x", "max_y"))
    live = first.where("_first is null").withColumn("flat", F.col("w") >= F.col("h"))
    pairs = spatial.grid_join(live, live, ["plan_id", "flat"], _overlap("a", "b") & (_c("a", "id") < _c("b", "id")) & seldom(_conflict()))
    kept = graph.cut(live.drop("flat").join(graph.dropped_in_order(_by_id(pairs)), "id", "left_anti"))
    if not retain:
        reached = _reachable(kept, entrances)
        kept_ids = reached.withColumn("_kept", F.lit(True))
    else:
        kept_ids = kept.select("id").withColumn("_kept", F.lit(True))
    j = first.join(kept.select("id", F.lit(True).alias("_apart")), "id", "left").join(kept_ids, "id", "left")
    reason = F.coalesce("_first", F.when(F.col("_apart").isNull(), "conflict"), F.when(F.col("_kept").isNull(), "unreachable"))
    return j.select("plan_id", "corridor_id", "part", "x", "y", "w", "h", reason.alias("reason"))


def _by_id(pairs: DataFrame) -> DataFrame:
    """Conflicts a, b with their places: the ids themselves."""
    return pairs.select(*(_c(t, "id").alias(k) for k, t in (("a", "a"), ("b", "b"), ("pa", "a"), ("pb", "b"))))


def _reachable(parts: DataFrame, entrances: DataFrame) -> DataFrame:
    """Ids of the parts in components that stay."""
    line = dict(zip(("x1", "y1", "x2", "y2"), _centreline("p"), strict=True))
    lines = graph.cut(parts.alias("p").select("p.id", "p.plan_id", "p.x", "p.y", "p.w", "p.h", *(v.cast("double").alias(k) for k, v in line.items())))
    ends = lambda t: [_c(t, k) for k in line]
    near = lambda t, i, s: point_segment_squared(ends(t)[i], ends(t)[i + 1], *ends(s)) <= JOIN * JOIN
    joined = _overlap("a", "b") | seldom(near("a", 0, "b") | near("a", 2, "b") | near("b", 0, "a") | near("b", 2, "a"))
    # a centreline lies in its rectangle: only rectangles that come within JOIN can be joined
    pairs = spatial.grid_join(lines, lines, ["plan_id"], (_c("a", "id") < _c("b", "id")) & _meet("a", "b", JOIN + 1) & joined, pad=int(JOIN) + 1)
    links = pairs.select(_c("a", "id").alias("a"), _c("b", "id").alias("b"))
    found = graph.components(parts.select("id"), links)
    at = spatial.grid_join(lines, entrances, ["plan_id"], _meet("a", "b") & (_overlap("a", "b") | seldom(_segment_meets("a", _c("b", "x"), _c("b", "y"), _c("b", "x") + _c("b", "w"), _c("b", "y") + _c("b", "h")))))
    j = parts.select("id", "plan_id", F.greatest("w", "h").alias("length")).join(found, "id").join(_ids(at, "_seed"), "id", "left")
    by = graph.cut(j.groupBy("plan_id", "component").agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or("_seed"), F.lit(False)).alias("seeded")))
    return j.join(kept_components(by, LEAST_COMPONENT).select("component"), "component", "left_semi").select("id")


def kept_components(by: DataFrame, least: float) -> DataFrame:
    """by(plan_id, component, length, n, seeded, ...): the rows that stay. In plans with a seeded component those that are seeded or at least as long;
    in others those long enough or of several parts, and where there is none the longest (of equal ones the last by name)."""
    long_enough = F.col("length") >= least
    plan = by.groupBy("plan_id").agg(F.bool_or("seeded").alias("_any_seed"), F.max(F.struct("length", "component")).alias("_longest"), F.bool_or(long_enough | (F.col("n") > 1)).alias("_any_long"))
    stays = F.when(F.col("_any_seed"), F.col("seeded") | long_enough).when(F.col("_any_long"), long_enough | (F.col("n") > 1)).otherwise(F.col("component") == F.col("_longest.component"))
    return by.join(plan, "plan_id").where(stays).select(*by.columns)


def cleaned_boxes(plans: DataFrame, boxes: DataFrame, corridors: DataFrame, walls: DataFrame, zones: DataFrame, entrances: DataFrame) -> DataFrame:
    """Boxes with the reason why they go, null for those that stay: plan_id, floor_level, box_id, reason.

    corridors: those that stay. A box goes if it comes within CLEARANCE of the bounds or a wall, meets a zone or the surroundings of an
    entrance, reaches 2 cm into a corridor less its guard, or 2 cm into a box of its floor that is kept and comes before it (by box_id)."""
    b = graph.cut(boxes.select("plan_id", "floor_level", "box_id", "x", "y", "w", "h").join(plans.select("plan_id", "min_x", "min_y", "max_x", "max_y"), "plan_id").withColumn("id", F.col("box_id")))
    rect = lambda more: (_c("a", "x") - more, _c("a", "y") - more, _c("a", "x") + _c("a", "w") + more, _c("a", "y") + _c("a", "h") + more)
    # all four joins send the boxes to the same cells, with the longest reach: they share one shuffle
    meets = lambda others, test: spatial.grid_join(b, others, ["plan_id"], test, CELL, int(max(CLEARANCE, ENTRANCE_PAD)) + 1)
    walled = meets(_wall_boxes(walls), _meet("a", "b", CLEARANCE + 1) & seldom(_segment_meets("b", *rect(CLEARANCE))))
    hit = meets(zones, _overlap("a", "b"))
    at = meets(entrances, _overlap("a", "b", -ENTRANCE_PAD))
    inner = lambda s: F.greatest(F.lit(0.0), F.col(s) - 2 * GUARD)
    thin = (inner("w") <= 0) | (inner("h") <= 0)
    guarded = corridors.select("plan_id", *(F.when(thin, F.col(p)).otherwise(F.col(p) + GUARD).alias(p) for p in "xy"), *(F.when(thin, F.col(s)).otherwise(inner(s)).alias(s) for s in "wh"))
    on = meets(guarded, _overlap("a", "b", 2))
    out = (F.col("x") < F.col("min_x") + CLEARANCE) | (F.col("x") + F.col("w") > F.col("max_x") - CLEARANCE) | (F.col("y") < F.col("min_y") + CLEARANCE) | (F.col("y") + F.col("h") > F.col("max_y") - CLEARANCE)
    first = graph.cut(_judged(_flagged(b, _wall=walled, _zone=hit, _exit=at, _corridor=on), {"bounds": out, "wall": F.col("_wall"), "obstacle": F.col("_zone") | F.col("_exit"), "corridor": F.col("_corridor")}).select("plan_id", "floor_level", "box_id", "id", "x", "y", "w", "h", "reason"))
    live = first.where("reason is null")
    pairs = spatial.grid_join(live, live, ["plan_id", "floor_level"], (_c("a", "id") < _c("b", "id")) & _overlap("a", "b", 2))
    dropped = graph.dropped_in_order(_by_id(pairs)).withColumn("_dropped", F.lit(True))
    return first.join(dropped, "id", "left").select("plan_id", "floor_level", "box_id", F.coalesce("reason", F.when(F.col("_dropped"), "overlap")).alias("reason"))


def cleaned_layout(plans: DataFrame, boxes: DataFrame, corridors: DataFrame, walls: DataFrame, zones: DataFrame, entrances: DataFrame, retain: bool = False) -> DataFrame:
    """Counts of each plan: corridors, parts, those that stay and those that go by reason; boxes likewise."""
    c = graph.cut(cleaned_corridors(plans, corridors, walls, zones, entrances, retain))
    b = cleaned_boxes(plans, boxes, c.where("reason is null"), walls, zones, entrances)
    n = lambda test, name: F.count(F.when(test, 1)).alias(name)
    by_c = c.groupBy("plan_id").agg(F.count(F.lit(1)).alias("parts"), n(F.col("reason").isNull(), "corridors_kept"), *(n(F.col("reason") == r, f"corridor_{r}") for r in CORRIDOR_REASONS))
    by_b = b.groupBy("plan_id").agg(F.count(F.lit(1)).alias("boxes"), n(F.col("reason").isNull(), "boxes_kept"), *(n(F.col("reason") == r, f"box_{r}") for r in BOX_REASONS))
    whole = corridors.groupBy("plan_id").agg(F.count(F.lit(1)).alias("corridors"))
    j = plans.select("plan_id").join(whole, "plan_id", "left").join(by_c, "plan_id", "left").join(by_b, "plan_id", "left").fillna(0)
    return j.withColumn("corridors_removed", F.greatest(F.lit(0).cast("long"), F.col("corridors") - F.col("corridors_kept"))).withColumn("boxes_removed", F.col("boxes") - F.col("boxes_kept"))
