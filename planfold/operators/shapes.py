"""Walls, corridors and arrows as drawn: rectangles of segments, crossings, doors, clean-up of loose records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planfold.functions import geometry
from planfold.operators import spatial

#: Widths between parallel walls (centimetres) that may be doors, and the angle (degrees) up to which walls are parallel.
DOOR_GAP, PARALLEL = (80, 250), 5
DOOR_LAYERS = "DOOR|PORTE|OUVERTURE"


def as_rectangles(walls: DataFrame) -> DataFrame:
    """walls(x1, y1, x2, y2) with x, y, w, h: the rectangle around each."""
    low = lambda p: F.least(f"{p}1", f"{p}2")
    return walls.withColumns({"x": low("x"), "y": low("y"), "w": F.abs(F.col("x2") - F.col("x1")), "h": F.abs(F.col("y2") - F.col("y1"))})


def across_walls(corridors: DataFrame, walls: DataFrame) -> DataFrame:
    """Corridors whose centreline crosses walls: plan_id, corridor_id, walls (how many), first_wall."""
    pairs = spatial.grid_join(corridors, as_rectangles(walls), ["plan_id"], geometry.overlap("a", "b", strict=False))
    x, y, w, h = (F.col(f"a.{c}") for c in "xywh")
    flat = w >= h
    ends = ((F.when(flat, x).otherwise(x + w / 2), F.when(flat, y + h / 2).otherwise(y)), (F.when(flat, x + w).otherwise(x + w / 2), F.when(flat, y + h / 2).otherwise(y + h)))
    hit = geometry.segments_cross(*ends, (F.col("b.x1"), F.col("b.y1")), (F.col("b.x2"), F.col("b.y2")))
    return pairs.where(hit).groupBy(F.col("a.plan_id").alias("plan_id"), "corridor_id").agg(F.count(F.lit(1)).alias("walls"), F.min("wall_id").alias("first_wall"))


def doors_between_walls(walls: DataFrame) -> DataFrame:
    """Pairs of parallel walls with a gap in DOOR_GAP (least distance of an end of the first from the second) and the corners of the
    door between their middles."""
    c = lambda t, n: F.col(f"{t}.{n}")
    # a wall's direction is computed once, not once a pair
    w = as_rectangles(walls).withColumn("angle", F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))))
    turn = F.abs(c("a", "angle") - c("b", "angle"))
    parallel = (turn < PARALLEL) | (F.abs(turn - 180) < PARALLEL)
    # a small table has few partitions, its pairs are many: they are dealt out before they are formed
    dealt = w.repartition(4 * w.sparkSession.sparkContext.defaultParallelism, "plan_id", "wall_id")
    pairs = spatial.within(dealt, w, ["plan_id"], DOOR_GAP[1], (c("a", "wall_id") < c("b", "wall_id")) & parallel)
    far = lambda k: geometry.point_segment_squared(c("a", f"x{k}"), c("a", f"y{k}"), *(c("b", n) for n in ("x1", "y1", "x2", "y2")))
    mid = lambda t, p: (c(t, f"{p}1") + c(t, f"{p}2")) / 2
    gap = geometry.once(F.sqrt(F.least(far(1), far(2))), lambda g: F.when((g > DOOR_GAP[0]) & (g < DOOR_GAP[1]), g))
    out = pairs.withColumn("gap", gap).where("gap is not null")
    half = F.col("gap") / 2
    return out.select(c("a", "plan_id").alias("plan_id"), c("a", "wall_id").alias("a_id"), c("b", "wall_id").alias("b_id"), "gap", (mid("a", "x") - half).alias("x1"), (mid("a", "y") - half).alias("y1"), (mid("b", "x") + half).alias("x2"), (mid("b", "y") + half).alias("y2"))


def door_candidates(entities: DataFrame) -> DataFrame:
    """entities(kind, layer, x, y, radius, start_angle, end_angle, x2, y2): arcs and lines on door layers, with their end points and
    width. Angles are degrees; an end angle of 0 or null means 90."""
    on_doors = entities.withColumn("layer", F.upper(F.coalesce("layer", F.lit("")))).where(F.col("layer").rlike(DOOR_LAYERS) & F.col("kind").isin("ARC", "LINE"))
    arc = F.col("kind") == "ARC"
    start, end = F.radians(F.coalesce("start_angle", F.lit(0))), F.radians(F.coalesce(F.nullif(F.col("end_angle"), F.lit(0)), F.lit(90)))
    on = lambda p, turn, angle: F.col(p) + F.col("radius") * turn(angle)
    points = {"x1": F.when(arc, on("x", F.cos, start)).otherwise(F.col("x")), "y1": F.when(arc, on("y", F.sin, start)).otherwise(F.col("y")), "x3": F.when(arc, on("x", F.cos, end)).otherwise(F.col("x2")), "y3": F.when(arc, on("y", F.sin, end)).otherwise(F.col("y2"))}
    width = F.when(arc, F.col("radius") * 2.0).otherwise(F.sqrt(F.pow(F.col("x2") - F.col("x"), 2) + F.pow(F.col("y2") - F.col("y"), 2)))
    return on_doors.withColumns({**points, "width": width}).drop("x2", "y2").withColumnsRenamed({"x3": "x2", "y3": "y2"})


def _whole(points: Column) -> Column:
    return F.filter(points, lambda p: p.isNotNull() & (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())


def sanitised_corridors(corridors: DataFrame) -> DataFrame:
    """corridors(polygon, path, x, y, width, height, area) in one of three forms, loose points left out; form is polygon (three points
    drawn, one left at least), path (two points left) or rectangle (all four numbers). Others are dropped. Missing numbers of polygons
    come from their first sides."""
    polygon, path = _whole(F.col("polygon")), _whole(F.col("path"))
    drawn = F.coalesce(F.size("polygon") >= 3, F.lit(False))
    along = F.coalesce(F.size("path") > 0, F.lit(False))
    numbers = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("width").isNotNull() & F.col("height").isNotNull()
    form = F.when(drawn, F.when(F.size(polygon) > 0, "polygon")).when(along, F.when(F.size(path) >= 2, "path")).when(numbers, "rectangle")
    out = corridors.withColumn("form", form).where("form is not null").withColumns({"polygon": F.when(F.col("form") == "polygon", polygon), "path": F.when(F.col("form") == "path", path)})
    side = lambda i, k: F.coalesce(F.abs(F.get(F.get("polygon", F.lit(i)), F.lit(k)) - F.get(F.get("polygon", F.lit(i - 1)), F.lit(k))), F.lit(0.0))
    rule = lambda c, of_polygon, of_rectangle: F.when(F.col("form") == "polygon", F.coalesce(c, of_polygon)).when(F.col("form") == "rectangle", F.coalesce(c, of_rectangle)).otherwise(F.col(c))
    zero = F.lit(0.0)
    return out.withColumns({"x": rule("x", zero, zero), "y": rule("y", zero, zero), "area": rule("area", zero, F.col("width") * F.col("height")), "width": rule("width", side(1, 0), zero), "height": rule("height", side(2, 1), zero)})


def sanitised_arrows(arrows: DataFrame) -> DataFrame:
    """Arrows with both coordinates, the rest filled: direction in lower case (right), type, colour, size and height."""
    filled = {"z": F.coalesce("z", F.lit(0.0)), "direction": F.coalesce(F.lower("direction"), F.lit("right")), "type": F.coalesce("type", F.lit("corridor_flow")), "color": F.coalesce("color", F.lit("green")), "size": F.coalesce("size", F.lit("medium"))}
    return arrows.where("x is not null and y is not null").withColumns(filled)


def decomposed(corridors: DataFrame, width: float) -> DataFrame:
    """corridors(corridor_id, corners: array<struct<x, y>> or null for plain ones, x, y, w, h) -> corridor_id, part (none, h, v), x, y, w, h:
    an L-shaped corridor (four corners or more) gives a horizontal part along its lowest line and a vertical one along its right-most."""
    of = lambda k: F.array_sort(F.array_distinct(F.transform("corners", lambda c: c[k])))
    bent = F.coalesce((F.size("corners") >= 4) & (F.size(of("x")) >= 2) & (F.size(of("y")) >= 2), F.lit(False))
    first, last = (lambda k: F.array_min(of(k))), (lambda k: F.array_max(of(k)))
    rect = lambda part, x, y, w, h: F.struct(F.lit(part).alias("part"), *(c.cast("double").alias(n) for n, c in (("x", x), ("y", y), ("w", w), ("h", h))))
    wide = F.lit(float(width))
    split = F.array(rect("h", first("x"), first("y"), last("x") - first("x"), wide), rect("v", last("x"), first("y"), wide, last("y") - first("y")))
    return corridors.select("corridor_id", F.inline(F.when(bent, split).otherwise(F.array(rect("", *(F.col(c) for c in "xywh"))))))


def trimmed_bounds(plans: DataFrame, points: DataFrame, trim: float = 0.01, pad: float = 0.012, least: float = 3, coverage: float = 0.22) -> DataFrame:
    """points(plan_id, x, y) -> plan_id, min_x, min_y, max_x, max_y: exact bounds of the points without a share at both ends of each axis,
    grown by a share of their size. The plan's own bounds take their place under eight points, without extent, or where the trimmed ones
    cover too little of them (unless those are over 1.6 times as large across).

    Equal coordinates are counted together, so that running counts go over distinct values."""
    axes = points.select("plan_id", F.inline(F.array(F.struct(F.lit("x").alias("axis"), F.col("x").cast("double").alias("c")), F.struct(F.lit("y").alias("axis"), F.col("y").cast("double").alias("c")))))
    values = axes.groupBy("plan_id", "axis", "c").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("plan_id", "axis")
    values = values.withColumns({"upto": F.sum("k").over(w.orderBy("c")), "n": F.sum("k").over(w)})
    low = F.floor(F.col("n") * trim)
    high = F.least(F.greatest(low + 1, F.ceil(F.col("n") * (1 - trim)) - 1), F.col("n") - 1)
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("c")))
    ends = values.groupBy("plan_id", "axis").agg(at(low).alias("lo"), at(high).alias("hi"), F.max("n").alias("n"))
    by = ends.groupBy("plan_id").agg(F.max("n").alias("n"), *(F.max(F.when(F.col("axis") == a, F.col(c))).alias(f"{c}_{a}") for a in "xy" for c in ("lo", "hi")))
    j = plans.select("plan_id", "min_x", "min_y", "max_x", "max_y").join(by, "plan_id", "left")
    for a in "xy":
        grow = F.greatest(F.lit(float(least)), (F.col(f"hi_{a}") - F.col(f"lo_{a}")) * pad)
        j = j.withColumns({f"t_min_{a}": F.col(f"lo_{a}") - grow, f"t_max_{a}": F.col(f"hi_{a}") + grow})
    own, new = {a: F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xy"}, {a: F.col(f"t_max_{a}") - F.col(f"t_min_{a}") for a in "xy"}
    thin = (new["x"] / own["x"] < coverage) | (new["y"] / own["y"] < coverage)
    back = (F.coalesce("n", F.lit(0)) < 8) | (F.col("hi_x") <= F.col("lo_x")) | (F.col("hi_y") <= F.col("lo_y")) | (thin & (F.hypot(own["x"], own["y"]) <= 1.6 * F.hypot(new["x"], new["y"])))
    return j.select("plan_id", *(F.when(back, F.col(c)).otherwise(F.col(f"t_{c}")).cast("double").alias(c) for c in ("min_x", "min_y", "max_x", "max_y")))


def sanitized(boxes: DataFrame, plans: DataFrame, least: int = 50) -> DataFrame:
    """boxes(plan_id, box_id, x, y, cx, cy, w, h) clipped to their plan's bounds: plan_id, box_id, x, y, w, h. A box without x or y takes its centre
    for both; one without either, outside of the bounds, or left with a side under `least` goes. Sides that are null or 0 count as a metre."""
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    b = boxes.withColumns({"_x": F.when(placed, F.col("x")).otherwise(F.col("cx")), "_y": F.when(placed, F.col("y")).otherwise(F.col("cy"))}).where("_x is not null and _y is not null")
    side = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(100))
    b = b.withColumns({"_w": side("w"), "_h": side("h")}).join(plans.select("plan_id", "min_x", "min_y", "max_x", "max_y"), "plan_id")
    b = b.where("_x + _w >= min_x and _x <= max_x and _y + _h >= min_y and _y <= max_y")
    low = lambda p: F.greatest(F.col(f"_{p}"), F.col(f"min_{p}"))
    high = lambda p, s: F.least(F.col(f"_{p}") + F.col(f"_{s}"), F.col(f"max_{p}"))
    out = b.select("plan_id", "box_id", low("x").alias("x"), low("y").alias("y"), (high("x", "w") - low("x")).alias("w"), (high("y", "h") - low("y")).alias("h"))
    return out.where((F.col("w") >= least) & (F.col("h") >= least))


def perimeter_walls(walls: DataFrame, plans: DataFrame, tolerance: int = 50) -> DataFrame:
    """Walls both of whose ends are less than tolerance from one side of their plan's bounds, with that side (left, right, bottom, top: the first)."""
    near = lambda p, o: (F.abs(F.col(f"{p}1") - F.col(o)) < tolerance) & (F.abs(F.col(f"{p}2") - F.col(o)) < tolerance)
    side = F.when(near("x", "min_x"), "left").when(near("x", "max_x"), "right").when(near("y", "min_y"), "bottom").when(near("y", "max_y"), "top")
    return walls.join(plans.select("plan_id", "min_x", "min_y", "max_x", "max_y"), "plan_id").withColumn("side", side).where("side is not null").select(*walls.columns, "side")


def synthetic_envelopes(envelope: DataFrame, plans: DataFrame, tolerance: int = 20) -> DataFrame:
    """plan_id, edges, aligned, synthetic: envelopes(plan_id, x1, y1, x2, y2) of four to eight edges, at least four of which lie on the bounds, were
    probably drawn from the bounds."""
    on = lambda p, o: (F.abs(F.col(f"{p}1") - F.col(o)) <= tolerance) & (F.abs(F.col(f"{p}2") - F.col(o)) <= tolerance)
    aligned = on("x", "min_x") | on("x", "max_x") | on("y", "min_y") | on("y", "max_y")
    e = envelope.join(plans.select("plan_id", "min_x", "min_y", "max_x", "max_y"), "plan_id").groupBy("plan_id").agg(F.count(F.lit(1)).alias("edges"), F.count(F.when(aligned, 1)).alias("aligned"))
    return e.withColumn("synthetic", F.col("edges").between(4, 8) & (F.col("aligned") >= 4))


def path_arrows(lines: DataFrame, key: str, spacing: float = 300, length: float = 200) -> DataFrame:
    """lines(key, points array<struct<x, y>>) -> key, arrow (from 0), x, y, angle (radians), path_length: arrows along each polyline, the first half a spacing
    from its start and none that would reach over the end. An arrow is `length` or 60 % of a short path; a path too short for two has one in
    its middle, if it is longer than the arrow. Points that repeat make no segment.

    Segments carry the length before them, so each arrow is placed by the one segment that holds its distance."""
    p = lines.select(key, F.posexplode("points").alias("i", "p"))
    following = Window.partitionBy(key).orderBy("i")
    s = p.withColumn("q", F.lead("p").over(following)).where("q is not null")
    s = s.withColumns({"dx": (F.col("q.x") - F.col("p.x")).cast("double"), "dy": (F.col("q.y") - F.col("p.y")).cast("double")}).withColumn("n", F.hypot("dx", "dy")).where("n > 0")
    s = s.withColumn("upto", F.sum("n").over(following.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("path_length", F.sum("n").over(Window.partitionBy(key))).withColumn("before", F.col("upto") - F.col("n"))
    whole, arrow = F.col("path_length"), F.least(F.lit(float(length)), F.col("path_length") * 0.6)
    short = whole < spacing + arrow
    first = F.when(short & (whole > arrow), whole / 2).otherwise(spacing / 2)
    last = F.least(whole - arrow * 0.5, F.when(short, first).otherwise(whole))
    # the arrows whose distance lies on this segment: behind its start (the path's start counts) and up to its end
    low = F.when(F.col("before") > 0, F.floor((F.col("before") - first) / spacing) + 1).otherwise(0).cast("long")
    high = F.floor((F.least("upto", last) - first) / spacing).cast("long")
    s = s.withColumns({"_first": first, "_low": F.greatest(F.lit(0).cast("long"), low), "_high": high}).where("_high >= _low")
    s = s.withColumn("arrow", F.explode(F.sequence("_low", "_high"))).withColumn("_t", (F.col("_first") + F.col("arrow") * spacing - F.col("before")) / F.col("n"))
    s = s.where((F.col("_first") + F.col("arrow") * spacing) < whole)
    return s.select(key, "arrow", (F.col("p.x") + F.col("_t") * F.col("dx")).alias("x"), (F.col("p.y") + F.col("_t") * F.col("dy")).alias("y"), F.atan2("dy", "dx").alias("angle"), "path_length")
