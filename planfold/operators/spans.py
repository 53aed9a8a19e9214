"""Intervals along an axis: merging, covering, what is free between blockers; aisles, split corridors and merged walls. Centimetres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planfold.operators import graph, spatial
from planfold.operators.rows import scanned


def merged(spans: DataFrame, keys: list[str], gap: float = 0) -> DataFrame:
    """spans(keys, lo, hi) -> the same, those at most gap apart merged. In order of lo a span opens an island if it begins beyond all ends
    before it."""
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    s = spans.select(*keys, "lo", "hi").withColumn("_seen", F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    opens = F.when(F.col("_seen").isNull() | (F.col("lo") > F.col("_seen") + gap), 1).otherwise(0)
    s = s.withColumn("_island", F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*keys, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def coverage(edges: DataFrame, spans: DataFrame, keys: list[str], edge: str, tolerance: float = 0.1, trivial: float = 10, share: float = 0.3) -> DataFrame:
    """edges(keys, edge, lo, hi) against merged spans(keys, lo, hi) -> keys, edge, covered (one span holds the edge with tolerance at both
    ends), ratio (length under spans), partly: ratio of share at least, or an edge under `trivial`."""
    on = (F.col("s.lo") <= F.col("e.hi")) & (F.col("s.hi") >= F.col("e.lo"))
    for k in keys:
        on = on & (F.col(f"e.{k}") == F.col(f"s.{k}"))
    j = edges.alias("e").join(spans.alias("s"), on, "left")
    holds = (F.col("s.lo") <= F.col("e.lo") - tolerance) & (F.col("s.hi") >= F.col("e.hi") + tolerance)
    common = F.when(F.col("s.lo").isNotNull(), F.greatest(F.lit(0), F.least("s.hi", "e.hi") - F.greatest("s.lo", "e.lo")))
    by = j.groupBy(*(F.col(f"e.{k}").alias(k) for k in keys), F.col(f"e.{edge}").alias(edge)).agg(F.coalesce(F.bool_or(holds), F.lit(False)).alias("covered"), F.coalesce(F.sum(common), F.lit(0)).alias("_sum"), F.max(F.col("e.hi") - F.col("e.lo")).alias("_len"))
    ratio = F.when(F.col("_len") > 0, F.col("_sum") / F.col("_len")).otherwise(1.0)
    return by.select(*keys, edge, "covered", ratio.alias("ratio"), ((F.col("_len") < trivial) | (ratio >= share)).alias("partly"))


def free(domains: DataFrame, blocked: DataFrame, keys: list[str], least: float, gap: float = 0, closed: bool = False) -> DataFrame:
    """domains(keys, ..., lo, hi), one for each key, less blocked(keys, lo, hi) -> the domains' columns with lo, hi of what is free and longer
    than least (closed: or as long). A domain without blockers is free as a whole, whatever its length. Domains are never broadcast: there may
    be many to each row of the file that they come from."""
    d = graph.spread(domains.select(*keys, F.col("lo").alias("_from"), F.col("hi").alias("_to")))
    inside = blocked.join(d, keys).select(*keys, F.greatest("lo", "_from").alias("lo"), F.least("hi", "_to").alias("hi")).where("hi > lo")
    blocks = merged(inside, keys, gap)
    before = F.lag("hi").over(Window.partitionBy(*keys).orderBy("lo"))
    spaces = blocks.select(*keys, before.alias("_a"), F.col("lo").alias("_b")).unionByName(blocks.groupBy(*keys).agg(F.max("hi").alias("_a")).withColumn("_b", F.lit(None)))
    long_enough = (F.col("_hi") - F.col("_lo") >= least) if closed else (F.col("_hi") - F.col("_lo") > least)
    j = domains.withColumnsRenamed({"lo": "_from", "hi": "_to"}).join(spaces, keys, "left")
    j = j.withColumn("_lo", F.coalesce("_a", "_from")).withColumn("_hi", F.coalesce("_b", "_to")).where((F.col("_a").isNull() & F.col("_b").isNull()) | long_enough)
    rest = [c for c in domains.columns if c not in ("lo", "hi")]
    return j.select(*rest, F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))


def aisles(plans: DataFrame, depth: float = 160, width: float = 70) -> DataFrame:
    """plans(plan_id, min_x, min_y, max_x, max_y) -> plan_id, aisle, y, h, below_y, above_y, row_h, lo, hi: a plan's height divided into equal
    strips of row, aisle and row; a plan too low for one (under 70 %) gets a single aisle at 40 % of its height."""
    strip = 2 * depth + width
    p = plans.withColumn("_high", (F.col("max_y") - F.col("min_y")).cast("double"))
    low = F.col("_high") < 0.7 * strip
    n = F.when(low, 1).otherwise(F.greatest(F.lit(1), F.floor(F.col("_high") / strip))).cast("long")
    p = p.withColumn("_n", n).withColumn("_each", F.col("_high") / n).withColumn("aisle", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    row = F.when(low, F.greatest(F.lit(50.0), (F.col("_high") - width) / 2)).otherwise(depth * F.col("_each") / strip)
    h = F.when(low, F.least(F.lit(float(width)), F.col("_high") - row)).otherwise(width * F.col("_each") / strip)
    below = F.when(low, F.col("min_y").cast("double")).otherwise(F.col("min_y") + F.col("aisle") * F.col("_each"))
    y = F.when(low, F.col("min_y") + 0.4 * F.col("_high")).otherwise(below + row)
    return p.select("plan_id", "aisle", "_n", "_each", y.alias("y"), h.alias("h"), below.alias("below_y"), (y + h).alias("above_y"), row.alias("row_h"), F.col("min_y").alias("_base"), F.col("min_x").cast("double").alias("lo"), F.col("max_x").cast("double").alias("hi"))


def aisle_shadows(plans: DataFrame, walls: DataFrame, obstacles: DataFrame, depth: float = 160, width: float = 70, box: float = 70, clearance: float = 5) -> DataFrame:
    """plan_id, aisle, y, h, below_y, above_y, row_h, lo, hi: stretches of each aisle that walls(plan_id, x1, y1, x2, y2) and obstacles(plan_id, x, y,
    w, h) leave free, if two boxes fit side by side.

    A wall that is twice as long across as it is high blocks its length unless it runs along the aisle's edge (30 cm); any other blocks where
    it crosses, unless it stands at the plan's side (50 cm). Blockers meet aisles by the strips that they reach, so a plan is many keys."""
    a = aisles(plans, depth, width)
    reach = a.groupBy("plan_id").agg(F.first("_base").alias("_base"), F.first("_each").alias("_each"), F.first("_n").alias("_n"))
    w = walls.select("plan_id", F.lit(True).alias("wall"), F.least("x1", "x2").alias("bx1"), F.greatest("x1", "x2").alias("bx2"), F.least("y1", "y2").alias("by1"), F.greatest("y1", "y2").alias("by2"))
    o = obstacles.select("plan_id", F.lit(False).alias("wall"), F.col("x").alias("bx1"), (F.col("x") + F.col("w")).alias("bx2"), F.col("y").alias("by1"), (F.col("y") + F.col("h")).alias("by2"))
    b = w.unionByName(o).join(reach, "plan_id")
    strip = lambda c, more: F.greatest(F.lit(0), F.least(F.col("_n") - 1, F.floor((F.col(c) - F.col("_base")) / F.col("_each")) + more)).cast("long")
    b = b.withColumn("aisle", F.explode(F.sequence(strip("by1", -1), strip("by2", 1))))
    j = b.join(graph.spread(a.drop("_base", "_each", "_n")), ["plan_id", "aisle"]).where((F.col("by2") >= F.col("y")) & (F.col("by1") <= F.col("y") + F.col("h")))
    flat = F.col("bx2") - F.col("bx1") > 2 * (F.col("by2") - F.col("by1"))
    mid_y, mid_x = (F.col("by1") + F.col("by2")) / 2, (F.col("bx1") + F.col("bx2")) / 2
    edge = (F.abs(mid_y - F.col("y") - F.col("h")) < 30) | (F.abs(mid_y - F.col("y")) < 30)
    side = (F.abs(mid_x - F.col("lo")) < 50) | (F.abs(mid_x - F.col("hi")) < 50)
    blocks = F.when(F.col("wall"), F.when(flat, ~edge).otherwise(~side)).otherwise((F.col("bx2") >= F.col("lo")) & (F.col("bx1") <= F.col("hi")))
    blocked = j.where(blocks).select("plan_id", "aisle", (F.col("bx1") - clearance).alias("lo"), (F.col("bx2") + clearance).alias("hi"))
    found = free(a.select("plan_id", "aisle", "y", "h", "below_y", "above_y", "row_h", "lo", "hi"), blocked, ["plan_id", "aisle"], box * 0.5, 1)
    return found.where(F.col("hi") - F.col("lo") >= 2 * box)


def split_corridors(corridors: DataFrame, walls: DataFrame, clearance: float = 10, least: float = 90) -> DataFrame:
    """corridors(plan_id, corridor_id, x, y, w, h) cut where walls cross their centreline -> plan_id, corridor_id, part, x, y, w, h. What is left
    between two walls stays if it is at least that long; a corridor that no wall crosses stays as it is. Walls may have any slope."""
    tolerance = max(2.0, clearance * 0.45)
    flat = F.col("w") >= F.col("h")
    lines = corridors.select("plan_id", "corridor_id", "x", "y", "w", "h", flat.alias("flat"))
    boxes = walls.select("plan_id", F.least("x1", "x2").alias("x"), F.least("y1", "y2").alias("y"), F.abs(F.col("x2") - F.col("x1")).alias("w"), F.abs(F.col("y2") - F.col("y1")).alias("h"), *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    pick = lambda a, b: F.when(F.col("a.flat"), F.col(a)).otherwise(F.col(b))
    line = F.when(F.col("a.flat"), F.col("a.y") + F.col("a.h") / 2).otherwise(F.col("a.x") + F.col("a.w") / 2)
    across_1, across_2, along_1, along_2 = pick("b.y1", "b.x1"), pick("b.y2", "b.x2"), pick("b.x1", "b.y1"), pick("b.x2", "b.y2")
    near = line.between(F.least(across_1, across_2) - tolerance, F.greatest(across_1, across_2) + tolerance)
    pairs = spatial.grid_join(lines, boxes, ["plan_id"], near, pad=int(tolerance) + 1)
    level = F.abs(across_2 - across_1) < 1e-6
    t = (line - across_1) / F.nullif(across_2 - across_1, F.lit(0.0))
    hit = along_1 + (along_2 - along_1) * t
    lo = F.when(level, F.least(along_1, along_2)).when(t.between(-1e-6, 1 + 1e-6), hit) - tolerance
    hi = F.when(level, F.greatest(along_1, along_2)).when(t.between(-1e-6, 1 + 1e-6), hit) + tolerance
    blocked = pairs.select(F.col("a.corridor_id").alias("corridor_id"), lo.alias("lo"), hi.alias("hi")).where("lo is not null")
    start, end = F.when(flat, F.col("x")).otherwise(F.col("y")).cast("double"), F.when(flat, F.col("x") + F.col("w")).otherwise(F.col("y") + F.col("h")).cast("double")
    parts = free(lines.withColumns({"lo": start, "hi": end}), blocked, ["corridor_id"], least, 1e-4, closed=True)
    length = F.col("hi") - F.col("lo")
    d = lambda c: F.col(c).cast("double")
    part = F.row_number().over(Window.partitionBy("corridor_id").orderBy("lo")).cast("long")
    return parts.select("plan_id", "corridor_id", part.alias("part"), F.when(F.col("flat"), F.col("lo")).otherwise(d("x")).alias("x"), F.when(F.col("flat"), d("y")).otherwise(F.col("lo")).alias("y"), F.when(F.col("flat"), length).otherwise(d("w")).alias("w"), F.when(F.col("flat"), d("h")).otherwise(length).alias("h"))


def level_walls(walls: DataFrame, tolerance: int = 20, gap: int = 25, least: int = 50) -> DataFrame:
    """walls(plan_id, wall_id, x1, y1, x2, y2) along an axis -> plan_id, flat, c, lo, hi: in order of their coordinate walls join a group while they are
    within tolerance of its mean so far; a group's walls at most gap apart are one, if it is long enough."""
    flat = F.col("y1") == F.col("y2")
    c, lo, hi = F.when(flat, F.col("y1")).otherwise(F.col("x1")), F.when(flat, F.least("x1", "x2")).otherwise(F.least("y1", "y2")), F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest("y1", "y2"))
    w = walls.where("x1 = x2 or y1 = y2").select("plan_id", flat.cast("long").alias("flat"), "wall_id", c.cast("long").alias("c"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))

    def step(state, c):
        if state is not None and abs(state[0] - c * state[1]) <= tolerance * state[1]:
            return [state[0] + c, state[1] + 1], False
        return [c, 1], True

    keys = ["plan_id", "flat", "line"]
    w = scanned(w, ["plan_id", "flat"], ["c", "wall_id"], ["c"], step, "line")
    means = w.groupBy(*keys).agg(F.avg("c").alias("c"))
    return merged(w, keys, gap).where(F.col("hi") - F.col("lo") >= least).join(means, keys).select("plan_id", (F.col("flat") == 1).alias("flat"), "c", "lo", "hi")


def _angle_apart(a: Column, b: Column) -> Column:
    """Of two directions of lines (without sense): from 0 to a quarter turn."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)


def collinear_runs(walls: DataFrame, angle: float = 5.73, offset: float = 20, reach: int = 30) -> DataFrame:
    """walls(plan_id, wall_id, x1, y1, x2, y2) of any direction -> plan_id, run (its least wall), walls, x1, y1, x2, y2: walls are one run if an end of one is
    within reach of an end of the other, their directions differ by less than angle (degrees; a half turn is the same direction), and
    an end of each is within offset of the other's line. A run's ends are the point farthest from its middle and the point farthest from that one.

    Ends meet by grid cells; runs are the components of those links."""
    w = walls.where("x1 <> x2 or y1 <> y2").select("plan_id", "wall_id", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    w = graph.cut(w.withColumn("d", F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))))
    line = F.struct("x1", "y1", "x2", "y2", "d").alias("line")
    ends = spatial.points(w.select("plan_id", "wall_id", line, F.inline(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))))

    def off(of: str, other: str) -> Column:
        """Distance of the first end of one wall from the other's line."""
        p, q = (lambda n: F.col(f"{of}.line.{n}")), (lambda n: F.col(f"{other}.line.{n}"))
        dx, dy = q("x2") - q("x1"), q("y2") - q("y1")
        return F.abs((p("x1") - q("x1")) * dy - (p("y1") - q("y1")) * dx) / F.hypot(dx, dy)

    test = (F.col("a.wall_id") < F.col("b.wall_id")) & (_angle_apart(F.col("a.line.d"), F.col("b.line.d")) < angle) & ((off("a", "b") < offset) | (off("b", "a") < offset))
    links = spatial.within(ends, ends, ["plan_id"], reach, test).select(F.col("a.wall_id").alias("a"), F.col("b.wall_id").alias("b")).distinct()
    runs = graph.components(w.select(F.col("wall_id").alias("id")), links).withColumnsRenamed({"id": "wall_id", "component": "run"})
    points = graph.cut(ends.join(runs, "wall_id").select("plan_id", "run", "wall_id", "x", "y"))
    middle = points.groupBy("run").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.countDistinct("wall_id").alias("walls"))
    far = lambda px, py: F.struct((F.pow(F.col("x") - F.col(px), 2) + F.pow(F.col("y") - F.col(py), 2)).alias("d"), "x", "y")
    first = points.join(middle, "run").groupBy("plan_id", "run", "walls").agg(F.max(far("mx", "my")).alias("p"))
    first = first.select("plan_id", "run", "walls", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"))
    return points.join(first, ["plan_id", "run"]).groupBy("plan_id", "run", "walls", "x1", "y1").agg(F.max(far("x1", "y1")).alias("q")).select("plan_id", "run", "walls", "x1", "y1", F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))
