"""Networks of corridors, floors and walls: centreline graphs, bridges between parts, routes across floors, gaps between walls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planfold.functions import geometry
from planfold.operators import graph, spatial
from planfold.operators.shapes import as_rectangles

#: Lengths in centimetres: shortest edge, how far apart aligned nodes may lie across, and along: at least, at most, or a share of the plan.
SHORTEST, ALIGNED, BRIDGE, BRIDGE_SHARE = 20, 25, (30, 400), 0.15
#: Ends of an edge; sides of the cells in which edges meet walls, and nodes each other: the latter in units of how far nodes may lie apart.
ENDS, WALL_CELL, NODE_CELL = ["x1", "y1", "x2", "y2"], 2000, 6
#: Height of a level, and weights of horizontal and vertical steps.
LEVEL, FLAT, STEEP = 320, 1.0, 1.4
#: Gaps between wall ends that are filled: from and to; and how often.
GAP_REACH, GAP_LEAST, PASSES = 200, 50, 3


def _point(c: Column, along: Column, flat: Column) -> Column:
    return F.struct(F.when(flat, along).otherwise(c).cast("double").alias("x"), F.when(flat, c).otherwise(along).cast("double").alias("y"))


def _blocked(edges: DataFrame, walls: DataFrame) -> DataFrame:
    """The edges(plan_id, x1, y1, x2, y2) that cross a wall away from all ends, once for each such wall. Both are dealt to cells by their ends
    alone: rectangles follow from these. No side is broadcast: a file looks far smaller than its shapes in all their cells."""
    cells = lambda df, t: graph.spread(spatial.in_cells(as_rectangles(df.select("plan_id", *ENDS)), WALL_CELL).select("plan_id", *ENDS, "cx", "cy")).alias(t)
    c = lambda t, n: F.col(f"{t}.{n}")
    low, high = (lambda t, p: F.least(c(t, f"{p}1"), c(t, f"{p}2"))), (lambda t, p: F.greatest(c(t, f"{p}1"), c(t, f"{p}2")))
    test = geometry.crossing(*((c(t, f"x{i}"), c(t, f"y{i}")) for t in "ab" for i in (1, 2)))["inner"]
    for p in "yx":
        corner = F.floor(F.greatest(low("a", p), low("b", p)) / WALL_CELL) == c("a", f"c{p}")
        test = corner & (low("a", p) <= high("b", p)) & (low("b", p) <= high("a", p)) & test
    for k in ("plan_id", "cx", "cy"):
        test = test & (c("a", k) == c("b", k))
    return cells(edges, "a").join(cells(walls, "b"), test).select("a.plan_id", *(f"a.{k}" for k in ENDS))


def centreline_edges(plans: DataFrame, corridors: DataFrame, walls: DataFrame) -> DataFrame:
    """Edges of the graph of corridor centrelines: plan_id, kind (corridor, bridge), x1, y1, x2, y2, length, blocked.

    Centrelines are split where horizontal ones cross vertical ones; edges under SHORTEST are left out, those across a wall are blocked.
    Bridges join nodes that lie in one line, unless a wall is between. Edges, nodes and bridges are each written once, and only ids and
    coordinates are shuffled."""
    flat = F.col("w") >= F.col("h")
    c = F.when(flat, F.col("y") + F.col("h") / 2).otherwise(F.col("x") + F.col("w") / 2)
    start, length = F.when(flat, F.col("x")).otherwise(F.col("y")), F.when(flat, F.col("w")).otherwise(F.col("h"))
    lines = corridors.select("plan_id", "corridor_id", flat.alias("flat"), c.cast("double").alias("c"), start.cast("double").alias("s"), (start + length).cast("double").alias("e"))
    zero, along = F.lit(0.0), F.col("e") - F.col("s")
    level = graph.spread(lines.where("flat").select("plan_id", "corridor_id", F.col("s").alias("x"), F.col("c").alias("y"), along.alias("w"), zero.alias("h")))
    steep = graph.spread(lines.where("not flat").select("plan_id", "corridor_id", F.col("c").alias("x"), F.col("s").alias("y"), zero.alias("w"), along.alias("h")))
    across = spatial.grid_join(level, steep, ["plan_id"], geometry.overlap("a", "b", strict=False))
    cuts = across.select(F.col("a.plan_id").alias("plan_id"), F.inline(F.array(F.struct(F.col("a.corridor_id").alias("corridor_id"), F.lit(True).alias("flat"), F.col("a.y").alias("c"), F.col("b.x").alias("at")), F.struct(F.col("b.corridor_id").alias("corridor_id"), F.lit(False).alias("flat"), F.col("b.x").alias("c"), F.col("a.y").alias("at")))))
    ends = lines.select("plan_id", "corridor_id", "flat", "c", F.explode(F.array("s", "e")).alias("at"))
    # a corridor's few points in order, so that each edge is two that follow each other
    points = cuts.unionByName(ends).groupBy("plan_id", "corridor_id", "flat", "c").agg(F.array_sort(F.collect_set("at")).alias("at"))
    steps = points.select("*", F.explode(F.zip_with("at", F.slice("at", 2, F.size("at")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("step")).where(F.col("step.b") - F.col("step.a") >= SHORTEST)
    p, q = _point(F.col("c"), F.col("step.a"), F.col("flat")), _point(F.col("c"), F.col("step.b"), F.col("flat"))
    found = graph.cut(steps.select("plan_id", p.alias("p"), q.alias("q")).select("plan_id", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2")))
    # edges of several corridors become one in the aggregation that says which of them are blocked
    said = found.withColumn("blocked", F.lit(False)).unionByName(_blocked(found, walls).withColumn("blocked", F.lit(True)))
    edges = graph.cut(said.groupBy("plan_id", *ENDS).agg(F.bool_or("blocked").alias("blocked")))
    bridges = graph.cut(_bridges(plans, edges.where("not blocked")))
    hit = graph.cut(_blocked(bridges, walls).distinct())
    bridges = bridges.join(hit, ["plan_id", *ENDS], "left_anti").withColumn("blocked", F.lit(False))
    apart = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    straight = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    out = lambda df, kind, length: df.select("plan_id", F.lit(kind).alias("kind"), *ENDS, "blocked", length.alias("length"))
    return out(edges, "corridor", straight).unionByName(out(bridges, "bridge", apart))


def _bridges(plans: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of ends of edges(plan_id, x1, y1, x2, y2), each along an axis, that lie in one line and aren't joined by an edge. A node brings along
    where the edges that begin there end, so no pair has to be looked up."""
    flat = F.col("y1") == F.col("y2")
    node = lambda i, x, y: F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y"), x.cast("double").alias("next_x"), y.cast("double").alias("next_y"))
    both = F.inline(F.array(node(1, F.when(flat, F.col("x2")), F.when(~flat, F.col("y2"))), node(2, F.lit(None), F.lit(None))))
    nodes = edges.select("plan_id", both).groupBy("plan_id", "x", "y").agg(F.collect_set("next_x").alias("next_x"), F.collect_set("next_y").alias("next_y"))
    most = plans.select("plan_id", F.greatest(F.lit(float(BRIDGE[1])), (F.col("max_x") - F.col("min_x")) * BRIDGE_SHARE).alias("most"))
    nodes = graph.cut(nodes.join(most, "plan_id"))
    return _aligned(nodes, "x", "y").unionByName(_aligned(nodes, "y", "x"))


def _aligned(nodes: DataFrame, along: str, across: str) -> DataFrame:
    """Pairs of nodes at most ALIGNED apart across and in BRIDGE along, without those that an edge joins: an equi-join by lanes across and
    stretches along, NODE_CELL times as wide as the reach, to which each node goes with half the reach around it. One shuffle serves both sides."""
    half = 0.5 + 1e-6  # more than half: what rounding takes from the reach is not lost
    place = {"stretch": lambda t="": F.col(f"{t}{along}") / F.col(f"{t}most"), "lane": lambda t="": F.col(f"{t}{across}") / ALIGNED}
    cells = nodes.select("plan_id", "most", "x", "y", F.col(f"next_{along}").alias("next"))
    for k, at in place.items():
        cells = cells.withColumn(k, F.explode(F.sequence(F.floor((at() - half) / NODE_CELL), F.floor((at() + half) / NODE_CELL))))
    d = {p: F.col(f"b.{p}") - F.col(f"a.{p}") for p in "xy"}
    known = (d[across] == 0) & (F.array_contains("a.next", F.col(f"b.{along}")) | F.array_contains("b.next", F.col(f"a.{along}")))
    test = (F.abs(d[across]) <= ALIGNED) & (d[along] >= BRIDGE[0]) & (d[along] <= F.least("a.most", "b.most")) & ~known  # asks the same of both sides: else the shuffle is made twice
    for k, at in place.items():
        test = (F.floor((F.greatest(at("a."), at("b.")) - half) / NODE_CELL) == F.col(f"a.{k}")) & test
    for k in ("plan_id", *place):
        test = test & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    cells = graph.spread(cells)
    point = [F.col(f"{t}.{p}").alias(f"{p}{i}") for i, t in ((1, "a"), (2, "b")) for p in "xy"]
    return cells.alias("a").join(cells.alias("b"), test).select("a.plan_id", *point)


def bridge_report(nodes: DataFrame, reach: int = 1000) -> DataFrame:
    """nodes(plan_id, id, x, y, component) -> plan_id, a, b, distance: the shortest bridges that make one component of each plan."""
    points = graph.cut(nodes.select("plan_id", "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "component", F.col("plan_id").alias("group")))

    def near(df: DataFrame, r: int) -> DataFrame:
        p = spatial.points(df)
        pairs = spatial.within(p, p, ["plan_id"], r, (F.col("a.id") < F.col("b.id")) & (F.col("a.label") != F.col("b.label")))
        return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.label").alias("la"), F.col("b.label").alias("lb"), F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")).alias("distance"))

    found = graph.spanning_bridges(points, near, reach)
    return found.join(points.select(F.col("id").alias("a"), "plan_id"), "a").select("plan_id", "a", "b", "distance")


def _floor_graph(connectors: DataFrame, links: DataFrame) -> DataFrame:
    """connectors(plan_id, connector_id, floor_level, x, y), links(a_id, b_id) -> edges(plan_id, a, b, cost, vertical).

    A floor's connectors are all joined by straight lines; as those obey the triangle inequality, only lines with an end that leads to
    another level can be part of a least route, and only these are made."""
    at = lambda t: connectors.select(F.col("plan_id"), F.col("connector_id").alias(t), F.col("floor_level").alias(f"{t}_level"), F.col("x").alias(f"{t}x"), F.col("y").alias(f"{t}y"))
    flat = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    v = links.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).join(at("a"), "a").join(at("b").drop("plan_id"), "b")
    rise = F.abs(F.col("a_level") - F.col("b_level")) * LEVEL
    vertical = v.select("plan_id", "a", "b", (F.sqrt(flat * flat + rise * rise) * STEEP).alias("cost"), F.lit(True).alias("vertical"))
    doors = links.select(F.explode(F.array("a_id", "b_id")).alias("a")).distinct()
    pairs = at("a").join(doors, "a").withColumnRenamed("a_level", "level").join(at("b").withColumnRenamed("b_level", "level"), ["plan_id", "level"]).where("a <> b")
    level = pairs.select("plan_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (flat * FLAT).alias("cost"), F.lit(False).alias("vertical")).distinct()
    return vertical.unionByName(level)


def cross_floor_routes(connectors: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(routes, segments): from each connector above the lowest level of its component, the least route down to that level (plan_id,
    from_id, to_id, cost), and the segments all routes use, once for both directions (plan_id, a_id, b_id, type, length)."""
    # all tables here grow with the connectors: each is derived once, and none is broadcast
    connectors = graph.spread(graph.cut(connectors.select("plan_id", "connector_id", "floor_level", "x", "y")))
    links = graph.spread(graph.cut(links.select("a_id", "b_id")))
    edges = graph.spread(graph.cut(_floor_graph(connectors, links)))
    floor = connectors.groupBy("plan_id", "floor_level").agg(F.min("connector_id").alias("first"))
    same = connectors.join(floor, ["plan_id", "floor_level"]).select(F.col("connector_id").alias("a"), F.col("first").alias("b"))
    parts = graph.components(connectors.select(F.col("connector_id").alias("id")), edges.where("vertical").select("a", "b").union(same))
    placed = graph.cut(connectors.join(graph.spread(parts).withColumnRenamed("id", "connector_id"), "connector_id"))
    lowest = placed.groupBy("component").agg(F.min("floor_level").alias("base"))
    placed = graph.spread(placed).join(lowest, "component")
    bases = placed.where("floor_level = base").select(F.col("connector_id").alias("id"))
    costs = graph.distances(bases, edges.select("a", "b", "cost"))
    costs = graph.spread(costs)
    before = graph.spread(graph.cut(graph.predecessors(costs, edges.select("a", "b", "cost"))))
    last = graph.spread(graph.roots(before))
    routes = placed.where("floor_level > base").select("plan_id", F.col("connector_id").alias("id")).join(costs, "id").join(last, "id").select("plan_id", F.col("id").alias("from_id"), F.col("root").alias("to_id"), "cost")
    # nodes on routes: the starts, and whatever comes before them
    used = placed.where("floor_level > base").select(F.col("connector_id").alias("id"))
    steps = before.join(used, "id").select(F.least("id", "before").alias("a_id"), F.greatest("id", "before").alias("b_id")).distinct()
    at = lambda k: connectors.select(F.col("connector_id").alias(f"{k}_id"), F.col("floor_level").alias(f"{k}_level"), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))
    seg = steps.join(at("a"), "a_id").join(at("b"), "b_id").join(connectors.select(F.col("connector_id").alias("a_id"), "plan_id"), "a_id")
    level = F.col("a_level") == F.col("b_level")
    length = F.when(level, F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))).otherwise(F.abs(F.col("a_level") - F.col("b_level")) * float(LEVEL))
    return routes, seg.select("plan_id", "a_id", "b_id", F.when(level, "horizontal").otherwise("vertical").alias("type"), length.alias("length"))


def level_hops(links: DataFrame) -> DataFrame:
    """links(plan_id, low, high) between levels -> plan_id, from_level, to_level (above it), hops: the fewest links, whatever their number."""
    both = graph.cut(links.select("plan_id", F.col("low").alias("a"), F.col("high").alias("b")).union(links.select("plan_id", "high", "low")).distinct())
    known = front = graph.cut(both.select("plan_id", F.col("a").alias("from_level"), F.col("b").alias("to_level"), F.lit(1).alias("hops")))
    while True:
        ahead = front.join(both.withColumnRenamed("a", "to_level"), ["plan_id", "to_level"]).select("plan_id", "from_level", F.col("b").alias("to_level"), (F.col("hops") + 1).alias("hops")).where("from_level <> to_level").distinct()
        front = graph.cut(ahead.join(known, ["plan_id", "from_level", "to_level"], "left_anti"))
        if front.isEmpty():
            return known.where("from_level < to_level")
        known = graph.cut(known.unionByName(front))


def wall_ends(walls: DataFrame) -> DataFrame:
    """plan_id, wall_id, id (of the end), x, y, w = h = 0."""
    end = lambda i: F.struct((F.col("wall_id") * 2 + i).alias("id"), F.col(f"x{i + 1}").cast("double").alias("x"), F.col(f"y{i + 1}").cast("double").alias("y"))
    return spatial.points(walls.select("plan_id", "wall_id", F.inline(F.array(end(0), end(1)))))


def wall_gaps(walls: DataFrame, reach: int = GAP_REACH) -> DataFrame:
    """Pairs of ends of different walls over 1 cm and under reach apart, one-to-one, the nearest first: plan_id, a, b, distance, x1..y2."""
    ends = graph.cut(wall_ends(walls))
    pairs = spatial.within(ends, ends, ["plan_id"], reach, (F.col("a.id") < F.col("b.id")) & (F.col("a.wall_id") != F.col("b.wall_id")) & (geometry.gap_squared("a", "b") > 1))
    found = graph.nearest_pairs(pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.sqrt(geometry.gap_squared("a", "b")).alias("distance")))
    of = lambda k, i: ends.select(F.col("id").alias(k), *([F.col("plan_id")] if i == 1 else []), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"))
    return found.join(of("a", 1), "a").join(of("b", 2), "b")


def gap_fillers(walls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fillers, gaps): synthetic walls (plan_id, pass, wall_id, x1, y1, x2, y2) across gaps of GAP_LEAST or more, in up to PASSES passes
    over a plan's walls and fillers so far, as long as its number of gaps falls; and the plans' gaps of the first pass."""
    now = graph.cut(walls.select("plan_id", "wall_id", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2"))))
    fillers, first, before = None, None, None
    for k in range(PASSES):
        gaps = graph.cut(wall_gaps(now))
        n = graph.cut(gaps.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n")))
        first = n.withColumnRenamed("n", "gaps") if first is None else first
        go_on = n if before is None else n.join(before.withColumnRenamed("n", "n0"), "plan_id").where("n < n0").select("plan_id", "n")
        new = gaps.where(F.col("distance") >= GAP_LEAST).join(go_on.select("plan_id"), "plan_id")
        new = graph.cut(new.select("plan_id", F.lit(k + 1).alias("pass"), (-(F.col("a") * PASSES + k) - 1).alias("wall_id"), "x1", "y1", "x2", "y2"))
        fillers = new if fillers is None else fillers.unionByName(new)
        now = graph.cut(now.join(go_on.select("plan_id"), "plan_id", "left_semi").unionByName(new.drop("pass")))
        before = go_on
        if now.isEmpty():
            break
    return fillers, first


def distinct_zones(zones: DataFrame, area: int = 50_000, corner: int = 100) -> DataFrame:
    """zones(plan_id, zone_id, x, y, w, h) without near-duplicates: areas and lower corners that differ by less; the larger zone stays."""
    size = F.col("w").cast("long") * F.col("h")
    z = spatial.points(zones.select("plan_id", "zone_id", "x", "y", size.alias("size")))
    alike = (F.abs(F.col("a.size") - F.col("b.size")) < area) & (F.col("a.zone_id") < F.col("b.zone_id"))
    pairs = spatial.within(z, z, ["plan_id"], corner, alike).select(F.col("a.zone_id").alias("a"), F.col("b.zone_id").alias("b"))
    kept = graph.kept_in_order(zones.select(F.col("zone_id").alias("id"), (-size).alias("place")), pairs)
    return zones.join(kept.withColumnRenamed("id", "zone_id"), "zone_id", "left_semi")


def merged_rectangles(rects: DataFrame, keys: list[str], gap: int = 15) -> DataFrame:
    """rects(keys, id, x, y, w, h) -> keys, id (the least of those merged), x, y, w, h, n: rectangles of equal keys that overlap, or lie at
    most gap apart on both axes, become the rectangle around them, until no two do. Each round merges whole components at once.

    Only rectangles that grew in the round before can meet new ones; the rectangles of keys in which none grew are done."""
    now = graph.cut(rects.select(*keys, "id", "x", "y", "w", "h", F.lit(1).cast("long").alias("n"), F.lit(True).alias("grew")))
    done = None
    near = lambda p, s: (F.col(f"a.{p}") <= F.col(f"b.{p}") + F.col(f"b.{s}") + gap) & (F.col(f"b.{p}") <= F.col(f"a.{p}") + F.col(f"a.{s}") + gap)
    once = (F.col("a.id") < F.col("b.id")) | ~F.col("b.grew")
    while True:
        met = spatial.grid_join(now.where("grew"), now, keys, near("x", "w") & near("y", "h") & once, pad=gap + 1)
        pairs = graph.cut(met.select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.id").alias("a"), F.col("b.id").alias("b")))
        if pairs.isEmpty():
            now = now.drop("grew")
            return now if done is None else done.unionByName(now)
        busy = pairs.select(*keys).distinct().withColumn("_busy", F.lit(True))
        now = graph.cut(now.drop("grew").join(busy, keys, "left"))
        rest = now.where("_busy is null").drop("_busy")
        done = rest if done is None else done.unionByName(rest)
        root = graph.components(pairs.select(F.explode(F.array("a", "b")).alias("id")), pairs).withColumnRenamed("component", "root")
        right, top = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
        parts = now.where("_busy").join(root, "id", "left").groupBy(*keys, F.coalesce("root", "id").alias("id"))
        now = graph.cut(parts.agg(F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("w"), (top - F.min("y")).alias("h"), F.sum("n").alias("n"), F.bool_or(F.col("root").isNotNull()).alias("grew")))
