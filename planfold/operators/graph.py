"""Graphs as edge tables: components, reachability, shortest paths, rounds of greedy choices. Loops end when nothing changes; each round is
cut by a written table in the shared folder that the cluster names (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; a temporary one only in local mode where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="planfold-"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again. Unlike a checkpoint the copy doesn't carry the constraints that Spark has
    inferred so far, which grow from round to round of a loop."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, for joins by shuffles only: files and projections look far smaller than the rows that a broadcast of them sends to the driver."""
    return df.hint("merge")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(id), edges(a, b) between nodes, of one type -> (id, component): the smallest id reachable. In each round every node that has a
    smaller neighbour follows the smallest one, up to the last of that chain; only edges between what is left go on, so rounds shrink."""

    def kept(df: DataFrame) -> DataFrame:
        return cut(df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    live, tops = kept(edges.select("a", "b")), []
    while not live.isEmpty():
        top = roots(live.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("before")))
        tops.append(top)
        of = lambda k: spread(top).select(F.col("id").alias(k), F.col("root").alias(f"_{k}"))  # noqa: B023, E731
        live = kept(live.join(of("a"), "a").join(of("b"), "b", "left").select(F.col("_a").alias("a"), F.coalesce("_b", "b").alias("b")))
    ids = spread(nodes.select("id").distinct())
    if not tops:
        return cut(ids.select("id", F.col("id").alias("component")))
    return cut(ids.join(_followed(tops), "id", "left").select("id", F.coalesce("root", "id").alias("component")))


def _followed(tops: list[DataFrame]) -> DataFrame:
    """(id, root) of rounds, each over what the one before left as roots -> (id, root) over all of them."""
    whole = tops[-1]
    for top in reversed(tops[:-1]):
        whole = cut(top.join(spread(whole).toDF("root", "_next"), "root", "left").select("id", F.coalesce("_next", "root").alias("root")).unionByName(whole))
    return whole


def distances(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """sources(id), edges(a, b, cost), both ways -> (id, cost): least cost from a source, by relaxing all edges until nothing falls."""
    both = cut(edges.select("a", "b", "cost").union(edges.select("b", "a", "cost")).groupBy("a", "b").agg(F.min("cost").alias("cost")))
    best = cut(sources.select("id").distinct().withColumn("total", F.lit(0).cast("double")))
    front = best
    while True:
        step = front.join(spread(both), F.col("id") == F.col("a")).groupBy(F.col("b").alias("id")).agg(F.min(F.col("total") + F.col("cost")).alias("new"))
        front = cut(step.join(spread(best), "id", "left").where("total is null or new < total").select("id", F.col("new").alias("total")))
        if front.isEmpty():
            return best.withColumnRenamed("total", "cost")
        best = cut(best.unionByName(front).groupBy("id").agg(F.min("total").alias("total")))


def kept_in_order(nodes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """nodes(id, place), conflicts(a, b) -> ids kept by a scan in order of place (ties by id) that drops what conflicts with a kept one."""
    of = lambda k: nodes.select(F.col("id").alias(k), F.col("place").alias(f"p{k}"))
    return nodes.select("id").join(dropped_in_order(conflicts.join(of("a"), "a").join(of("b"), "b")), "id", "left_anti")


def dropped_in_order(conflicts: DataFrame) -> DataFrame:
    """conflicts(a, b, pa, pb) of nodes with their places -> the ids that the scan of kept_in_order drops. In each round every node that comes
    before all its neighbours is kept and its neighbours go. Only conflicts of nodes not yet decided go on, so rounds shrink; nodes without
    conflicts are never in them."""
    ways = conflicts.where("a <> b").select("a", "b", "pa", "pb")
    links, dropped = cut(ways.union(ways.select("b", "a", "pb", "pa")).distinct()), None
    while True:
        later = F.struct("pb", "b") < F.struct("pa", "a")
        won = cut(links.groupBy("a").agg(F.bool_or(later).alias("later")).where("not later").select("a"))
        lost = cut(links.join(won, "a", "left_semi").select(F.col("b").alias("id")).distinct())
        dropped = lost if dropped is None else dropped.union(lost)
        done = won.select(F.col("a").alias("id")).union(lost)
        links = cut(links.join(done.toDF("a"), "a", "left_anti").join(done.toDF("b"), "b", "left_anti"))
        if links.isEmpty():
            return dropped


def mutual_nearest(pairs: DataFrame) -> DataFrame:
    """pairs(a, b, distance) -> one-to-one pairs: rounds of pairs that are each other's nearest, by (distance, a, b), until none is
    left. Equal to taking pairs greedily in global order."""
    live, done = cut(pairs.select("a", "b", "distance")), None
    while True:
        by = lambda k: live.groupBy(k).agg(F.min(F.struct("distance", "a", "b")).alias(f"best_{k}"))  # noqa: B023, E731
        both = live.join(by("a"), "a").join(by("b"), "b")
        me = F.struct("distance", "a", "b")
        won = cut(both.where((me == F.col("best_a")) & (me == F.col("best_b"))).select("a", "b", "distance"))
        done = won if done is None else done.union(won)
        if won.isEmpty():
            return done
        live = cut(live.join(won.select("a"), "a", "left_anti").join(won.select("b"), "b", "left_anti"))


def nearest_pairs(pairs: DataFrame) -> DataFrame:
    """pairs(a, b, distance) of nodes of one kind -> pairs in which no node comes twice, taken greedily by (distance, a, b): rounds of
    pairs that are the least of both their nodes."""
    live, done = cut(pairs.select("a", "b", "distance")), None
    me = F.struct("distance", "a", "b")
    while True:
        best = cut(live.select(F.explode(F.array("a", "b")).alias("node"), me.alias("p")).groupBy("node").agg(F.min("p").alias("best")))
        of = lambda k: best.select(F.col("node").alias(k), F.col("best").alias(f"best_{k}"))  # noqa: B023, E731
        won = cut(live.join(of("a"), "a").join(of("b"), "b").where((me == F.col("best_a")) & (me == F.col("best_b"))).select("a", "b", "distance"))
        done = won if done is None else done.union(won)
        if won.isEmpty():
            return done
        gone = won.select(F.explode(F.array("a", "b")).alias("a"))
        live = cut(live.join(gone, "a", "left_anti").join(gone.withColumnRenamed("a", "b"), "b", "left_anti"))


def predecessors(costs: DataFrame, edges: DataFrame) -> DataFrame:
    """costs(id, cost) from distances(), edges(a, b, cost), both ways -> (id, before): for each node that costs something, the smallest
    node before it on a least path."""
    both = edges.select("a", "b", "cost").union(edges.select("b", "a", "cost")).withColumnRenamed("cost", "step")
    costs = spread(costs)
    ahead = both.join(costs.select(F.col("id").alias("a"), F.col("cost").alias("ca")), "a").join(costs.select(F.col("id").alias("b"), F.col("cost").alias("cb")), "b")
    on_path = ahead.where((F.col("ca") < F.col("cb")) & (F.abs(F.col("ca") + F.col("step") - F.col("cb")) < 1e-6))
    return on_path.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("before"))


def roots(parents: DataFrame) -> DataFrame:
    """parents(id, before) without cycles -> (id, root): the last node that is no one's child, by doubling pointers."""
    now = cut(parents.select("id", F.col("before").alias("root")))
    while True:
        up = now.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        after = cut(now.join(spread(up), "root", "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        now = after.select("id", "root")
        if after.where("_moved").isEmpty():
            return now


def spanning_bridges(nodes: DataFrame, near: Callable[[DataFrame, int], DataFrame], reach: int) -> DataFrame:
    """nodes(id, group, component, ...) -> (a, b, distance): the shortest bridges that join the components of each group to one tree.

    near(nodes, reach) gives pairs(a, b, la, lb, distance) of nodes, a < b, at most reach apart, with their labels. Within a reach each
    component takes its shortest pair to another one (ties by ids) until there is none; then the reach doubles for the groups still in
    parts. Shorter pairs are all dealt with before longer ones, so the tree is a minimum spanning tree. Of two components only the shortest
    pair goes on from round to round."""

    def shortest(pairs: DataFrame) -> DataFrame:
        by = pairs.where("la <> lb").groupBy(F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb"))
        return cut(by.agg(F.min(F.struct("distance", "a", "b")).alias("p")))

    label = nodes.withColumnRenamed("component", "label")
    found = None
    while True:
        parts = label.groupBy("group").agg(F.countDistinct("label").alias("n")).where("n > 1").select("group")
        label = cut(label.join(parts, "group"))
        if label.isEmpty():
            return found if found is not None else label.sparkSession.createDataFrame([], "a long, b long, distance double")
        links, tops = shortest(near(label, reach)), []
        while not links.isEmpty():
            best = links.select(F.explode(F.array("la", "lb")).alias("label"), "p", "la", "lb").groupBy("label").agg(F.min(F.struct("p", "la", "lb")).alias("m"))
            best = cut(best.select("label", F.when(F.col("label") == F.col("m.la"), F.col("m.lb")).otherwise(F.col("m.la")).alias("other"), "m.p.a", "m.p.b", "m.p.distance"))
            won = best.select("a", "b", "distance").distinct()
            found = won if found is None else found.union(won)
            # each component follows the one it chose; of two that chose each other the smaller is the root
            mutual = best.alias("p").join(best.alias("q"), (F.col("p.other") == F.col("q.label")) & (F.col("q.other") == F.col("p.label")) & (F.col("p.label") < F.col("q.label"))).select(F.col("p.label").alias("label"))
            top = roots(best.select("label", "other").join(mutual, "label", "left_anti").toDF("id", "before"))
            tops.append(top)
            of = lambda k: top.toDF(k, f"_{k}")  # noqa: B023, E731
            moved = links.join(of("la"), "la", "left").join(of("lb"), "lb", "left")
            links = shortest(moved.select(F.coalesce("_la", "la").alias("la"), F.coalesce("_lb", "lb").alias("lb"), "p.*"))
        if tops:
            label = label.join(_followed(tops).withColumnRenamed("id", "label"), "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")
            label = cut(label)
        reach *= 2
