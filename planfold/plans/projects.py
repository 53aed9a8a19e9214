"""Queries on project versions, upserts, webhook events and jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planfold.catalog import query
from planfold.operators.graph import cut
from planfold.operators.graph import shared_folder as _folder
from planfold.sources import files
from planfold.streaming import events as streams


@query("W11_latest_versions", "select project_id, version_key, status, n from (select *, row_number() over (partition by project_id order by updated_at desc, version_key desc) as rn, count(*) over (partition by project_id) as n from versions) t where rn = 1")
def w11(v):
    latest = F.max(F.struct("updated_at", "version_key", "status")).alias("m")
    return v.versions.groupBy("project_id").agg(latest, F.count(F.lit(1)).alias("n")).select("project_id", "m.version_key", "m.status", "n")


@query("S5_version_numbers", "select project_id, version_key, round(1.0 + 0.1 * (row_number() over (partition by project_id order by updated_at, version_key) - 1), 1)::double as version, min(updated_at) over (partition by project_id) as created_at from versions")
def s5(v):
    """Each save adds 0.1 and keeps the time of creation."""
    w = Window.partitionBy("project_id")
    n = F.row_number().over(w.orderBy("updated_at", "version_key"))
    return v.versions.select("project_id", "version_key", F.round(1 + 0.1 * (n - 1), 1).alias("version"), F.min("updated_at").over(w).alias("created_at"))


_PROJECTS = "select project_id, updated_at, row_number() over (order by updated_at desc, project_id) as place from (select project_id, max(updated_at) as updated_at from versions group by project_id) t"


@query("T1_projects_by_update", _PROJECTS)
@query("T1_all_projects_by_update", _PROJECTS)
def t1_all(v):
    """All projects: sorted by ranges, placed within each range, after the rows of the ranges before (one count for each range)."""
    order = [F.desc("updated_at"), F.asc("project_id")]
    latest = v.versions.groupBy("project_id").agg(F.max("updated_at").alias("updated_at"))
    laid = cut(latest.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    starts, at = [], 0
    for r in laid.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        starts.append((r.part, at))
        at += r.n
    before = v.spark.createDataFrame(starts, "part int, before long")
    return laid.join(F.broadcast(before), "part").select("project_id", "updated_at", (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))).alias("place"))


@query("T4_oldest_pending", "select event_id, ts, user_id from (select distinct event_id, ts, user_id, event_type from webhook_events) t where event_type = 'view' order by ts, event_id limit 50")
def t4(v):
    return v.webhook_events.where("event_type = 'view'").select("event_id", "ts", "user_id").distinct().orderBy("ts", "event_id").limit(50)


@query("X1_deduplicated_events", "select event_id, user_id, event_type from (select *, row_number() over (partition by event_id order by ts) as rn from webhook_events where event_type <> 'view' and user_id is not null) t where rn = 1")
def x1(v):
    """Batch twin of the stream: ready events of a plan, each id once."""
    e = v.webhook_events.select("event_id", "ts", "user_id", "event_type", F.when(F.col("event_type") != "view", "success").alias("status"), F.col("user_id").alias("plan_id"))
    return streams.deduplicated(e).select("event_id", "user_id", "event_type")


@query("X3_job_states", "select user_id as job_id, arg_max(event_type, (epoch_us(ts), event_id)) as state, count(*) as attempts, count(*) filter (event_type = 'purchase') as failures from events group by user_id")
def x3(v):
    e = v.raw("events").select(F.col("user_id").alias("job_id"), "event_type", F.struct("ts", "event_id").alias("at"))
    return e.groupBy("job_id").agg(F.max_by("event_type", "at").alias("state"), F.count(F.lit(1)).alias("attempts"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("failures"))


@query("A25_run_summary", "select event_type, round(avg(value), 4) as mean, min(value) as low, max(value) as high, count(*) as n from events group by event_type")
def a25(v):
    return v.raw("events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n"))


@query("S7_box_list", "select plan_id, count(*) as n, cast(sum(cast(w as bigint) * h) as bigint) as area, min(box_id) as first_id from boxes where floor_level = 0 group by plan_id")
def s7(v):
    """Box lists of the ground floors written as CSV, a folder for each plan, and read back."""
    path = _folder(v.spark)
    files.write_box_list(v.boxes.where("floor_level = 0").withColumn("area", F.col("w").cast("long") * F.col("h")), path)
    return files.read_box_list(v.spark, path).groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"), F.min("box_id").alias("first_id"))


@query("S4_plan_documents", "select cast(plan_id as varchar) as plan_id, wall_id::varchar as wall_id, x1::double as x1, y1::double as y1, x2::double as x2, y2::double as y2 from walls")
def s4(v):
    """Walls written as JSON documents of plans, in three spellings, and normalised again."""
    path = _folder(v.spark)
    d = lambda c: F.col(c).cast("double")
    start, end = F.struct(d("x1").alias("x"), d("y1").alias("y")), F.struct(d("x2").alias("x"), d("y2").alias("y"))
    ring = F.array(F.array(d("x1"), d("y1")), F.array(d("x2"), d("y2")))
    kind = F.col("wall_id") % 3
    wall = F.struct(F.col("wall_id").cast("string").alias("id"), F.when(kind == 0, start).alias("start"), F.when(kind == 0, end).alias("end"), F.when(kind == 1, ring).alias("polygon"), *(F.when(kind == 2, d(c)).alias(c) for c in ("x1", "y1", "x2", "y2")))
    docs = v.walls.groupBy(F.col("plan_id").cast("string").alias("urn")).agg(F.collect_list(wall).alias("walls"))
    docs.write.json(path)
    return files.read_plan_documents(v.spark, path)[1]
