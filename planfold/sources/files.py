"""File sources and sinks: unit-mix CSVs, floor-plan JSON documents, box lists, report bundles, training samples."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The names a column may come under, in order of preference.
ALIASES = {
    "typologie": ["typologie", "typology", "type", "name", "nom", "unit", "category", "categorie", "unit_type", "unit_name", "label", "designation"],
    "surface_cible": ["surface_cible", "surface", "target_area", "target area", "area"],
    "tolerance": ["tolerance"],
    "priorite": ["priorite", "priority"],
}
#: Fixed columns of a box list.
BOX_COLUMNS = ["box_id", "type", "x", "y", "w", "h", "area", "zone", "row_no", "label"]

PLAN_SCHEMA = """urn string, totalArea double, bounds struct<minX: double, minY: double, maxX: double, maxY: double>,
  rooms array<struct<id: string, area: double>>,
  walls array<struct<id: string, start: struct<x: double, y: double>, end: struct<x: double, y: double>, polygon: array<array<double>>, x1: double, y1: double, x2: double, y2: double>>"""


#: A field of a CSV line: quoted, with doubled quotes inside, or plain.
_FIELD = r'(?:^|,)(?:"((?:[^"]|"")*)"|([^,]*))'


def _fields(line: Column) -> Column:
    """The fields of a CSV line, trimmed."""
    quoted, plain = (F.regexp_extract_all(line, F.lit(_FIELD), F.lit(i)) for i in (1, 2))
    return F.zip_with(quoted, plain, lambda q, p: F.trim(F.when(q != "", F.replace(q, F.lit('""'), F.lit('"'))).otherwise(p)))


def read_mix_csv(spark: SparkSession, path: str) -> DataFrame:
    """All unit-mix CSVs under path as text columns typologie, surface_cible, tolerance, priorite with mix_id (the file's name). Every file
    is read by its own header, whatever the order of columns elsewhere. Headers match without regard to case and blanks; a file without
    a known type column has its first one taken; blank lines are left out. Mixes are small files, one to a row."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.[A-Za-z]+$", 1).alias("mix_id"), F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "").alias("lines"))
    raw = raw.where("size(lines) > 0").withColumn("names", F.transform(_fields(F.get("lines", F.lit(0))), lambda n: F.lower(F.trim(F.replace(n, F.lit("\ufeff"), F.lit(""))))))
    rows = raw.select("mix_id", "names", F.explode(F.slice("lines", 2, F.size("lines"))).alias("line")).withColumn("fields", _fields(F.col("line")))

    def pick(field: str, first: bool = False) -> Column:
        at = lambda name: F.nullif(F.get("fields", F.when(F.array_position("names", name) > 0, F.array_position("names", name) - 1).cast("int")), F.lit(""))
        known = [at(a) for a in ALIASES[field]]
        return F.coalesce(*known, *([F.when(~F.arrays_overlap("names", F.array(*map(F.lit, ALIASES[field]))), F.nullif(F.get("fields", F.lit(0)), F.lit("")))] if first else [])).alias(field)

    return rows.select("mix_id", pick("typologie", True), pick("surface_cible"), pick("tolerance"), pick("priorite"))


def read_plan_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Floor-plan JSON documents, one a line -> (plans(plan_id, bounds, total_area), walls(plan_id, wall_id, x1, y1, x2, y2)).

    Walls come as start/end, as x1..y2 or as polygons, of which the first two points count. The total area is the document's, else
    that of its rooms, else of its bounds."""
    docs = spark.read.schema(PLAN_SCHEMA).json(path)
    rooms = F.aggregate(F.coalesce("rooms", F.array().cast("array<struct<id: string, area: double>>")), F.lit(0.0), lambda s, r: s + F.coalesce(r["area"], F.lit(0.0)))
    box = (F.col("bounds.maxX") - F.col("bounds.minX")) * (F.col("bounds.maxY") - F.col("bounds.minY"))
    positive = lambda c: F.when(c > 0, c)
    plans = docs.select(F.col("urn").alias("plan_id"), "bounds", F.coalesce(positive(F.col("totalArea")), positive(rooms), positive(box), F.lit(0.0)).alias("total_area"))
    w = docs.select(F.col("urn").alias("plan_id"), F.posexplode("walls").alias("n", "w"))
    at = lambda i, k: F.get(F.get("w.polygon", F.lit(i)), F.lit(k))
    ends = {"x1": ("start.x", at(0, 0)), "y1": ("start.y", at(0, 1)), "x2": ("end.x", at(1, 0)), "y2": ("end.y", at(1, 1))}
    walls = w.select("plan_id", F.coalesce("w.id", F.col("n").cast("string")).alias("wall_id"), *(F.coalesce(F.col(f"w.{a}"), F.col(f"w.{k}"), b).alias(k) for k, (a, b) in ends.items()))
    return plans, walls.where("x1 is not null and y1 is not null and x2 is not null and y2 is not null")


def write_box_list(boxes: DataFrame, path: str) -> None:
    """Box lists as CSV with fixed columns, a folder for each plan.

    Rows are dealt by ranges of plan and box first, so that a plan is one file, or two where ranges meet (a large one as many as it has
    ranges), and not one for each task; tasks put their own files in place, not the driver one after the other."""
    missing = [F.lit(None).cast("string").alias(c) for c in BOX_COLUMNS if c not in boxes.columns]
    laid = boxes.select("*", *missing).select("plan_id", *BOX_COLUMNS).repartitionByRange("plan_id", "box_id")
    laid.write.partitionBy("plan_id").option("header", True).option("mapreduce.fileoutputcommitter.algorithm.version", "2").csv(path)


def read_box_list(spark: SparkSession, path: str) -> DataFrame:
    schema = "box_id long, type string, x long, y long, w int, h int, area long, zone string, row_no string, label string, plan_id long"
    return spark.read.schema(schema).option("header", True).csv(path)


def write_bundle(tables: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """A report bundle: the tables of a report side by side under one folder."""
    for name, df in tables.items():
        df.write.format(kind).option("header", True).save(f"{path}/{name}")


def append_samples(samples: DataFrame, path: str) -> tuple[int, int]:
    """Appends extracted samples to a training set; (appended, total). The set is counted once; what is added is counted as it is written."""
    before, seen = 0, Observation()
    try:
        before = samples.sparkSession.read.parquet(path).count()
    except AnalysisException as e:  # the first append makes the set
        if "PATH_NOT_FOUND" not in str(e):
            raise
    samples.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    n = seen.get["n"]
    return n, before + n


def save_version(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """versions(project_id, version, created_at, updated_at, payload) with new saves: each project's version rises by 0.1 and keeps
    its time of creation; a new project starts at 1.0."""
    latest = versions.groupBy("project_id").agg(F.max("version").alias("_v"), F.min("created_at").alias("_c"))
    new = changes.join(latest, "project_id", "left")
    new = new.select("project_id", F.round(F.coalesce(F.col("_v") + 0.1, F.lit(1.0)), 1).alias("version"), F.coalesce("_c", "updated_at").alias("created_at"), "updated_at", "payload")
    return versions.unionByName(new)


def upserted(table: DataFrame, changes: DataFrame) -> DataFrame:
    """table and changes(key, updated_at, metadata map): the later write wins, metadata is merged with later values on top."""
    entries = table.unionByName(changes).select("key", "updated_at", F.explode_outer("metadata").alias("name", "value"))
    last = entries.groupBy("key", "name").agg(F.max_by("value", "updated_at").alias("value"), F.max("updated_at").alias("updated_at"))
    pairs = F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "value")))
    return last.groupBy("key").agg(F.max("updated_at").alias("updated_at"), F.map_from_entries(pairs).alias("metadata"))
