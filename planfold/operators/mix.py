"""Unit mixes: reading their lines, and comparing targets with what was placed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planfold.functions import text


def _blank(name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def read_lines(rows: DataFrame) -> DataFrame:
    """rows(plan_id, line_no, typologie, surface_cible, tolerance, priorite), all text -> the rows with name, target, allowed, min_area,
    max_area, required and error (null on a valid line). A missing name makes the surface text the name (the first column left);
    a tolerance that isn't a number, or is negative, becomes 10 %."""
    target = text.number(F.coalesce("surface_cible", F.lit("")))
    tol = F.regexp_replace(F.coalesce(_blank("tolerance"), F.lit("0")), ",", ".")
    said = text.number(F.regexp_replace(tol, "%", ""))
    share = F.when(tol.contains("%"), F.coalesce(target * said / 100, F.lit(0.0))).otherwise(said)
    out = rows.withColumn("name", F.trim(F.coalesce(_blank("typologie"), _blank("surface_cible")))).withColumn("target", target)
    out = out.withColumn("allowed", F.when(share.isNull() | (share < 0), target * 0.1).otherwise(share))
    out = out.withColumn("required", F.lower(F.coalesce("priorite", F.lit("souhaitable"))).rlike("oblig|required|mandatory"))
    error = F.when(F.col("name").isNull(), "missing name").when(F.coalesce(F.col("target") <= 0, F.lit(True)), F.concat(F.lit("invalid surface "), F.coalesce("surface_cible", F.lit(""))))
    return out.withColumn("error", error).withColumn("min_area", F.greatest(F.lit(0.0), F.col("target") - F.col("allowed"))).withColumn("max_area", F.col("target") + F.col("allowed"))


def line_errors(rows: DataFrame) -> DataFrame:
    """All errors of each line of the second dialect: needs a type and a positive area or a count of 0 or more."""
    area, count = text.number(F.col("area")), F.regexp_extract(F.col("count"), r"^\s*([+-]?\d+)", 1).try_cast("int")
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    area_ok, count_ok = F.coalesce(area > 0, F.lit(False)), F.coalesce(count >= 0, F.lit(False))
    checks = [
        (~given("type"), "missing type"),
        (given("area") & ~area_ok, "invalid area"),
        (given("count") & ~count_ok, "invalid count"),
        (~(given("area") & area_ok) & ~(given("count") & count_ok & (count > 0)), "needs area or count"),
    ]
    return rows.withColumn("errors", F.array_compact(F.array(*(F.when(c, m) for c, m in checks))))


def actuals(boxes: DataFrame, *keys: str) -> DataFrame:
    """Placed area and count by keys; the box area is w * h."""
    return boxes.groupBy(*keys).agg(F.sum(F.col("w").cast("long") * F.col("h")).alias("actual_area"), F.count(F.lit(1)).alias("actual_count"))


def against_targets(mix: DataFrame, boxes: DataFrame) -> DataFrame:
    """mix(plan_id, type, target_area, tolerance, priority weight) with actual_area, actual_count, delta, within and ratio. Boxes are summed
    before the join; types match by their base name."""
    placed = actuals(boxes.withColumn("base", text.base_type(F.col("type"))), "plan_id", "base")
    out = mix.withColumn("base", text.base_type(F.col("type"))).join(placed, ["plan_id", "base"], "left").fillna(0, ["actual_area", "actual_count"])
    out = out.withColumn("delta", F.col("actual_area") - F.col("target_area")).withColumn("tol", text.tolerance(F.col("tolerance")))
    out = out.withColumn("within", F.abs("delta") <= text.allowed(F.col("tol"), F.col("target_area")))
    return out.withColumn("ratio", F.when(F.col("target_area") > 0, F.greatest(F.lit(0.0), 1 - F.abs("delta") / F.col("target_area"))).otherwise(0.0))


def normalised_distribution(ranges: DataFrame) -> DataFrame:
    """(plan_id, size_range, weight) with share: weights over 1.01 are percents; shares of a plan sum to 1; place by lower bound."""
    w = F.when(F.col("weight") > 1.01, F.col("weight") / 100).otherwise(F.col("weight"))
    total = ranges.withColumn("share", w).where("share >= 0").groupBy("plan_id").agg(F.sum("share").alias("total"))
    return ranges.withColumn("share", w).join(total.where("total > 0"), "plan_id").withColumn("share", F.col("share") / F.col("total")).drop("total")


def bucketed_distribution(ranges: DataFrame) -> DataFrame:
    """Shares of S (to 2), M (to 5), L (to 10) and XL by range midpoints, in percents with two places; 25/35/25/15 for none."""
    w = F.when(F.col("weight") > 1.01, F.col("weight") / 100).otherwise(F.col("weight"))
    mid = text.range_midpoint(F.col("size_range"))
    known = ranges.withColumn("share", F.when((F.col("weight") > 0) & mid.isNotNull(), w).otherwise(0.0)).withColumn("mid", mid)
    bands = {"S": F.col("mid") <= 2, "M": (F.col("mid") > 2) & (F.col("mid") <= 5), "L": (F.col("mid") > 5) & (F.col("mid") <= 10), "XL": F.col("mid") > 10}
    sums = known.groupBy("plan_id").agg(F.sum("share").alias("total"), *(F.sum(F.when(c, F.col("share")).otherwise(0.0)).alias(k) for k, c in bands.items()))
    default = {"S": 25.0, "M": 35.0, "L": 25.0, "XL": 15.0}
    return sums.select("plan_id", *(F.when(F.col("total") > 0, F.floor(F.col(k) / F.col("total") * 10000 + 0.5) / 100).otherwise(default[k]).alias(k.lower()) for k in bands))


def matched(mix: DataFrame, boxes: DataFrame) -> DataFrame:
    """mix(plan_id, line_no, type) with actual_area, actual_count and rule: the boxes of the same type; where there are none those of
    the same base name; where there are none those of the same base name whatever the case. Boxes are summed before each join."""
    base = lambda c: text.base_type(F.col(c))
    out = mix
    for k, (ours, theirs) in enumerate([(F.col("type"), F.col("type")), (base("type"), base("type")), (F.lower(base("type")), F.lower(base("type")))]):
        sums = actuals(boxes.withColumn("_key", theirs), "plan_id", "_key").withColumnsRenamed({"actual_area": f"_area{k}", "actual_count": f"_count{k}"})
        out = out.withColumn("_key", ours).join(sums, ["plan_id", "_key"], "left").drop("_key")
    rule = F.coalesce(*(F.when(F.col(f"_count{k}") > 0, name) for k, name in enumerate(("exact", "base", "any case"))), F.lit("none"))
    pick = lambda c: F.coalesce(*(F.col(f"{c}{k}") for k in range(3)), F.lit(0))
    return out.withColumns({"actual_area": pick("_area"), "actual_count": pick("_count"), "rule": rule}).drop(*(f"_{c}{k}" for c in ("area", "count") for k in range(3)))


def report(mix: DataFrame, boxes: DataFrame) -> DataFrame:
    """mix(plan_id, type, target_area, target_count, tolerance, priority: text) against the boxes of the same base name: delta_area,
    delta_count, within (both where both are given), ratio (by area, else by count) and weight (a priority that is no number, or 0,
    weighs 1)."""
    placed = actuals(boxes.withColumn("base", text.base_type(F.col("type"))), "plan_id", "base")
    out = mix.withColumn("base", text.base_type(F.col("type"))).join(placed, ["plan_id", "base"], "left").fillna(0, ["actual_area", "actual_count"])
    tol = text.tolerance(F.col("tolerance"))
    parts = {}
    for kind in ("area", "count"):
        target, delta = F.col(f"target_{kind}"), F.col(f"actual_{kind}") - F.col(f"target_{kind}")
        parts[kind] = (delta, F.abs(delta) <= text.allowed(tol, target), F.when(target > 0, F.greatest(F.lit(0.0), 1 - F.abs(delta) / target)).otherwise(F.when(target.isNotNull(), 0.0)))
    weight = F.coalesce(F.nullif(text.number(F.coalesce("priority", F.lit(""))), F.lit(0.0)), F.lit(1.0))
    within = F.when(parts["area"][1].isNull(), parts["count"][1]).when(parts["count"][1].isNull(), parts["area"][1]).otherwise(parts["area"][1] & parts["count"][1])
    return out.withColumns({"delta_area": parts["area"][0], "delta_count": parts["count"][0], "within": within, "ratio": F.coalesce(parts["area"][2], parts["count"][2], F.lit(0.0)), "weight": weight})


def type_by_target(area: Column, targets: list[tuple[str, float, float, float]]) -> Column:
    """Type of an area from (type, least, most, target): the first range that holds it, else the nearest target (the first of equal ones)
    if it is at most half of itself away; else by general limits."""
    inside = [F.when(area.between(lo, hi), kind) for kind, lo, hi, _ in targets]
    near = F.array_min(F.array(*(F.struct(F.abs(area - t).alias("d"), F.lit(i).alias("i"), F.lit(float(t)).alias("t"), F.lit(kind).alias("kind")) for i, (kind, _, _, t) in enumerate(targets))))
    general = F.when(area < 6, "single").when(area < 12, "double").when(area < 20, "team").otherwise("meeting")
    return F.coalesce(*inside, F.when(near["d"] <= near["t"] * 0.5, near["kind"]), general)
