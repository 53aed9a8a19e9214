"""Rendered pages compared as tables of pixels: differences, colour classes, edges and occupancy of regions, and the gates of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Regions of a sheet as shares of its width and height (x0, y0, x1, y1).
REGIONS = {
    "page": (0.0, 0.0, 1.0, 1.0),
    "title_block": (0.72, 0.77, 0.995, 0.995),
    "legend": (0.70, 0.20, 0.995, 0.77),
    "drawing_context": (0.02, 0.04, 0.70, 0.97),
    "top": (0.0, 0.0, 1.0, 0.022),
    "bottom": (0.0, 0.978, 1.0, 1.0),
    "left": (0.0, 0.0, 0.022, 1.0),
    "right": (0.978, 0.0, 1.0, 1.0),
}
SIDES = ["top", "bottom", "left", "right"]
STEP, EDGE = 2, 28
COLORS = ["green", "blue", "red", "black", "white", "non_white"]


def color_classes(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Tests of the six classes, which may overlap."""
    white = (r > 230) & (g > 230) & (b > 230)
    return {"green": (g > 130) & (r < 140) & (b < 140), "blue": (b > 130) & (r < 140) & (g < 160), "red": (r > 140) & (g < 120) & (b < 120), "black": (r < 80) & (g < 80) & (b < 80), "white": white, "non_white": ~white}


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(77 * r + 150 * g + 29 * b, 8)


def _bounds() -> Column:
    """Regions of a page of width and height as an array of struct(region, x0, y0, x1, y1) in pixels; each has a pixel at least."""
    cut = lambda share, size: F.floor(F.lit(share) * F.col(size))
    out = []
    for name, (x0, y0, x1, y1) in REGIONS.items():
        a, b = (F.greatest(F.lit(0), F.least(F.col(s) - 1, cut(v, s))) for v, s in ((x0, "width"), (y0, "height")))
        c, d = (F.greatest(low + 1, F.least(F.col(s), cut(v, s))) for low, v, s in ((a, x1, "width"), (b, y1, "height")))
        out.append(F.struct(F.lit(name).alias("region"), a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1")))
    return F.array(*out)


def region_metrics(pixels: DataFrame, pages: DataFrame) -> DataFrame:
    """pixels(doc, side, x, y, r, g, b), pages(doc, width, height) -> doc, side, region, pixels, six ratios of colours, edge_density.

    Every STEP-th pixel of a region is compared with the next ones to the right and below. Instead of a join for each direction, a pixel
    is sent to the places that need it (its own, the one to its left, the one above it) and these are grouped, so all regions and
    directions take one shuffle and pixels of any page spread over all tasks."""
    p = pixels.join(pages.select("doc", "width", "height", _bounds().alias("regions")), "doc")
    inside = F.filter("regions", lambda t: (F.col("x") >= t["x0"]) & (F.col("x") < t["x1"]) & (F.col("y") >= t["y0"]) & (F.col("y") < t["y1"]))
    p = p.select("doc", "side", "x", "y", "r", "g", "b", F.inline(inside))
    r, g, b = (F.col(c).cast("int") for c in "rgb")
    by = p.groupBy("doc", "side", "region").agg(F.count(F.lit(1)).alias("pixels"), *(F.avg(test.cast("double")).alias(f"{name}_ratio") for name, test in color_classes(r, g, b).items()))
    dx, dy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    place = lambda px, py, role: F.struct(px.alias("px"), py.alias("py"), F.lit(role).alias("role"))
    sent = p.where((dx % STEP == 0) & (dy % STEP == 0)).select("doc", "side", "region", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), luma(r, g, b).alias("l"), F.inline(F.array(place(dx, dy, 0), place(dx - STEP, dy, 1), place(dx, dy - STEP, 2))))
    sent = sent.where((F.col("px") >= 0) & (F.col("py") >= 0) & (F.col("px") < F.col("w") - STEP) & (F.col("py") < F.col("h") - STEP))
    at = lambda role: F.max(F.when(F.col("role") == role, F.col("l"))).alias(f"l{role}")
    edges = sent.groupBy("doc", "side", "region", "px", "py").agg(at(0), at(1), at(2)).where("l0 is not null and l1 is not null and l2 is not null")
    edges = edges.groupBy("doc", "side", "region").agg(F.avg(((F.abs(F.col("l0") - F.col("l1")) > EDGE) | (F.abs(F.col("l0") - F.col("l2")) > EDGE)).cast("double")).alias("edge_density"))
    return by.join(edges, ["doc", "side", "region"], "left").fillna(0, ["edge_density"])


def differences(pixels: DataFrame) -> DataFrame:
    """pixels with sides 'generated' and 'reference' -> doc, mae, rmse, similarity, over places that both have."""
    part = lambda side: F.max(F.when(F.col("side") == side, F.struct("r", "g", "b"))).alias(side)
    both = pixels.groupBy("doc", "x", "y").agg(part("generated"), part("reference")).where("generated is not null and reference is not null")
    d = [F.col(f"generated.{c}").cast("int") - F.col(f"reference.{c}").cast("int") for c in "rgb"]
    by = both.groupBy("doc").agg((F.sum(sum(F.abs(x) for x in d)) / 3 / F.count(F.lit(1))).alias("mae"), F.sqrt(F.sum(sum(x * x for x in d)) / 3 / F.count(F.lit(1))).alias("rmse"))
    return by.withColumn("similarity", F.greatest(F.lit(0.0), 1 - F.col("mae") / 255))


def page_gates(pixels: DataFrame, pages: DataFrame) -> DataFrame:
    """pages(doc, width, height, aspect_difference, same_page_count): doc, the metrics, and the sixteen gates with passed, which is all of them."""
    m = region_metrics(pixels, pages)
    names = [f"{c}_ratio" for c in COLORS] + ["edge_density"]
    cells = [(side, region, name) for side in ("generated", "reference") for region in REGIONS for name in names]
    wide = m.groupBy("doc").agg(*(F.coalesce(F.max(F.when((F.col("side") == s) & (F.col("region") == r), F.col(n))), F.lit(0.0)).alias(f"{s}.{r}.{n}") for s, r, n in cells))
    gen, ref = (lambda r, n: F.col(f"`generated.{r}.{n}`")), (lambda r, n: F.col(f"`reference.{r}.{n}`"))
    j = wide.join(differences(pixels), "doc").join(pages.select("doc", "aspect_difference", "same_page_count"), "doc")
    least = lambda floor, share, r, n: F.greatest(F.lit(floor), ref(r, n) * share)
    sides = sum((gen(s, "non_white_ratio") >= least(0.0015, 0.40, s, "non_white_ratio")).cast("int") for s in SIDES)
    green, ref_green = sum(gen(s, "green_ratio") for s in SIDES) / 4, sum(ref(s, "green_ratio") for s in SIDES) / 4
    border = (sides >= 3) & (green >= F.greatest(F.lit(0.00005), ref_green * 0.35))
    filled = lambda r, a, b: (gen(r, "non_white_ratio") >= least(a, 0.45, r, "non_white_ratio")) & (gen(r, "black_ratio") >= least(b, 0.35, r, "black_ratio"))
    c = "drawing_context"
    context = (gen(c, "non_white_ratio") >= least(0.050, 0.55, c, "non_white_ratio")) & (gen(c, "black_ratio") >= least(0.0006, 0.35, c, "black_ratio")) & (gen(c, "edge_density") >= least(0.010, 0.45, c, "edge_density"))
    delta = lambda n: F.abs(gen("page", n) - ref("page", n))
    title, legend = filled("title_block", 0.018, 0.0004), filled("legend", 0.025, 0.00035)
    gates = {
        "page_count_match": F.col("same_page_count"), "aspect_ratio_close": F.col("aspect_difference") <= 0.12, "similarity_minimum": F.col("similarity") >= 0.82, "mae_within_limit": F.col("mae") <= 85.0, "rmse_within_limit": F.col("rmse") <= 110.0,
        "blue_ratio_delta_within_limit": delta("blue_ratio") <= 0.03, "non_white_ratio_delta_within_limit": delta("non_white_ratio") <= 0.30, "has_blue_structure": gen("page", "blue_ratio") >= 0.0010,
        "has_red_radiators": gen("page", "red_ratio") >= least(0.00001, 0.15, "page", "red_ratio"), "has_green_border": gen("page", "green_ratio") >= 0.00002, "has_nonwhite_content": gen("page", "non_white_ratio") >= 0.03,
        "structural_border_presence": border, "structural_title_block_occupancy": title, "structural_legend_region_occupancy": legend, "structural_wall_context_presence": context, "structural_checks_pass": border & title & legend & context,
    }
    passed = F.lit(True)
    for test in gates.values():
        passed = passed & test
    deltas = [delta(f"{n}_ratio").alias(f"{n}_ratio_delta") for n in ("green", "blue", "red", "black", "non_white")]
    return j.select("doc", "mae", "rmse", "similarity", *deltas, gen("page", "edge_density").alias("edge_density"), ref("page", "edge_density").alias("reference_edge_density"), *(t.alias(n) for n, t in gates.items()), passed.alias("passed"))
