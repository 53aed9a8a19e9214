"""Drawing standards: colours of the index palette, roles of entities, compliance with layer standards, box templates, units."""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planfold.functions.text import layer_name
from planfold.operators import classify

#: Known entries of the colour index as index: red green blue. All others lie between.
PALETTE_ANCHORS = """
0: 0 0 0; 1: 255 0 0; 2: 255 255 0; 3: 0 255 0; 4: 0 255 255; 5: 0 0 255; 6: 255 0 255; 7: 255 255 255; 8: 128 128 128; 9: 192 192 192;
10: 255 0 0; 11: 255 127 127; 12: 204 0 0; 13: 204 102 102; 14: 153 0 0; 15: 153 76 76; 16: 127 0 0; 17: 127 63 63; 18: 76 0 0; 19: 76 38 38;
20: 255 63 0; 21: 255 159 127; 22: 204 51 0; 23: 204 127 102; 24: 153 38 0; 25: 153 95 76; 26: 127 31 0; 27: 127 79 63; 28: 76 19 0; 29: 76 47 38;
30: 255 127 0; 40: 255 191 0; 50: 255 255 0; 60: 191 255 0; 70: 127 255 0; 80: 63 255 0;
90: 0 255 0; 91: 0 227 0; 92: 0 191 0; 93: 0 159 0; 94: 0 127 0; 100: 0 255 63; 110: 0 255 127; 120: 0 255 191; 130: 0 255 255;
140: 0 191 255; 150: 0 127 255; 160: 0 63 255; 170: 0 0 255; 171: 0 0 227; 172: 0 0 191; 173: 0 0 159; 174: 0 0 127;
180: 63 0 255; 190: 127 0 255; 200: 191 0 255; 210: 255 0 255; 220: 255 0 191;
250: 51 51 51; 251: 91 91 91; 252: 132 132 132; 253: 173 173 173; 254: 214 214 214; 255: 255 255 255
"""
#: Classes of colour indices; the first list that holds an index decides.
COLOUR_CLASSES = [("entrance", [1, 10, 20, 30]), ("forbidden", [4, 5, 140, 150, 160, 170]), ("wall", [0, 7, 8, 9, 250, 251, 252, 253, 254, 255]), ("corridor", [2, 50, 60])]
#: Type, pattern of its layer names, and its colour.
CAD_STANDARDS = [
    ("walls", "^(A-WALL|WALLS|MUR)$", (0, 0, 0)),
    ("entrances", "^(A-DOOR|ENTRANCES|ENTREE_+SORTIE)$", (255, 0, 0)),
    ("forbiddenZones", "^(A-FLOR-FBDN|FORBIDDEN|NO_+ENTREE)$", (0, 0, 255)),
    ("windows", "^(A-GLAZ|WINDOWS|FENETRE)$", (0, 255, 255)),
    ("columns", "^(A-COLS|COLUMNS|POTEAU)$", (255, 255, 0)),
]
#: Roles that shapes are routed to, and the least areas from which a closed line without one is an envelope or an obstacle.
ROUTED, ENVELOPE_AREA, OBSTACLE_AREA = ["ENVELOPE", "OBSTACLES", "FORBIDDEN", "EXITS", "FIRE_DOORS", "WALLS"], 500, 10
#: Metres in a drawing unit by unit code.
UNIT_METRES = {0: 1.0, 1: 0.0254, 2: 0.3048, 3: 1609.344, 4: 0.001, 5: 0.01, 6: 1.0, 7: 1000.0, 8: 0.0000000254, 9: 0.0000254, 10: 0.9144, 14: 0.1, 15: 10.0, 16: 100.0}


@cache
def palette() -> list[tuple[int, int, int]]:
    """256 colours: the anchors, and between them steps from the entry before towards the next anchor, rounded one by one."""
    known = {int(i): tuple(map(int, rgb.split())) for i, rgb in (x.split(":") for x in PALETTE_ANCHORS.split(";"))}
    out: list[tuple[int, int, int]] = []
    for i in range(256):
        after = min(k for k in known if k >= i)
        out.append(known[i] if after == i else tuple(math.floor(a + (b - a) / (after - i + 1) + 0.5) for a, b in zip(out[-1], known[after], strict=True)))
    return out


def _palette_array() -> Column:
    return F.expr("array(" + ", ".join(f"named_struct('r', {r}, 'g', {g}, 'b', {b}, 'i', {i})" for i, (r, g, b) in enumerate(palette())) + ")")


def colour_class(index: Column) -> Column:
    """struct(type, confidence) of a colour index: listed ones first, then by the palette's colour; others are walls with little
    confidence."""
    pair = lambda t, c: F.struct(F.lit(t).alias("type"), F.lit(c).alias("confidence"))
    at = lambda k: F.get(_palette_array(), F.least(F.greatest(index, F.lit(0)), F.lit(255)))[k]
    r, g, b = at("r"), at("g"), at("b")
    rule = None
    for kind, listed in COLOUR_CLASSES:
        rule = F.when(index.isin(listed), pair(kind, 0.9)) if rule is None else rule.when(index.isin(listed), pair(kind, 0.9))
    rule = rule.when((r > 200) & (g < 100) & (b < 100), pair("entrance", 0.7)).when((b > 200) & (r < 100) & (g < 100), pair("forbidden", 0.7))
    return rule.when((r < 100) & (g < 100) & (b < 100), pair("wall", 0.6)).when((r > 200) & (g > 200) & (b > 200), pair("wall", 0.5)).otherwise(pair("wall", 0.3))


def colour_index(value: Column) -> Column:
    """Index of a drawing's colour value: up to 255 it is one; above, it is red * 65536 + green * 256 + blue and takes the nearest entry
    (ties: the smaller index); null and negative values are 0."""
    part = lambda n: F.shiftright(value.cast("long"), n).bitwiseAND(F.lit(255))
    r, g, b = part(16), part(8), part(0)
    far = lambda p: (p["r"] - r) * (p["r"] - r) + (p["g"] - g) * (p["g"] - g) + (p["b"] - b) * (p["b"] - b)
    near = F.array_min(F.transform(_palette_array(), lambda p: F.struct(far(p).alias("d"), p["i"].alias("i"))))["i"]
    return F.when(value > 255, near).when(value >= 0, F.floor(value).cast("int")).otherwise(0)


def routed(entities: DataFrame) -> DataFrame:
    """entities(layer, entity_type, closed, area) with role: the standard type of the layer, exits for names with both ENTREE and SORTIE,
    walls for other lines, and for other closed lines envelope or obstacle by area; null for none."""
    layers = classify.with_standard_type(entities.select("layer").distinct()).withColumnRenamed("layer", "_layer")
    out = entities.join(layers, F.coalesce("layer", F.lit("")) == F.coalesce("_layer", F.lit("")), "left")
    both = F.col("layer").contains("ENTREE") & F.col("layer").contains("SORTIE")
    closed = (F.col("entity_type") == "LWPOLYLINE") & F.col("closed")
    rule = F.when(F.col("standard").isNotNull(), F.col("standard")).when(both, "EXITS").when(F.col("entity_type") == "LINE", "WALLS").when(closed & (F.col("area") > ENVELOPE_AREA), "ENVELOPE").when(closed & (F.col("area") > OBSTACLE_AREA), "OBSTACLES")
    return out.withColumn("role", rule).withColumn("counts", F.coalesce(F.col("role").isin(ROUTED), F.lit(False)) | (F.col("standard").isNull() & closed)).drop("_layer", "standard")


def envelopes(entities: DataFrame) -> DataFrame:
    """routed entities(plan_id, x, y, w, h) -> the envelope of each plan: its largest envelope shape, else the bounds of all that counts."""
    box = F.struct(F.col("x").alias("min_x"), F.col("y").alias("min_y"), (F.col("x") + F.col("w")).alias("max_x"), (F.col("y") + F.col("h")).alias("max_y"))
    own = F.max_by(F.when(F.col("role") == "ENVELOPE", box), F.when(F.col("role") == "ENVELOPE", F.struct("area", "entity_id")))
    around = F.struct(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max(F.col("x") + F.col("w")).alias("max_x"), F.max(F.col("y") + F.col("h")).alias("max_y"))
    return entities.where("counts").groupBy("plan_id").agg(own.alias("own"), around.alias("around")).select("plan_id", F.coalesce("own", "around").alias("b"), F.when(F.col("own").isNotNull(), "drawn").otherwise("bounds").alias("source")).select("plan_id", "b.*", "source")


def with_compliance(entities: DataFrame, kind: str = "kind") -> DataFrame:
    """entities(layer, rgb, kind) with issues: what departs from the standard of its type; none for types without a standard."""
    name, said = layer_name(F.col("layer")), F.coalesce("rgb", F.lit(0)).cast("long")
    part = lambda n: F.shiftright(said, n).bitwiseAND(F.lit(255))
    colour = F.array_join(F.array(*(part(n).cast("string") for n in (16, 8, 0))), ",")
    rule = F.array().cast("array<string>")
    for key, pattern, rgb in CAD_STANDARDS:
        wanted = ",".join(map(str, rgb))
        layer = F.when(~name.rlike(f"(?i){pattern}"), F.concat(F.lit("layer "), name, F.lit(" is not of "), F.lit(key)))
        shade = F.when(colour != wanted, F.concat(F.lit("colour "), colour, F.lit(f" is not {wanted}")))
        rule = F.when(F.col(kind) == key, F.array_compact(F.array(layer, shade))).otherwise(rule)
    return entities.withColumn("issues", rule)


def checked_templates(configs: DataFrame) -> DataFrame:
    """configs(name, min_area, max_area, width, depth, aspect: structs of min and max) with defaults for what is missing or 0, and error:
    the first range that doesn't rise; null for a valid template. Names come out in upper case; a missing name is an error."""
    number = lambda c, d: F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), F.lit(d))
    span = lambda c, lo, hi: F.coalesce(c, F.struct(F.lit(lo).alias("min"), F.lit(hi).alias("max")))
    out = configs.withColumns({"min_area": number("min_area", 0.5), "max_area": number("max_area", 20.0), "width": span("width", 0.8, 5.0), "depth": span("depth", 0.8, 5.0), "aspect": span("aspect", 0.6, 1.4)})
    falls = lambda c: F.col(c)["min"] >= F.col(c)["max"]
    error = F.when(F.coalesce(F.col("name"), F.lit("")) == "", "name").when(F.col("min_area") >= F.col("max_area"), "area").when(falls("width"), "width").when(falls("depth"), "depth").when(falls("aspect"), "aspect")
    return out.withColumn("error", error).withColumn("name", F.upper("name"))


def metres(code: Column, width: Column, height: Column) -> Column:
    """Metres in a drawing unit: by unit code where it is known and not 0, else by the extent."""
    known = F.coalesce(*(F.when(code == k, m) for k, m in UNIT_METRES.items() if k))
    usual = width.between(5, 500) & height.between(5, 500)
    by_extent = F.when(usual, 1.0).when(width.between(1000, 1000000), 0.001).when(width.between(100, 50000) & (height >= 100), 0.01).when((width < 5) & (height < 5), 10.0).otherwise(1.0)
    return F.coalesce(known, by_extent)
