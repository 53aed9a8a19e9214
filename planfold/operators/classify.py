"""Classification of CAD entities by layer names and colours. Rules are ordered: the first that matches decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planfold.functions.geometry import once
from planfold.functions.text import layer_name

#: Words in normalised layer names and the class they give, in order; then names that must match whole.
CLASS_WORDS = [
    ("envelope", 0.95, ["ENVELOPE", "PERIMETER", "BOUNDARY", "EXTERNAL", "OUTLINE"], []),
    ("entrance", 0.9, ["ENTRANCE", "EXIT", "DOOR", "OPENING", "RED"], ["ENTREE_SORTIE"]),
    ("forbidden", 0.9, ["FORBIDDEN", "STAIR", "ELEVATOR", "LIFT", "BLUE", "RESTRICT"], ["NO_ENTREE", "CABINETRY", "LIGHTING", "POWER", "APPLIANCES"]),
    ("wall", 0.9, ["WALL"], ["MUR", "0"]),
]
#: Names of layers for each standard type; the first type with a name in the layer wins.
STANDARD = [
    ("ENVELOPE", ["ENVELOPE", "PERIMETER", "BOUNDARY", "USABLE_AREA", "FLOOR_PLAN"]),
    ("OBSTACLES", ["OBSTACLES", "COLUMNS", "DUCTS", "TECHNICAL_ROOMS", "OBSTACLE"]),
    ("FORBIDDEN", ["FORBIDDEN", "NO_ENTREE", "PROHIBITED", "SMOKE_EXTRACTION", "SHAFTS", "VOIDS", "RESTRICTED"]),
    ("EXITS", ["EXITS", "ENTREE_SORTIE", "ENTREE__SORTIE", "ENTREE-SORTIE", "STAIRS", "ELEVATORS", "FREIGHT_ELEVATORS", "DOORS", "EXIT"]),
    ("FIRE_DOORS", ["FIRE_DOORS", "FIRE_DOOR", "ACCESS_CONTROL", "SECURITY_DOORS"]),
    ("WALLS", ["WALLS", "MUR", "STRUCTURE", "STRUCTURAL_WALLS"]),
    ("BOXES", ["BOXES", "STORAGE_UNITS", "ILOTS", "UNITS"]),
    ("TOLE_BLANCHE", ["TOLE_BLANCHE", "TOLE BLANCHE", "WHITE_PARTITION"]),
    ("TOLE_GRISE", ["TOLE_GRISE", "TOLE GRISE", "GREY_PARTITION"]),
    ("CORRIDORS", ["CORRIDORS", "CIRCULATION", "ACCESS", "PATHS", "LIGNE_CIRCULATION"]),
    ("MAIN_ARTERIES", ["MAIN_ARTERIES", "ARTERY", "MAIN_CORRIDOR"]),
    ("RADIATORS", ["RADIATORS", "RADIATEUR", "HEATING", "CHAUFFAGE"]),
    ("DIMENSIONS", ["DIMENSIONS", "DIM", "MEASUREMENTS"]),
    ("TEXT", ["TEXT", "ANNOTATIONS", "LABELS", "NOTES"]),
]
REQUIRED = ["ENVELOPE", "OBSTACLES", "EXITS"]
#: Words of the semantic roles, English and French.
ROLES = {
    "envelope": "wall|mur|cloison|envelope|facade|boundary|perimetre|contour",
    "obstacles": "column|poteau|pillar|pilier|shaft|gaine|duct|conduit|stair|escalier|marche|palier|elevator|ascenseur|lift|monte|void|tremie|opening|ouverture|beam|poutre|structure|radiateur|radiator|chauffage|heating|ventil|hvac|cvc|clima",
    "forbidden": "forbidden|interdit|exclusion|zone_exclu|service|technique|technical|local_tech|wc|toilet|sanitary|sanitaire|douche|shower|reserve|storage|rangement|stockage|kitchen|cuisine|kitchenette",
    "exits": "exit|sortie|door|porte|entrance|entree|acces|access|emergency|urgence|secours|evacuation|issue|degagement",
    "circulation": "corridor|couloir|circulation|passage|hall|lobby|palier|landing",
    "gray": "tole|gris|gray|grey|metal|acier|steel",
}


def entity_class(layer: Column, color: Column, closed: Column) -> Column:
    """struct(type, confidence): layer words first; then green closed polygons are envelopes, cyan is an entrance, dashed layers are
    forbidden; the rest are walls with little confidence."""
    pair = lambda t, c: F.struct(F.lit(t).alias("type"), F.lit(c).alias("confidence"))

    def said(name):
        rule = None
        for kind, confidence, words, whole in CLASS_WORDS:
            test = name.rlike("|".join(words)) | name.isin(*whole) if whole else name.rlike("|".join(words))
            rule = F.when(test, pair(kind, confidence)) if rule is None else rule.when(test, pair(kind, confidence))
        rule = rule.when((color == 3) & closed, pair("envelope", 0.8)).when((color == 4) | name.contains("CYAN"), pair("entrance", 0.95))
        return rule.when(name.contains("DASHED"), pair("forbidden", 0.95)).otherwise(pair("wall", 0.6))

    return once(layer_name(layer), said)


def with_standard_type(layers: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """layers(layer) with standard: the type of the user's override for the layer, else the first standard type with one of its names
    in the upper-case layer name; null for none. Every layer name is matched once, whatever number of entities it has."""
    said = F.upper(F.trim("layer"))
    rule = F.lit(None).cast("string")
    for kind, names in reversed(STANDARD):
        has = F.lit(False)
        for n in names:
            has = has | said.contains(n)
        rule = F.when(has, kind).otherwise(rule)
    out = layers.withColumn("standard", rule)
    if overrides is not None:
        custom = overrides.select(F.upper(F.trim("layer")).alias("_layer"), F.col("standard").alias("_own"))
        out = out.join(custom, said == F.col("_layer"), "left").withColumn("standard", F.coalesce("_own", "standard")).drop("_layer", "_own")
    return out


def role(layer: Column) -> Column:
    """Semantic role of a layer name, or 'other'."""
    rule = None
    for name, words in ROLES.items():
        test = F.lower(layer).rlike(words)
        rule = F.when(test, name) if rule is None else rule.when(test, name)
    return rule.otherwise("other")


#: Words of layers that make a line an entrance or forbidden; colours that do so by themselves.
LINE_WORDS = {"entrance": (1, "ENTRANCE|EXIT|DOOR|OPENING"), "forbidden": (5, "FORBIDDEN|STAIR|ELEVATOR|LIFT|SHAFT|COLUMN|OBSTACLE")}


def line_class(layer: Column, color: Column) -> Column:
    """entrance, forbidden or wall: by colour or the layer's words, in this order; everything else is a wall."""
    name = layer_name(layer)
    return F.coalesce(*(F.when((color == code) | name.rlike(words), kind) for kind, (code, words) in LINE_WORDS.items()), F.lit("wall"))


#: Kinds of text labels and their patterns on the text, in order; notices are kept once a plan and text.
LABELS = [("number", "^[0-9]{1,2}$"), ("room", "^RM-[0-9]+$"), ("green_zone", "(?i)^Ex[0-9]+$"), ("dimension", r"(?i)^[0-9]+(\.[0-9]+)?\s*m$")]
NOTICES = "ZERO LINE|ROOF THROUGH|EXIT AREA|TO EXIT"
FUNCTIONS = [("LOADING BAY", "LOADING|BAY"), ("MAIN ACCESS", "MAIN.*ACCESS|ACCESS.*MAIN"), ("EXIT DOOR", "EXIT|SORTIE")]


def text_labels(texts: DataFrame) -> DataFrame:
    """texts(plan_id, text_id, text, ...) -> the same with kind and label, a row for each that a text gives (a notice may name a function as well).
    Of equal notices of a plan the one with the least text_id stays; room numbers go from 1 to 26."""
    upper = F.upper("text")
    one = lambda test, kind, label: F.when(test, F.struct(F.lit(kind).alias("kind"), label.alias("label")))
    number = F.col("text").rlike(LABELS[0][1]) & F.expr("try_cast(text as int)").between(1, 26)
    said = [one(number, "number", F.expr("cast(try_cast(text as int) as string)"))] + [one(F.col("text").rlike(p), kind, F.col("text")) for kind, p in LABELS[1:]]
    function = F.coalesce(*(F.when(upper.rlike(p), name) for name, p in FUNCTIONS))
    said += [one(upper.rlike(NOTICES), "notice", F.col("text")), one(function.isNotNull(), "function", function)]
    rows = texts.select("*", F.inline(F.array_compact(F.array(*said))))
    first = rows.where("kind = 'notice'").groupBy("plan_id", "label").agg(F.min("text_id").alias("_first"))
    rows = rows.join(first, ["plan_id", "label"], "left").where("kind <> 'notice' or text_id = _first").drop("_first")
    return rows.select(*texts.columns, "kind", "label")
