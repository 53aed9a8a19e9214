"""Text rules as column expressions: layer names, type names, tolerances, size ranges, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters of western European layer names and their base letters.
ACCENTS, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
#: Standard unit sizes in square metres.
UNIT_SIZES = [0.5, 1, 1.5, 2, 2.5, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 15, 18, 20, 25]


def layer_name(raw: Column) -> Column:
    """Upper-case letters, digits and single underscores; null as ''."""
    said = F.upper(F.trim(F.translate(F.coalesce(raw, F.lit("")), ACCENTS, PLAIN)))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(said, "[^A-Z0-9_]", "_"), "_+", "_"), "^_+|_+$", "")


def base_type(raw: Column) -> Column:
    """Leading letters and digits ('S (small)' -> 'S'); the whole trimmed text where there are none; blank as null."""
    text = F.nullif(F.trim(raw), F.lit(""))
    head = F.regexp_extract(text, "^([A-Za-z0-9]+)", 1)
    return F.when(head != "", head).otherwise(text)


def number(raw: Column) -> Column:
    """A decimal number, with a comma or point, at the start of a text; else null."""
    return F.regexp_extract(F.regexp_replace(F.trim(raw), "^([^,]*),", "$1."), r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))", 1).try_cast("double")


def tolerance(raw: Column) -> Column:
    """struct(kind, value): 'percentage' with a % sign, else 'absolute'; missing: 0 percent; not a number or negative: 0."""
    value = F.trim(F.regexp_replace(raw, "%", "")).try_cast("double")
    kind = F.when(F.coalesce(raw, F.lit("")).isin("", "0") | raw.contains("%"), "percentage").otherwise("absolute")
    return F.struct(kind.alias("kind"), F.when(value >= 0, value).otherwise(0.0).alias("value"))


def allowed(tol: Column, target: Column) -> Column:
    """A tolerance resolved against a target."""
    return F.when(tol["kind"] == "percentage", target * tol["value"] / 100).otherwise(tol["value"])


def range_midpoint(raw: Column) -> Column:
    """Midpoint of 'a-b'; S, M, L and XL have fixed ones; else null."""
    text = F.trim(raw)
    fixed = F.when(F.upper(text) == "S", 1.0).when(F.upper(text) == "M", 3.5).when(F.upper(text) == "L", 7.5).when(F.upper(text) == "XL", 12.0)
    pattern = r"^(-?\d+(?:\.\d+)?)\s*-\s*(-?\d+(?:\.\d+)?)$"
    ends = [F.regexp_extract(text, pattern, i).try_cast("double") for i in (1, 2)]
    return F.coalesce(fixed, (ends[0] + ends[1]) / 2)


def unit_size(area: Column) -> Column:
    """Nearest standard size (the smaller of a tie); over 25 half steps; nothing or less as 0.5."""
    nearest = F.array_min(F.array(*(F.struct(F.abs(area - s).alias("d"), F.lit(float(s)).alias("size")) for s in UNIT_SIZES)))["size"]
    return F.when(area.isNull() | (area <= 0), 0.5).when(area > 25, F.floor(area * 2 + 0.5) / 2).otherwise(nearest)


def size_group(size: Column) -> Column:
    found = F.when(size <= 1, "A").when(size <= 2, "B").when(size <= 5, "C").when(size <= 10, "D").when(size <= 15, "E")
    return found.otherwise("F")


def padded(n: Column, width: int) -> Column:
    """Zero-padded, never cut."""
    return F.when(F.length(n.cast("string")) >= width, n.cast("string")).otherwise(F.lpad(n.cast("string"), width, "0"))


#: Schemes of box codes: prefixes of zone and row, separator, and least digits of zone, row and number.
CODE_SCHEMES = {"default": ("Z", "R", "-", (2, 2, 3)), "compact": ("", "", "", (1, 1, 2)), "verbose": ("ZONE", "ROW", "-", (2, 2, 4))}


def box_code(zone: Column, row: Column, number: Column, scheme: str = "default") -> Column:
    """Code of a box; parts without a prefix are left out, but for the number."""
    z, r, between, (dz, dr, dn) = CODE_SCHEMES[scheme]
    parts = [F.concat(F.lit(z), padded(zone, dz))] if z else []
    parts += [F.concat(F.lit(r), padded(row, dr))] if r else []
    return F.concat_ws(between, *parts, padded(number, dn))


def parsed_code(code: Column, scheme: str = "default") -> Column:
    """struct(zone, row, number) of a code; null where it has another form."""
    z, r, between, _ = CODE_SCHEMES[scheme]
    pattern = rf"{z}(\d+){between}{r}(\d+){between}(\d+)"
    part = lambda i: F.regexp_extract(code, pattern, i).try_cast("long")
    return F.when(code.rlike(pattern), F.struct(part(1).alias("zone"), part(2).alias("row"), part(3).alias("number")))


def layer_hash(name: Column) -> Column:
    """Feature of a layer name: 32-bit rolling hash (31 * h + code, wrapped to a signed int each step), unsigned, mod 1000, / 1000."""
    wrap = lambda x: F.pmod(x + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)
    codes = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: wrap(a * 31 + c))
    share = F.pmod(F.pmod(h, F.lit(4294967296)), F.lit(1000)) / 1000
    return F.when(share == 0, 0.001).otherwise(share)
