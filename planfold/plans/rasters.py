"""Queries on free regions, rendered pages and the clean-up of whole layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from planfold.catalog import query
from planfold.operators import cleanup, pages, raster


@query("R10_storage_regions")
def r10_storage(v):
    """Regions of 20 square metres that walls, zones and exits with their buffers leave free, on a raster of half a metre."""
    exits = v.exits.select("plan_id", "x", "y", F.lit(0).alias("w"), F.lit(0).alias("h"))
    return raster.free_regions(v.plans, v.walls, v.zones, exits)


def entrances(v):
    """Squares of 66 cm about the exits."""
    return v.exits.select("plan_id", "exit_id", (F.col("x") - 33).alias("x"), (F.col("y") - 33).alias("y"), F.lit(66).alias("w"), F.lit(66).alias("h"))


@query("J24_layout_cleanup")
def j24_cleanup(v):
    """What a final clean-up keeps and removes, by reason."""
    return cleanup.cleaned_layout(v.plans, v.boxes, v.corridors, v.walls, v.zones, entrances(v))


_COLORS = {"green": "g > 130 and r < 140 and b < 140", "blue": "b > 130 and r < 140 and g < 160", "red": "r > 140 and g < 120 and b < 120", "black": "r < 80 and g < 80 and b < 80", "white": "r > 230 and g > 230 and b > 230", "non_white": "not (r > 230 and g > 230 and b > 230)"}
_SPECS = ", ".join(f"('{n}', {a}::double, {b}::double, {c}::double, {d}::double)" for n, (a, b, c, d) in pages.REGIONS.items())
_SIGNS = ", ".join(f"avg(case when {t} then 1.0 else 0 end) as {n}" for n, t in _COLORS.items())


def _m(side: str, region: str, name: str) -> str:
    return f"coalesce(max(case when side = '{side}' and region = '{region}' then {name} end), 0) as {side[0]}_{region}_{name}"


_NEEDED = ", ".join(_m(s, r, n) for s in ("generated", "reference") for r in pages.REGIONS for n in [*_COLORS, "edge"])


def _occupied(region: str, a: float, sa: float, b: float, sb: float) -> str:
    return f"g_{region}_non_white >= greatest({a}, r_{region}_non_white * {sa}) and g_{region}_black >= greatest({b}, r_{region}_black * {sb})"


_BORDER = " + ".join(f"(g_{s}_non_white >= greatest(0.0015, r_{s}_non_white * 0.40))::int" for s in pages.SIDES)
_GREEN = [" + ".join(f"{s[0]}_{x}_green" for x in pages.SIDES) for s in ("generated", "reference")]
_GATES = {
    "page_count_match": "doc % 4 <> 3", "aspect_ratio_close": "(doc % 3) * 0.1 <= 0.12", "similarity_minimum": "similarity >= 0.82", "mae_within_limit": "mae <= 85", "rmse_within_limit": "rmse <= 110", "blue_ratio_delta_within_limit": "abs(g_page_blue - r_page_blue) <= 0.03",
    "non_white_ratio_delta_within_limit": "abs(g_page_non_white - r_page_non_white) <= 0.30", "has_blue_structure": "g_page_blue >= 0.0010", "has_red_radiators": "g_page_red >= greatest(0.00001, r_page_red * 0.15)", "has_green_border": "g_page_green >= 0.00002", "has_nonwhite_content": "g_page_non_white >= 0.03",
    "structural_border_presence": f"({_BORDER}) >= 3 and ({_GREEN[0]}) / 4 >= greatest(0.00005, ({_GREEN[1]}) / 4 * 0.35)", "structural_title_block_occupancy": _occupied("title_block", 0.018, 0.45, 0.0004, 0.35), "structural_legend_region_occupancy": _occupied("legend", 0.025, 0.45, 0.00035, 0.35),
    "structural_wall_context_presence": _occupied("drawing_context", 0.050, 0.55, 0.0006, 0.35) + " and g_drawing_context_edge >= greatest(0.010, r_drawing_context_edge * 0.45)",
}
_GATES["structural_checks_pass"] = " and ".join(f"({t})" for n, t in _GATES.items() if n.startswith("structural"))
_PAGE = f"""with e as (select event_id // 2048 as doc, event_id % 64 as x, event_id // 64 % 32 as y, event_id * 7 % 256 as r, event_id * 13 % 256 as g, user_id * 5 % 256 as b, event_id % 5 as kind from events),
  pix as (select doc, 'reference' as side, x, y, case when kind < 2 then 255 else r end as r, case when kind < 2 then 255 else g end as g, case when kind < 2 then 255 else b end as b from e union all select doc, 'generated', x, y, case when kind < 1 then 255 else (r + x) % 256 end, case when kind < 1 then 255 else (g + y % 9) % 256 end, case when kind < 1 then 255 else b end from e),
  spec(region, sx0, sy0, sx1, sy1) as (values {_SPECS}), reg as (select region, greatest(0, least(63, floor(sx0 * 64)))::int as x0, greatest(0, least(31, floor(sy0 * 32)))::int as y0, sx1, sy1 from spec),
  bnd as (select region, x0, y0, greatest(x0 + 1, least(64, floor(sx1 * 64)))::int as x1, greatest(y0 + 1, least(32, floor(sy1 * 32)))::int as y1 from reg),
  inr as (select pix.*, region, x - x0 as dx, y - y0 as dy, x1 - x0 as w, y1 - y0 as h, (77 * r + 150 * g + 29 * b) >> 8 as l from pix join bnd on x >= x0 and x < x1 and y >= y0 and y < y1),
  cl as (select doc, side, region, {_SIGNS} from inr group by all),
  ed as (select a.doc, a.side, a.region, avg(case when abs(a.l - b.l) > 28 or abs(a.l - c.l) > 28 then 1.0 else 0 end) as edge from inr a join inr b on b.doc = a.doc and b.side = a.side and b.region = a.region and b.dx = a.dx + 2 and b.dy = a.dy join inr c on c.doc = a.doc and c.side = a.side and c.region = a.region and c.dx = a.dx and c.dy = a.dy + 2
    where a.dx % 2 = 0 and a.dy % 2 = 0 and a.dx < a.w - 2 and a.dy < a.h - 2 group by all),
  wide as (select doc, {_NEEDED} from cl left join ed using (doc, side, region) group by doc),
  dif as (select doc, sum(abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b)) / 3.0 / count(*) as mae, sqrt(sum(pow(a.r - b.r, 2) + pow(a.g - b.g, 2) + pow(a.b - b.b, 2)) / 3.0 / count(*)) as rmse from pix a join pix b using (doc, x, y) where a.side = 'generated' and b.side = 'reference' group by doc),
  gate as (select *, {', '.join(f'{t} as {n}' for n, t in _GATES.items())} from (select *, greatest(0, 1 - mae / 255) as similarity from wide join dif using (doc)) t)
  select doc, round(mae, 4) as mae, round(rmse, 4) as rmse, round(similarity, 6) as similarity, {', '.join(f'round(abs(g_page_{c} - r_page_{c}), 6) as {c}_ratio_delta' for c in ('green', 'blue', 'red', 'black', 'non_white'))}, round(g_page_edge, 6) as edge_density, round(r_page_edge, 6) as reference_edge_density, {', '.join(_GATES)}, {' and '.join(_GATES)} as passed from gate"""


@query("A28_page_gates", _PAGE)
def a28_gates(v):
    """Pages of 64 by 32 pixels from events: a reference page and one drawn from it, compared by all gates."""
    e = v.raw("events").select(F.floor(F.col("event_id") / 2048).alias("doc"), (F.col("event_id") % 64).alias("x"), (F.floor(F.col("event_id") / 64) % 32).alias("y"), (F.col("event_id") * 7 % 256).alias("r"), (F.col("event_id") * 13 % 256).alias("g"), (F.col("user_id") * 5 % 256).alias("b"), (F.col("event_id") % 5).alias("kind"))
    drawn = {"r": (F.col("r") + F.col("x")) % 256, "g": (F.col("g") + F.col("y") % 9) % 256, "b": F.col("b")}
    of = lambda side, blank, c: F.struct(F.lit(side).alias("side"), *(F.when(F.col("kind") < blank, 255).otherwise(c[k]).alias(k) for k in "rgb"))
    pixels = e.select("doc", "x", "y", F.inline(F.array(of("reference", 2, {k: F.col(k) for k in "rgb"}), of("generated", 1, drawn))))
    sheets = e.select("doc").distinct().select("doc", F.lit(64).alias("width"), F.lit(32).alias("height"), ((F.col("doc") % 3) * 0.1).alias("aspect_difference"), (F.col("doc") % 4 != 3).alias("same_page_count"))
    g = pages.page_gates(pixels, sheets)
    return g.withColumns({c: F.round(c, 4 if c in ("mae", "rmse") else 6) for c, kind in g.dtypes if kind == "double"})
