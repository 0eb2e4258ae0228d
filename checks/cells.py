"""Hexagon covers, grid distances, treatment model, raster tables, profiles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from checks.derived import attr, box, check, dem, lin, pts, r, reg, shapes, table, _scatter
from landstrata.functions import geometry as g, hexgrid
from landstrata.functions.props import value_of
from landstrata.operators import cells, profile, raster, treatment
from landstrata.plans import cell_model

S0 = f"cast({hexgrid.SIDE0} as double)"
EARTH = "cast(6378137 as double)"
ROOT3 = f"cast({math.sqrt(3.0)!r} as double)"
MX = f"{EARTH} * radians({{}})"
MY = f"{EARTH} * ln(tan(pi() / 4 + radians({{}}) / 2))"


def side(res: str) -> str:
    return f"({S0} / pow(sqrt(cast(7 as double)), {res}))"


def hexed(source: str, x: str, y: str, res: str, keep: str, q: str = "q", rr: str = "r") -> str:
    """Select with the cell of mercator point ``x, y`` of each row of ``source``."""
    return rounded(f"select *, ({ROOT3} / 3 * ({x}) - ({y}) / 3) / {side(res)} as fq, (({y}) * 2 / 3) / {side(res)} as fr from {source}", keep, q, rr)


def rounded(fractions: str, keep: str, q: str = "q", rr: str = "r") -> str:
    return f"""select {keep}, cast(case when dq > dr and dq > ds then -rr - rs else rq end as bigint) as {q},
      cast(case when dq > dr and dq > ds then rr when dr > ds then -rq - rs else rr end as bigint) as {rr}
      from (select *, abs(rq - fq) as dq, abs(rr - fr) as dr, abs(rs + fq + fr) as ds from (
        select *, floor(fq + 0.5) as rq, floor(fr + 0.5) as rr, floor(-fq - fr + 0.5) as rs from ({fractions})))"""


STEPS = "greatest(abs({0}), abs({1}), abs(({0}) + ({1})))"


def cover_sql(start: int, most: int) -> str:
    """CTEs ``picked`` (polygon, res, count) and ``covered`` (its cells) of the boxes."""
    return f"""boxed as (select p_partkey, {MX.format('w')} as x0, {MX.format('e')} as x1, {MY.format('s')} as y0, {MY.format('n')} as y1 from box),
    tried as (select *, cast(res as integer) as lev, {side('res')} as sd from boxed, (select unnest(range({start + 1})) as res)),
    lined as (select *, unnest(range(cast(ceil(y0 / (1.5 * sd)) as bigint), cast(floor(y1 / (1.5 * sd)) as bigint) + 1)) as rr from tried),
    spans as (select p_partkey, lev, rr, cast(ceil(x0 / ({ROOT3} * sd) - cast(rr as double) / 2) as bigint) as lo, cast(ceil(x1 / ({ROOT3} * sd) - cast(rr as double) / 2) as bigint) as hi from lined),
    counted as (select t.p_partkey, t.lev, coalesce(sum(greatest(0, hi - lo)), 0) as n from tried t left join spans s on s.p_partkey = t.p_partkey and s.lev = t.lev group by 1, 2),
    picked as (select p_partkey, max(lev) as lev from counted where n <= {most} group by 1),
    covered as (select p_partkey, lev as res, unnest(range(lo, hi)) as q, rr as r from spans join picked using (p_partkey, lev))"""


@check(
    "adaptive_polygon_cover",
    f"""with {cover_sql(11, 10)} select p.p_partkey, p.lev as res, count(q) as cell_count, cast(coalesce(sum(q), 0) as bigint) as q_sum, cast(coalesce(sum(r), 0) as bigint) as r_sum
    from picked p left join covered c on c.p_partkey = p.p_partkey group by 1, 2""",
)
def adaptive_polygon_cover(spark, sf):
    out = cells.cover(box(spark, sf).select("p_partkey", "geom"))
    total = lambda k: F.aggregate("cells", F.lit(0).cast("bigint"), lambda a, c: a + c[k])
    return out.select("p_partkey", "res", "cell_count", total("q").alias("q_sum"), total("r").alias("r_sum"))


@check(
    "hexagon_features",
    f"""with {cover_sql(10, 12)} select cast(res as varchar) || '/' || cast(q as varchar) || '/' || cast(r as varchar) as h3_index, cast(res as varchar) as resolution, p_partkey as source_id, p_type as kind,
    cast(count(*) over (partition by p_partkey) as varchar) as cells, cast(7 as bigint) as vertices from covered join part using (p_partkey)""",
)
def _(spark, sf):
    f = box(spark, sf).withColumn("properties", F.create_map(F.lit("kind"), F.col("p_type")))
    out = cells.cell_features(f, "p_partkey", start=10, max_cells=12)
    prop = lambda k: value_of(F.col("properties"), k)
    return out.select(
        "h3_index", prop("h3_resolution").alias("resolution"), F.col("source_feature_id").alias("source_id"), prop("kind").alias("kind"),
        prop("h3_cell_count").alias("cells"), F.size(F.col("geom.rings")[0]["pts"]).cast("bigint").alias("vertices"),
    )


def line_cells_sql(source: str, res: int, ident: str) -> str:
    """Distinct ``ident, q, r`` of straight segments ``ax, ay, bx, by``."""
    ends = hexed(source, MX.format("ax"), MY.format("ay"), str(res), f"{ident}, bx, \"by\"", "q1", "r1")
    both = hexed(f"({ends})", MX.format("bx"), MY.format('"by"'), str(res), f"{ident}, q1, r1", "q2", "r2")
    path = f"select *, greatest(abs(q2 - q1), abs(r2 - r1), abs(q2 + r2 - q1 - r1)) as n from ({both})"
    steps = f"select *, unnest(range(n + 1)) as i from ({path})"
    frac = f"select *, q1 + cast((q2 - q1) * i as double) / greatest(n, 1) + cast(1e-6 as double) as fq, r1 + cast((r2 - r1) * i as double) / greatest(n, 1) + cast(2e-6 as double) as fr from ({steps})"
    return f"select distinct * from ({rounded(frac, ident)})"


@check(
    "line_cover_counts",
    f"""with c as ({line_cells_sql('(select *, row_number() over () as rid from lin)', 6, 'rid')})
    select q, r, count(*) as lines from c group by 1, 2""",
)
def line_cover_counts(spark, sf):
    lines = lin(spark, sf).select(F.monotonically_increasing_id().alias("id"), "geom")
    return cells.line_cover(lines, ["id"], res=6).groupBy("q", "r").agg(F.count(F.lit(1)).alias("lines"))


@check(
    "cell_of_points",
    f"""select q, r, count(*) as n from ({hexed('pts', MX.format('x'), MY.format('y'), '8', 'event_id')}) group by 1, 2""",
)
def _(spark, sf):
    c = cells.cell_points(pts(spark, sf).select("event_id", "x", "y"), "x", "y", 8)
    return c.groupBy("q", "r").agg(F.count(F.lit(1)).alias("n"))


def center_sql(q: str, rr: str, res: str) -> tuple[str, str]:
    return f"{side(res)} * {ROOT3} * ({q} + cast({rr} as double) / 2)", f"{side(res)} * cast(1.5 as double) * {rr}"


_CX, _CY = center_sql("q", "r", "7")


@check(
    "align_to_finer_cells",
    f"""select q7, r7, q, r, count(*) as n from ({hexed(f"(select *, {_CX} as cx, {_CY} as cy from ({hexed('pts', MX.format('x'), MY.format('y'), '7', 'event_id')}))", 'cx', 'cy', '9', 'q as q7, r as r7')}) group by 1, 2, 3, 4""",
)
def _(spark, sf):
    c = cells.cell_points(pts(spark, sf).select("event_id", "x", "y"), "x", "y", 7)
    fine = c.withColumn("f", hexgrid.recenter(F.col("q"), F.col("r"), F.lit(7), F.lit(9)))
    return fine.groupBy(F.col("q").alias("q7"), F.col("r").alias("r7"), F.col("f.q").alias("q"), F.col("f.r").alias("r")).agg(F.count(F.lit(1)).alias("n"))


_SUP = """select s_suppkey, case when s_nationkey % 2 = 0 then 6 else 8 end as res,
    cast((s_suppkey * 4231) % 10000 as double) / 10000 + cast(-124 as double) as x, cast((s_suppkey * 3011) % 10000 as double) / 10000 + cast(39 as double) as y from supplier"""


def nearest_sql(source: str, target: str, name: str) -> str:
    """Least distance of distinct ``res, q, r`` to targets ``res, q, r``, all pairs."""
    sx, sy = center_sql("sq", "sr", "sres")
    tx, ty = center_sql("tq", "tr", "tres")
    pairs = (
        f"select s.res as sres, s.q as sq, s.r as sr, t.res as tres, t.q as tq, t.r as tr from (select distinct res, q, r from {source}) s, (select distinct res, q, r from {target}) t"
    )
    keep = "sres, sq, sr, tres, tq, tr, common"
    first = hexed(f"(select *, greatest(sres, tres) as common, {sx} as scx, {sy} as scy, {tx} as tcx, {ty} as tcy from ({pairs}))", "scx", "scy", "common", keep + ", tcx, tcy", "aq", "ar")
    second = hexed(f"({first})", "tcx", "tcy", "common", keep + ", aq, ar", "bq", "br")
    return f"select sres as res, sq as q, sr as r, cast(min({STEPS.format('aq - bq', 'ar - br')}) as bigint) as {name} from ({second}) group by 1, 2, 3"


@check(
    "nearest_cell_distance",
    f"""with s as (select cast(7 as integer) as res, q, r from ({hexed('pts', MX.format('x'), MY.format('y'), '7', 'event_id')})),
    t as (select res, q, r from ({hexed(f'({_SUP})', MX.format('x'), MY.format('y'), 'res', 'res')}))
    {nearest_sql('s', 't', 'distance')}""",
)
def nearest_cell_distance(spark, sf):
    src = cells.cell_points(pts(spark, sf).select("event_id", "x", "y"), "x", "y", 7)
    s = shapes(spark, sf, "supplier")
    x, y = _scatter(F.col("s_suppkey"), 4231, -124), _scatter(F.col("s_suppkey"), 3011, 39)
    res = F.when(F.col("s_nationkey") % 2 == 0, 6).otherwise(8)
    tgt = s.select(res.alias("res"), hexgrid.cell(x, y, res).alias("c")).select("res", F.col("c.q").alias("q"), F.col("c.r").alias("r"))
    return cells.nearest_cell_distance(src, tgt)


@check(
    "distance_per_point",
    f"""with s as (select cast(8 as integer) as res, q, r, event_id from ({hexed('pts', MX.format('x'), MY.format('y'), '8', 'event_id')})),
    t as (select cast(8 as integer) as res, q, r from ({hexed(f'({_SUP})', MX.format('x'), MY.format('y'), '8', 'res')})),
    d as ({nearest_sql('s', 't', 'distance')}) select event_id, distance from s join d using (res, q, r)""",
)
def _(spark, sf):
    src = cells.cell_points(pts(spark, sf).select("event_id", "x", "y"), "x", "y", 8)
    x, y = _scatter(F.col("s_suppkey"), 4231, -124), _scatter(F.col("s_suppkey"), 3011, 39)
    s = shapes(spark, sf, "supplier").select(x.alias("x"), y.alias("y"))
    return cells.add_cell_distance(src, cells.cell_points(s, "x", "y", 8), "distance").select("event_id", "distance")


def _roads(spark, sf):
    c = shapes(spark, sf, "customer")
    x, y = _scatter(F.col("c_custkey"), 4231, -124), _scatter(F.col("c_custkey"), 3011, 39)
    return c.select("c_custkey", g.line((x, y), (x + 0.004, y - 0.01)).alias("geom"))


def _creeks(spark, sf):
    s = shapes(spark, sf, "supplier")
    x, y = _scatter(F.col("s_suppkey"), 4231, -124), _scatter(F.col("s_suppkey"), 3011, 39)
    return s.select("s_suppkey", g.line((x, y), (x + 0.03, y + 0.01)).alias("geom"))


def _place(key: str, dx: str, dy: str, source: str) -> str:
    return f"""(select {key}, ax, ay, ax + cast({dx} as double) as bx, ay + cast({dy} as double) as "by" from (select {key},
      cast(({key} * 4231) % 10000 as double) / 10000 + cast(-124 as double) as ax, cast(({key} * 3011) % 10000 as double) / 10000 + cast(39 as double) as ay from {source}))"""


CELL_TABLE = f"""{cover_sql(9, 10)},
    roads as (select distinct cast(8 as integer) as res, q, r from ({line_cells_sql(_place('c_custkey', '0.004', '-0.01', 'customer'), 8, 'c_custkey')})),
    creeks as (select distinct cast(8 as integer) as res, q, r from ({line_cells_sql(_place('s_suppkey', '0.03', '0.01', 'supplier'), 8, 's_suppkey')})),
    near_road as ({nearest_sql('covered', 'roads', 'roads_distance')}), near_creek as ({nearest_sql('covered', 'creeks', 'creek_distance')}),
    cells as (select p_partkey, res, q, r, roads_distance, creek_distance from covered left join near_road using (res, q, r) left join near_creek using (res, q, r))"""


def _table(spark, sf):
    return cell_model.cell_table(box(spark, sf), "p_partkey", _roads(spark, sf), _creeks(spark, sf), start=9)


@check("cell_distance_table", f"with {CELL_TABLE} select * from cells")
def _(spark, sf):
    return _table(spark, sf)


_RATES = ", ".join(
    "('{name}', {production_rate}, {risk_reduction_rate}, {biomass_rate}, {biochar_rate}, {drag_distance_cost}, {water_distance_cost}, {air_pollution}, {cost_rate})".format(**t)
    for t in treatment.TREATMENTS
)
_YIELDS = f"""{CELL_TABLE}, t as (select name as treatment, cast(a as double) as pr, cast(b as double) as rr, cast(c as double) as br, cast(d as double) as bc, cast(e as double) as dc, cast(f as double) as wc, cast(g as double) as ap, cast(h as double) as cr
      from (values {_RATES}) v(name, a, b, c, d, e, f, g, h)),
    yields as (select treatment, p_partkey, res, q, r, (pr + creek_distance * wc + roads_distance * dc) * (cr / 8) as budget_cost, br as biomass_extracted, bc * br as biochar_extracted, ap * br as air_pollution, rr as risk_reduced,
      cast(0.001 as double) * br as biomass_sale, cast(0.01 as double) * (bc * br) as biochar_sale from cells, t),
    totals as (select treatment, {', '.join(f'sum({m}) as {m}' for m in treatment.MEASURES)} from yields group by 1)"""


@check("treatment_yields", f"with {_YIELDS} select treatment, res, q, r, p_partkey, {', '.join(f'round({m}, 6) as {m}' for m in treatment.MEASURES)} from yields")
def _(spark, sf):
    out = treatment.cell_yields(_table(spark, sf))
    return out.select("treatment", "res", "q", "r", "p_partkey", *[r(m).alias(m) for m in treatment.MEASURES])


@check("treatment_totals", f"with {_YIELDS} select treatment, {', '.join(f'round({m}, 3) as {m}' for m in treatment.MEASURES)} from totals")
def treatment_totals(spark, sf):
    out = cell_model.treatment_totals(_table(spark, sf))
    return out.select("treatment", *[r(m, 3).alias(m) for m in treatment.MEASURES])


@check("treatment_totals_normalized", f"with {_YIELDS} select treatment, {', '.join(f'round({m} / (select max({m}) from totals), 6) as {m}' for m in treatment.MEASURES)} from totals")
def _(spark, sf):
    out = cell_model.treatment_totals(_table(spark, sf), normalized=True)
    return out.select("treatment", *[r(m + "_normalized").alias(m) for m in treatment.MEASURES])


_NAMES = [t["name"] for t in treatment.TREATMENTS]


@check(
    "measure_by_treatment",
    f"with {_YIELDS} "
    + " union all ".join(
        f"select '{m}' as measure, " + ", ".join(f"round((select {m} from totals where treatment = '{n}'), 3) as {n.replace(' ', '_')}" for n in _NAMES)
        for m in treatment.MEASURES
    ),
)
def _(spark, sf):
    out = treatment.measure_table(treatment.cell_yields(_table(spark, sf)))
    return out.select("measure", *[r(F.col(f"`{n}`"), 3).alias(n.replace(" ", "_")) for n in _NAMES])


@check(
    "haul_distance_normalized",
    f"""with {CELL_TABLE}, h as (select *, roads_distance + creek_distance as haul from cells)
    select p_partkey, res, q, r, haul, round(cast(haul as double) / (select max(haul) from h), 6) as haul_normalized, round(cast(roads_distance as double) / (select max(roads_distance) from h), 6) as roads_normalized from h""",
)
def _(spark, sf):
    out = cell_model.haul(_table(spark, sf))
    return out.select("p_partkey", "res", "q", "r", "haul", r("haul_normalized").alias("haul_normalized"), r("roads_distance_normalized").alias("roads_normalized"))


# -- raster -------------------------------------------------------------------------------------------------------
_SHADE = """near as (select d.*, w.value as vw, e.value as ve, n.value as vn, s.value as vs from dem d
      left join dem w on w."row" = d."row" and w.col = d.col - 1 left join dem e on e."row" = d."row" and e.col = d.col + 1
      left join dem n on n."row" = d."row" - 1 and n.col = d.col left join dem s on s."row" = d."row" + 1 and s.col = d.col),
    grad as (select *, case when vw is not null and ve is not null then (ve - vw) / 2 when ve is not null then ve - value when vw is not null then value - vw else 0 end as gx,
      case when vn is not null and vs is not null then (vs - vn) / 2 when vs is not null then vs - value when vn is not null then value - vn else 0 end as gy from near),
    lit as (select *, (gx * cos(pi() / 4) * cos(pi() / 4) + gy * sin(pi() / 4) * cos(pi() / 4) + sin(pi() / 4)) / sqrt(gx * gx + gy * gy + 1) as i from grad),
    shaded as (select *, (i - (select min(i) from lit)) / ((select max(i) from lit) - (select min(i) from lit)) as shade from lit)"""


@check("raster_gradient", f'with {_SHADE} select "row", col, round(gx, 6) as gx, round(gy, 6) as gy from grad')
def _(spark, sf):
    out = raster.gradients(dem(spark, sf), tile=32)
    return out.select("row", "col", r("gx").alias("gx"), r("gy").alias("gy"))


@check("hillshade", f'with {_SHADE} select "row", col, round(shade, 6) as shade from shaded')
def hillshade(spark, sf):
    return raster.shade(dem(spark, sf), tile=64).select("row", "col", r("shade").alias("shade"))


@check(
    "hillshade_rgb",
    f"""with {_SHADE}, faded as (select *, cast(trunc((shade * cast(0.6 as double) + cast(0.4 as double)) * 255) as integer) as grey from shaded)
    select "row", col, case when value <= 0 then 0 else grey end as red, case when value <= 0 then 50 else grey end as green, case when value <= 0 then 100 else grey end as blue from faded""",
)
def _(spark, sf):
    return raster.hillshade_rgb(dem(spark, sf), 0.6).select("row", "col", "red", "green", "blue")


_CONTOUR = """sq as (select a."row" as y, a.col as x, a.value as a, b.value as b, c.value as c, d.value as d from dem a join dem b on b."row" = a."row" and b.col = a.col + 1
      join dem c on c."row" = a."row" + 1 and c.col = a.col + 1 join dem d on d."row" = a."row" + 1 and d.col = a.col),
    lv as (select *, cast(unnest(range(cast(floor(least(a, b, c, d) / 10) as bigint) + 1, cast(floor(greatest(a, b, c, d) / 10) as bigint) + 1)) * 10 as double) as z from sq),
    cs as (select *, cast(a >= z as integer) * 8 + cast(b >= z as integer) * 4 + cast(c >= z as integer) * 2 + cast(d >= z as integer) as k, (a + b + c + d) / 4 >= z as up from lv),
    ends as (select *, x + (z - a) / nullif(b - a, 0) as nx, y + (z - b) / nullif(c - b, 0) as ey, x + (z - d) / nullif(c - d, 0) as sx, y + (z - a) / nullif(d - a, 0) as wy from cs where k not in (0, 15)),
    seg as (select z, x as x1, wy as y1, sx as x2, y + 1 as y2 from ends where k in (1, 14) or (k = 5 and not up) or (k = 10 and up)
      union all select z, sx, y + 1, x + 1, ey from ends where k in (2, 13) or (k = 5 and up) or (k = 10 and not up)
      union all select z, x, wy, x + 1, ey from ends where k in (3, 12)
      union all select z, nx, y, x + 1, ey from ends where k in (4, 11) or (k = 5 and not up) or (k = 10 and up)
      union all select z, nx, y, sx, y + 1 from ends where k in (6, 9)
      union all select z, x, wy, nx, y from ends where k in (7, 8) or (k = 5 and up) or (k = 10 and not up))"""


@check(
    "contour_segments",
    f"""with {_CONTOUR} select z as elevation, count(*) as segments, round(sum(x1 + x2), 3) as x, round(sum(y1 + y2), 3) as y,
    round(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 3) as length from seg group by 1""",
)
def contour_segments(spark, sf):
    c = raster.contours(dem(spark, sf), 10.0, tile=64)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return c.groupBy("elevation").agg(
        F.count(F.lit(1)).alias("segments"), r(F.sum(F.col("x1") + F.col("x2")), 3).alias("x"), r(F.sum(F.col("y1") + F.col("y2")), 3).alias("y"),
        r(F.sum(F.sqrt(dx * dx + dy * dy)), 3).alias("length"),
    )


@check(
    "contour_lines",
    f"""with {_CONTOUR} select z as elevation, count(*) as segments, round(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 3) as length from seg group by 1""",
)
def _(spark, sf):
    """Whole lines have the segments and the length of what they are made of; that they are whole, tests show."""
    lines = raster.contour_lines(dem(spark, sf), 10.0, tile=64)
    vertices = F.size(F.col("geom.rings")[0]["pts"])
    return lines.groupBy("elevation").agg(F.sum(vertices - 1).cast("bigint").alias("segments"), r(F.sum(g.length("geom")), 3).alias("length"))


@check(
    "contour_layer_altered",
    f"""with {_CONTOUR} select cast(z as varchar) as name, case when z = 50 then '3' else '1' end as width, count(*) as n from seg where z <> 0 group by 1, 2""",
)
def _(spark, sf):
    conf = {
        "canonicalize": [{"to": "name", "from": "elevation"}],
        "vector_width": {"attribute": "elevation", "map": {"50.0": 3}, "default": 1},
        "filter": [["remove", "elevation", ["0.0"]]],
    }
    out = raster.contour_layer(dem(spark, sf), 10.0, conf)
    prop = lambda k: value_of(F.col("properties"), k)
    return out.groupBy(prop("name").alias("name"), prop("vector_width").alias("width")).agg(F.count(F.lit(1)).alias("n"))


@check(
    "region_raster_extract",
    """select name as region, count(*) as pixels, cast(min("row") as bigint) as top, cast(min(col) as bigint) as "left", round(sum(value), 6) as total from dem
    join reg on cast(-124 as double) + (col + 0.5) / 128 between w and e and cast(40 as double) - ("row" + 0.5) / 1024 between s and n group by 1""",
)
def _(spark, sf):
    """The raster laid over the regions with pixels of 1/128 by 1/1024 degrees."""
    out = raster.region_pixels(dem(spark, sf), {"west": -124.0, "north": 40.0, "dx": 1 / 128, "dy": 1 / 1024}, reg(spark, sf), tile=64)
    return out.groupBy("region").agg(
        F.count(F.lit(1)).alias("pixels"), F.min(F.when(F.col("region_row") == 0, F.col("row"))).alias("top"), F.min(F.when(F.col("region_col") == 0, F.col("col"))).alias("left"), r(F.sum("value")).alias("total")
    )


@check(
    "raster_resample",
    """with h as (select cast(max("row") + 1 as double) as rows from dem), k as (select rows, cast(greatest(1, round(rows / 3.2)) as bigint) as height from h),
    t as (select unnest(range(height)) as r, height, rows from k), g as (select r, unnest(range(40)) as c, height, rows from t),
    a as (select r, c, (c + 0.5) * cast(3.2 as double) - 0.5 as u, (r + 0.5) * (rows / height) - 0.5 as v from g),
    n as (select r, c, floor(u) as u0, floor(v) as v0, u - floor(u) as fu, v - floor(v) as fv from a),
    w as (select r, c, v0 as sr, u0 as sc, (1 - fu) * (1 - fv) as w from n union all select r, c, v0, u0 + 1, fu * (1 - fv) from n
      union all select r, c, v0 + 1, u0, (1 - fu) * fv from n union all select r, c, v0 + 1, u0 + 1, fu * fv from n)
    select r as "row", c as col, round(sum(w * value) / sum(w), 6) as value from w join dem on dem."row" = sr and dem.col = sc where w > 0 group by 1, 2""",
)
def _(spark, sf):
    d = dem(spark, sf)
    rows = d.agg(F.max("row")).collect()[0][0] + 1
    out = raster.resample(
        d, {"west": 0.0, "north": 0.0, "dx": 1.0, "dy": 1.0}, {"west": 0.0, "east": 128.0, "north": 0.0, "south": -float(rows)}, 40
    )
    return out.select("row", "col", r("value").alias("value"))


@check(
    "raster_stretch_and_blend",
    """select "row", col, cast(floor((value - (select min(value) from dem)) / ((select max(value) from dem) - (select min(value) from dem)) * 255 + 0.5) as integer) as byte,
    round(value * (1 - 10 / cast(100 as double)) + 128 * (10 / cast(100 as double)), 6) as mixed from dem""",
)
def _(spark, sf):
    out = raster.stretch(dem(spark, sf))
    return out.select("row", "col", "byte", r(raster.blend(F.col("value"), F.lit(128), 10)).alias("mixed"))


# -- profiles -----------------------------------------------------------------------------------------------------
@check("non_null_counts", "select o_orderstatus, count(a) as a, count(c) as c, count(d) as d from attr group by 1")
def _(spark, sf):
    wide = attr(spark, sf).select("o_orderstatus", *[value_of(F.col("properties"), k).alias(k) for k in "acd"])
    return profile.non_null_counts(wide, "o_orderstatus")


@check("property_value_frequency", "select d as value, count(*) as n from attr group by 1")
def _(spark, sf):
    return profile.value_frequency(attr(spark, sf), "d")


@check(
    "property_key_frequency",
    "select 'a' as key, sum(cast(a_there as bigint))::bigint as n from attr union all select 'b', count(*) from attr union all select 'c', sum(cast(c_there as bigint))::bigint from attr union all select 'd', count(*) from attr",
)
def _(spark, sf):
    return profile.key_frequency(attr(spark, sf))


@check(
    "property_key_union",
    """select o_orderstatus as layer, string_agg(k, ',' order by k) as keys from (select distinct o_orderstatus, k from (select o_orderstatus, unnest(['a', 'b', 'c', 'd']) as k, a_there, c_there from attr)
    where (k <> 'a' or a_there) and (k <> 'c' or c_there)) group by 1""",
)
def _(spark, sf):
    out = profile.key_union(attr(spark, sf), layer="o_orderstatus")
    return out.select(F.col("o_orderstatus").alias("layer"), F.concat_ws(",", "keys").alias("keys"))


@check(
    "crosstab_sums",
    "select l_returnflag, round(sum(case when l_linestatus = 'F' then l_quantity end), 2) as f, round(sum(case when l_linestatus = 'O' then l_quantity end), 2) as o from lineitem group by 1",
)
def _(spark, sf):
    out = profile.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", ["F", "O"])
    return out.select("l_returnflag", r("F", 2).alias("f"), r("O", 2).alias("o"))


@check(
    "expanding_mean_and_deviation",
    """select event_id, count(value) over o as n_before, round(avg(value) over o + cast(1.37e-7 as double), 6) as mean_before, round(stddev_samp(value) over o + cast(1.37e-7 as double), 6) as std_before
    from events window o as (partition by event_type order by event_id rows between unbounded preceding and 1 preceding)""",
)
def expanding_stats(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    # A small offset on both sides keeps exact halves out of the rounding.
    out = profile.expanding_stats(e, "event_id", "value", ["event_type"])
    return out.select("event_id", "n_before", *[r(F.col(c) + 1.37e-7).alias(c) for c in ("mean_before", "std_before")])
