"""A planar hexagon grid in web-mercator metres, with axial cell keys ``(res, q, r)``.

Resolution ``k`` has hexagons of side ``SIDE0 / sqrt(7)**k``, so numbers mean about the same sizes as in the usual
global hexagon index. Cell ids are structural to this grid and not those of any other index.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from landstrata.functions.crs import EARTH, mercator_lat, mercator_lon
from landstrata.functions.geometry import _let, _segments

SIDE0 = 1281256.0  # side at resolution 0, metres
MAX_RES = 15
_ROOT3 = repr(math.sqrt(3.0))


def side_text(res: str) -> str:
    return f"({SIDE0!r}D / pow(sqrt(7D), {res}))"


def round_text(fq: str, fr: str) -> str:
    """Nearest cell of fractional axial coordinates."""
    body = (
        "CASE WHEN abs(k.q - k.fq) > abs(k.r - k.fr) AND abs(k.q - k.fq) > abs(k.s + k.fq + k.fr) "
        "THEN named_struct('q', cast(-k.r - k.s as bigint), 'r', cast(k.r as bigint)) "
        "WHEN abs(k.r - k.fr) > abs(k.s + k.fq + k.fr) "
        "THEN named_struct('q', cast(k.q as bigint), 'r', cast(-k.q - k.s as bigint)) "
        "ELSE named_struct('q', cast(k.q as bigint), 'r', cast(k.r as bigint)) END"
    )
    rounded = (
        f"named_struct('fq', f.fq, 'fr', f.fr, 'q', floor(f.fq + 0.5D), 'r', floor(f.fr + 0.5D), "
        "'s', floor(-f.fq - f.fr + 0.5D))"
    )
    return _let("f", f"named_struct('fq', {fq}, 'fr', {fr})", _let("k", rounded, body))


def cell_text(x: str, y: str, res: str) -> str:
    """Cell that holds a mercator point."""
    s = side_text(res)
    return round_text(f"(({_ROOT3}D / 3 * ({x}) - ({y}) / 3) / {s})", f"((2 * ({y}) / 3) / {s})")


def distance_text(a: str, b: str) -> str:
    return f"cast((abs({a}.q - {b}.q) + abs({a}.r - {b}.r) + abs({a}.q + {a}.r - {b}.q - {b}.r)) / 2 as bigint)"


def center_x(q: Column, r: Column, res: Column) -> Column:
    return side(res) * F.lit(math.sqrt(3.0)) * (q + r / 2)


def center_y(r: Column, res: Column) -> Column:
    return side(res) * F.lit(1.5) * r


def side(res: Column) -> Column:
    return F.lit(SIDE0) / F.pow(F.sqrt(F.lit(7.0)), res)


def cell(lon: Column, lat: Column, res: int | Column) -> Column:
    """``struct<q,r>`` of the cell that holds a geographic point."""
    level = F.lit(res) if isinstance(res, int) else res
    x = F.radians(lon) * F.lit(EARTH)
    y = F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * F.lit(EARTH)
    return cell_of_metres(x, y, level)


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; keeps plans and generated code small."""
    return F.transform(F.array(value), body)[0]


def cell_of_metres(x: Column, y: Column, res: Column) -> Column:
    third = math.sqrt(3.0) / 3

    def nearest(k: Column) -> Column:
        dq, dr, ds = F.abs(k["q"] - k["fq"]), F.abs(k["r"] - k["fr"]), F.abs(k["s"] + k["fq"] + k["fr"])
        fix_q = (dq > dr) & (dq > ds)
        q = F.when(fix_q, -k["r"] - k["s"]).otherwise(k["q"])
        r = F.when(~fix_q & (dr > ds), -k["q"] - k["s"]).otherwise(k["r"])
        return F.struct(q.cast("bigint").alias("q"), r.cast("bigint").alias("r"))

    def rounded(f: Column) -> Column:
        return F.struct(
            f["fq"].alias("fq"),
            f["fr"].alias("fr"),
            F.floor(f["fq"] + 0.5).alias("q"),
            F.floor(f["fr"] + 0.5).alias("r"),
            F.floor(-f["fq"] - f["fr"] + 0.5).alias("s"),
        )

    def fractions(p: Column) -> Column:
        return F.struct(
            ((F.lit(third) * p["x"] - p["y"] / 3) / p["s"]).alias("fq"), ((p["y"] * 2 / 3) / p["s"]).alias("fr")
        )

    place = F.struct(x.alias("x"), y.alias("y"), side(res).alias("s"))
    return _bind(place, lambda p: _bind(fractions(p), lambda f: _bind(rounded(f), nearest)))


def index_name(res: Column, q: Column, r: Column) -> Column:
    return F.concat_ws("/", res.cast("string"), q.cast("string"), r.cast("string"))


def recenter(q: Column, r: Column, res: Column, target: Column) -> Column:
    """Cell at ``target`` resolution that holds the centre of a cell."""
    return cell_of_metres(center_x(q, r, res), center_y(r, res), target)


def grid_distance(q1: Column, r1: Column, q2: Column, r2: Column) -> Column:
    """Steps between two cells of one resolution."""
    dq, dr = q1 - q2, r1 - r2
    return F.greatest(F.abs(dq), F.abs(dr), F.abs(dq + dr))


def boundary(q: Column, r: Column, res: Column) -> Column:
    """Hexagon of a cell as a closed polygon in geographic coordinates."""

    def hexagon(c: Column) -> Column:
        pts = []
        for i in (0, 1, 2, 3, 4, 5, 0):
            angle = math.radians(30 + 60 * i)
            px, py = c["x"] + c["s"] * F.lit(math.cos(angle)), c["y"] + c["s"] * F.lit(math.sin(angle))
            pts.append(F.struct(mercator_lon(px).alias("x"), mercator_lat(py).alias("y")))
        # The hexagon stands on a corner: its sides give west and east, its corners south and north.
        half = c["s"] * F.lit(math.sqrt(3.0) / 2)
        box = F.struct(
            mercator_lon(c["x"] - half).alias("west"),
            mercator_lat(c["y"] - c["s"]).alias("south"),
            mercator_lon(c["x"] + half).alias("east"),
            mercator_lat(c["y"] + c["s"]).alias("north"),
        )
        rings = F.array(F.struct(F.lit(False).alias("hole"), F.array(*pts).alias("pts")))
        return F.struct(F.lit("Polygon").alias("gtype"), F.lit(False).alias("is_box"), box.alias("bbox"), rings.alias("rings"))

    place = F.struct(center_x(q, r, res).alias("x"), center_y(r, res).alias("y"), side(res).alias("s"))
    return _bind(place, hexagon)


# ---------------------------------------------------------------------------------------------------------------
# covers
# ---------------------------------------------------------------------------------------------------------------
def metric_shape(geom: str) -> Column:
    """``struct<segs,area,perimeter,rings,south,north>`` of a polygon in mercator metres, input of the cover."""

    def my(lat: str) -> str:
        return f"({EARTH!r}D * ln(tan(pi() / 4 + radians({lat}) / 2)))"

    rings = (
        f"transform({geom}.rings, r -> named_struct('hole', r.hole, 'pts', transform(r.pts, p -> "
        f"named_struct('x', {EARTH!r}D * radians(p.x), 'y', {my('p.y')}))))"
    )
    perimeter = (
        "aggregate(sg, 0D, (acc, e) -> acc + sqrt((e.bx - e.ax) * (e.bx - e.ax) + (e.by - e.ay) * (e.by - e.ay)))"
    )
    # Shoelace over all edges, from the south-west corner of the bbox; holes run against their outer ring or not,
    # so each ring counts by its own sign.
    ring_area = (
        "abs(aggregate(sequence(0, greatest(size(g.pts) - 2, 0)), 0D, (acc, i) -> acc + "
        "(g.pts[i].x - g.pts[0].x) * (g.pts[least(i + 1, size(g.pts) - 1)].y - g.pts[0].y) - "
        "(g.pts[least(i + 1, size(g.pts) - 1)].x - g.pts[0].x) * (g.pts[i].y - g.pts[0].y))) / 2"
    )
    area = f"aggregate(mr, 0D, (acc, g) -> acc + if(g.hole, -1D, 1D) * {ring_area})"
    body = (
        f"named_struct('segs', sg, 'area', {area}, 'perimeter', {perimeter}, 'rings', size(mr), "
        f"'south', {my(geom + '.bbox.south')}, 'north', {my(geom + '.bbox.north')})"
    )
    return F.expr(_let("mr", rings, _let("sg", _segments("mr"), body)))


def _rows(m: str, res: str, body: str, empty: str) -> str:
    """``body`` with ``lo``/``hi`` bound to the hexagon rows that cross a shape."""
    s = side_text(res)
    bounds = f"named_struct('lo', ceil({m}.south / (1.5D * {s})), 'hi', floor({m}.north / (1.5D * {s})))"
    return _let("b", bounds, f"if(b.lo > b.hi, {empty}, {body})")


def _row_spans(m: str, row: str, res: str) -> str:
    """Half-open runs ``[lo, hi)`` of ``q`` whose centres lie inside the shape on one hexagon row."""
    y = f"(1.5D * {side_text(res)} * {row})"
    crossings = (
        f"array_sort(transform(filter({m}.segs, e -> (e.ay > yy) <> (e.by > yy)), "
        "e -> (e.bx - e.ax) * (yy - e.ay) / (e.by - e.ay) + e.ax))"
    )
    wide = f"({_ROOT3}D * {side_text(res)})"
    spans = (
        "if(size(xs) < 2, array(), transform(sequence(0, cast(size(xs) / 2 as int) - 1), i -> named_struct("
        f"'lo', ceil(xs[2 * i] / {wide} - {row} / 2), 'hi', ceil(xs[2 * i + 1] / {wide} - {row} / 2))))"
    )
    return _let("yy", y, _let("xs", crossings, spans))


def _count(m: str, res: str) -> str:
    per_row = (
        f"aggregate({_row_spans(m, 'row', res)}, 0L, (n, k) -> n + greatest(0L, k.hi - k.lo))"
    )
    return _rows(m, res, f"aggregate(sequence(b.lo, b.hi), 0L, (acc, row) -> acc + {per_row})", "0L")


def cover_resolution(metric: str, start: int, max_cells: int) -> Column:
    """Finest resolution from ``start`` downwards whose cover has at most ``max_cells`` cells.

    Resolutions that are provably too fine are not counted: every hexagon wholly inside the shape has its centre
    inside, and those cut by its outline fill at most ``4 * side * perimeter + 4 * pi * side**2`` per ring.
    """
    s = side_text("res")
    hexagon = f"(1.5D * {_ROOT3}D * {s} * {s})"
    certain = f"({metric}.area - 4 * {s} * {metric}.perimeter - 4 * pi() * {s} * {s} * {metric}.rings) / {hexagon}"
    step = (
        f"CASE WHEN found IS NOT NULL THEN found WHEN {certain} > {max_cells} THEN null "
        f"WHEN {_count(metric, 'res')} <= {max_cells} THEN res END"
    )
    return F.expr(f"aggregate(sequence({start}, 0, -1), cast(null as int), (found, res) -> {step})")


def cover_cells(metric: str, res: str) -> Column:
    """``array<struct<q,r>>``: cells whose centre lies inside the shape."""
    empty = "cast(array() as array<struct<q:bigint,r:bigint>>)"
    run = (
        "if(k.hi > k.lo, transform(sequence(k.lo, k.hi - 1), q -> named_struct('q', q, 'r', row)), " + empty + ")"
    )
    per_row = f"flatten(transform({_row_spans(metric, 'row', res)}, k -> {run}))"
    return F.expr(
        f"if({res} IS NULL, {empty}, {_rows(metric, res, f'flatten(transform(sequence(b.lo, b.hi), row -> {per_row}))', empty)})"
    )


def line_cells(geom: str, res: int) -> Column:
    """``array<struct<q,r>>``: cells of all vertices and of the grid path between neighbouring ones, each once."""

    def at(p: str) -> str:
        x = f"{EARTH!r}D * radians({p}.x)"
        y = f"{EARTH!r}D * ln(tan(pi() / 4 + radians({p}.y) / 2))"
        return cell_text(x, y, str(res))

    # The small offset keeps a path that runs along a cell edge on one side of it.
    step = round_text(
        "(a.q + (c.q - a.q) * i / greatest(n, 1) + 1e-6D)", "(a.r + (c.r - a.r) * i / greatest(n, 1) + 2e-6D)"
    )
    path = _let("n", distance_text("a", "c"), f"transform(sequence(0L, n), i -> {step})")
    ring = (
        "flatten(transform(sequence(0, size(cs) - 1), j -> "
        + _let("a", "cs[greatest(j - 1, 0)]", _let("c", "cs[j]", path))
        + "))"
    )
    one = _let("cs", f"transform(g.pts, p -> {at('p')})", ring)
    return F.expr(f"array_distinct(flatten(transform({geom}.rings, g -> {one})))")


def segment_paths(df: DataFrame, segment: str, res: int) -> DataFrame:
    """One row for each cell ``q, r`` on the grid path of a segment (``ax, ay, bx, by``), both ends included.

    The same path as :func:`line_cells`, as plain columns.
    """
    names = df.columns
    wide = math.sqrt(3.0) / 3
    hexagon = F.expr(side_text(str(res)))

    def metres(end: str) -> dict[str, Column]:
        s = F.col(segment)
        lat = F.log(F.tan(F.lit(math.pi) / 4 + F.radians(s[f"{end}y"]) / 2))
        return {f"__x{end}": F.lit(EARTH) * F.radians(s[f"{end}x"]), f"__y{end}": F.lit(EARTH) * lat}

    def fractions(end: str) -> dict[str, Column]:
        x, y = F.col(f"__x{end}"), F.col(f"__y{end}")
        return {f"__fq{end}": (F.lit(wide) * x - y / 3) / hexagon, f"__fr{end}": (2 * y / 3) / hexagon}

    def rounded(df: DataFrame, fq: Column, fr: Column, q: str, r: str) -> DataFrame:
        df = df.withColumns({"__f": fq, "__g": fr}).withColumns({"__q": F.floor(F.col("__f") + 0.5), "__r": F.floor(F.col("__g") + 0.5), "__t": F.floor(-F.col("__f") - F.col("__g") + 0.5)})
        df = df.withColumns({"__dq": F.abs(F.col("__q") - F.col("__f")), "__dr": F.abs(F.col("__r") - F.col("__g")), "__dt": F.abs(F.col("__t") + F.col("__f") + F.col("__g"))})
        fix_q = (F.col("__dq") > F.col("__dr")) & (F.col("__dq") > F.col("__dt"))
        return df.withColumns(
            {
                q: F.when(fix_q, -F.col("__r") - F.col("__t")).otherwise(F.col("__q")).cast("bigint"),
                r: F.when(~fix_q & (F.col("__dr") > F.col("__dt")), -F.col("__q") - F.col("__t")).otherwise(F.col("__r")).cast("bigint"),
            }
        )

    out = df.withColumns({**metres("a"), **metres("b")}).withColumns({**fractions("a"), **fractions("b")})
    for end in ("a", "b"):
        out = rounded(out, F.col(f"__fq{end}"), F.col(f"__fr{end}"), f"__q{end}", f"__r{end}")
    out = out.select(*[F.col(f"`{c}`") for c in names if c != segment], "__qa", "__ra", "__qb", "__rb")
    dq, dr = F.col("__qb") - F.col("__qa"), F.col("__rb") - F.col("__ra")
    out = out.withColumn("__n", ((F.abs(dq) + F.abs(dr) + F.abs(dq + dr)) / 2).cast("bigint")).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n"))))
    # The small offset keeps a path that runs along a cell edge on one side of it.
    at = lambda a, d, e: F.col(a) + d * F.col("__i") / F.greatest(F.col("__n"), F.lit(1)) + F.lit(e)
    out = rounded(out, at("__qa", dq, 1e-6), at("__ra", dr, 2e-6), "q", "r")
    return out.select(*[F.col(f"`{c}`") for c in names if c != segment], "q", "r")
