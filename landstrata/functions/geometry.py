"""Geometry as column expressions over the ``rings`` representation of :mod:`landstrata.model`.

The helpers take the *name* of a geometry struct column (or a dotted path to one) and return a Column, so everything
stays inside the JVM; only WKB decoding needs Python, and runs on Arrow batches.
"""

from __future__ import annotations

import struct as _struct

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from landstrata.model import RINGS

_COORDS = {
    "Point": "array<double>",
    "MultiPoint": "array<array<double>>",
    "LineString": "array<array<double>>",
    "MultiLineString": "array<array<array<double>>>",
    "Polygon": "array<array<array<double>>>",
    "MultiPolygon": "array<array<array<array<double>>>>",
}


# ---------------------------------------------------------------------------------------------------------------
# expression text used inside higher-order functions
# ---------------------------------------------------------------------------------------------------------------
def _pts(positions: str) -> str:
    return f"transform({positions}, c -> named_struct('x', c[0], 'y', c[1]))"


def _ring(points: str, hole: str = "false") -> str:
    return f"named_struct('hole', {hole}, 'pts', {points})"


def _segments(rings: str) -> str:
    """All segments of all rings; a lone vertex gives a segment of length zero."""
    return (
        f"flatten(transform(filter({rings}, g -> size(g.pts) > 0), g -> "
        "transform(sequence(0, greatest(size(g.pts) - 2, 0)), i -> named_struct("
        "'ax', g.pts[i].x, 'ay', g.pts[i].y, "
        "'bx', g.pts[least(i + 1, size(g.pts) - 1)].x, 'by', g.pts[least(i + 1, size(g.pts) - 1)].y))))"
    )


def _let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


_ORIENT = "(({bx}) - ({ax})) * (({cy}) - ({ay})) - (({by}) - ({ay})) * (({cx}) - ({ax}))"


def _orient(a: str, b: str, c: str) -> str:
    (ax, ay), (bx, by), (cx, cy) = (p.split(",") for p in (a, b, c))
    return "(" + _ORIENT.format(ax=ax, ay=ay, bx=bx, by=by, cx=cx, cy=cy) + ")"


def _cross(s: str, t: str) -> str:
    """Segments touch or cross, ends included."""
    a, b = f"{s}.ax,{s}.ay", f"{s}.bx,{s}.by"
    c, d = f"{t}.ax,{t}.ay", f"{t}.bx,{t}.by"
    return (
        f"least({s}.ax, {s}.bx) <= greatest({t}.ax, {t}.bx) AND least({t}.ax, {t}.bx) <= greatest({s}.ax, {s}.bx) AND "
        f"least({s}.ay, {s}.by) <= greatest({t}.ay, {t}.by) AND least({t}.ay, {t}.by) <= greatest({s}.ay, {s}.by) AND "
        f"signum({_orient(a, b, c)}) * signum({_orient(a, b, d)}) <= 0 AND "
        f"signum({_orient(c, d, a)}) * signum({_orient(c, d, b)}) <= 0"
    )


def _odd(segments: str, x: str, y: str) -> str:
    """Even-odd ray test of a vertex against segments."""
    return (
        f"aggregate({segments}, false, (acc, e) -> "
        f"if((e.ay > {y}) <> (e.by > {y}) AND {x} < (e.bx - e.ax) * ({y} - e.ay) / (e.by - e.ay) + e.ax, NOT acc, acc))"
    )


def _on_edge(segments: str, x: str, y: str) -> str:
    p = f"{x},{y}"
    return (
        f"exists({segments}, e -> {_orient('e.ax,e.ay', 'e.bx,e.by', p)} = 0 AND "
        f"{x} BETWEEN least(e.ax, e.bx) AND greatest(e.ax, e.bx) AND "
        f"{y} BETWEEN least(e.ay, e.by) AND greatest(e.ay, e.by))"
    )


def _areal(gtype: str) -> str:
    return f"{gtype} IN ('Polygon', 'MultiPolygon')"


# ---------------------------------------------------------------------------------------------------------------
# building geometries
# ---------------------------------------------------------------------------------------------------------------
def from_rings(gtype: Column, rings: Column) -> Column:
    """Geometry struct with its bbox and box flag from a type and rings; null rings give null."""
    return _finish(F.struct(gtype.alias("t"), rings.alias("r")))


def _finish(parts: Column) -> Column:
    made = F.transform(
        F.array(parts),
        lambda g: F.when(
            g["r"].isNotNull() & (F.size(g["r"]) > 0),
            F.struct(
                g["t"].alias("gtype"),
                _is_box_col(g).alias("is_box"),
                _bbox_col(g["r"]).alias("bbox"),
                g["r"].alias("rings"),
            ),
        ),
    )
    return made[0]


def _flat(rings: Column, axis: str) -> Column:
    return F.flatten(F.transform(rings, lambda g: F.transform(g["pts"], lambda p: p[axis])))


def _bbox_col(rings: Column) -> Column:
    return F.struct(
        F.array_min(_flat(rings, "x")).alias("west"),
        F.array_min(_flat(rings, "y")).alias("south"),
        F.array_max(_flat(rings, "x")).alias("east"),
        F.array_max(_flat(rings, "y")).alias("north"),
    )


def _is_box_col(g: Column) -> Column:
    def axis_parallel(ring: Column) -> Column:
        p = [ring["pts"][i] for i in range(5)]
        upright = (
            (p[0]["x"] == p[1]["x"]) & (p[1]["y"] == p[2]["y"]) & (p[2]["x"] == p[3]["x"]) & (p[3]["y"] == p[0]["y"])
        )
        flat = (
            (p[0]["y"] == p[1]["y"]) & (p[1]["x"] == p[2]["x"]) & (p[2]["y"] == p[3]["y"]) & (p[3]["x"] == p[0]["x"])
        )
        closed = (p[0]["x"] == p[4]["x"]) & (p[0]["y"] == p[4]["y"])
        return (F.size(ring["pts"]) == 5) & closed & (upright | flat)

    return (g["t"] == "Point") | (
        (g["t"] == "Polygon") & (F.size(g["r"]) == 1) & F.forall(g["r"], axis_parallel)
    )


def point(x: Column, y: Column) -> Column:
    """Point geometry.

    The constructors from coordinates build a plain struct, which lets Catalyst take single fields out of it without
    making the rest. Null coordinates give a shape that meets nothing; see :func:`is_valid`.
    """
    p = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    made = F.struct(
        F.lit("Point").alias("gtype"),
        F.lit(True).alias("is_box"),
        bbox(x, y, x, y).alias("bbox"),
        F.array(F.struct(F.lit(False).alias("hole"), F.array(p).alias("pts"))).alias("rings"),
    )
    return made


def bbox(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.struct(
        west.cast("double").alias("west"),
        south.cast("double").alias("south"),
        east.cast("double").alias("east"),
        north.cast("double").alias("north"),
    )


def corners(box: str) -> Column:
    """Four corners of a bbox column: north-west, north-east, south-east, south-west."""
    b = F.col(box)
    return F.array(
        *[
            F.struct(b[x].alias("x"), b[y].alias("y"))
            for x, y in (("west", "north"), ("east", "north"), ("east", "south"), ("west", "south"))
        ]
    )


def closed_ring(box: str) -> Column:
    """Corners with the first one repeated at the end."""
    four = corners(box)
    return F.concat(four, F.slice(four, 1, 1))


def envelope(box: str, expand: float = 0.0) -> Column:
    """Rectangle polygon of a bbox column, grown by ``expand`` on each side."""
    b = F.col(box)
    d = F.lit(float(expand))
    return box_polygon(b["west"] - d, b["south"] - d, b["east"] + d, b["north"] + d)


def box_polygon(west: Column, south: Column, east: Column, north: Column) -> Column:
    def p(x: Column, y: Column) -> Column:
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    ring = F.array(p(west, south), p(east, south), p(east, north), p(west, north), p(west, south))
    made = F.struct(
        F.lit("Polygon").alias("gtype"),
        F.lit(True).alias("is_box"),
        bbox(west, south, east, north).alias("bbox"),
        F.array(F.struct(F.lit(False).alias("hole"), ring.alias("pts"))).alias("rings"),
    )
    return made


def once(value: Column) -> Column:
    """A costly column that is evaluated one time only.

    Spark copies the expression of a column into every filter on that column; it does not do so for the output of a
    generator. Use at most one per ``select``.
    """
    return F.explode_outer(F.array(value))


def is_valid(geom: str) -> Column:
    """The geometry is there and has coordinates."""
    b = F.col(geom)["bbox"]
    return F.col(geom).isNotNull() & b["west"].isNotNull() & b["south"].isNotNull() & b["east"].isNotNull() & b["north"].isNotNull()


def line(*xy: tuple[Column, Column]) -> Column:
    pts = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in xy])
    xs, ys = [x for x, _ in xy], [y for _, y in xy]
    made = F.struct(
        F.lit("LineString").alias("gtype"),
        F.lit(False).alias("is_box"),
        bbox(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)).alias("bbox"),
        F.array(F.struct(F.lit(False).alias("hole"), pts.alias("pts"))).alias("rings"),
    )
    return made


def ring_bbox(points: str) -> Column:
    """BBox of an ``array<struct<x,y>>`` column, all vertices counted."""
    return F.expr(
        f"named_struct('west', array_min(transform({points}, p -> p.x)), 'south', array_min(transform({points}, p -> p.y)), "
        f"'east', array_max(transform({points}, p -> p.x)), 'north', array_max(transform({points}, p -> p.y)))"
    )


def bbox_center(box: str) -> Column:
    b = F.col(box)
    return F.struct(((b["west"] + b["east"]) / 2).alias("x"), ((b["south"] + b["north"]) / 2).alias("y"))


# ---------------------------------------------------------------------------------------------------------------
# GeoJSON
# ---------------------------------------------------------------------------------------------------------------
def from_geojson(gtype: str, coordinates: str) -> Column:
    """Geometry from a type column and the JSON text of its coordinates; anything malformed gives null."""

    def parsed(kind: str) -> str:
        return f"from_json({coordinates}, '{_COORDS[kind]}')"

    one = "array({})".format(_ring("transform(array(c0), c -> named_struct('x', c[0], 'y', c[1]))"))
    polygon = f"transform({{0}}, (ring, i) -> {_ring(_pts('ring'), 'i > 0')})"
    branches = {
        "Point": _let("c0", parsed("Point"), f"if(size(c0) >= 2, {one}, null)"),
        "MultiPoint": f"transform({parsed('MultiPoint')}, q -> {_ring(_pts('array(q)'))})",
        "LineString": _let("c0", parsed("LineString"), f"if(size(c0) >= 2, array({_ring(_pts('c0'))}), null)"),
        "MultiLineString": f"transform({parsed('MultiLineString')}, part -> {_ring(_pts('part'))})",
        "Polygon": polygon.format(parsed("Polygon")),
        "MultiPolygon": f"flatten(transform({parsed('MultiPolygon')}, part -> {polygon.format('part')}))",
    }
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in branches.items())
    rings = F.expr(f"CASE {gtype} {cases} END").cast(RINGS)
    complete = F.forall(
        rings, lambda g: F.forall(g["pts"], lambda p: p["x"].isNotNull() & p["y"].isNotNull()) & (F.size(g["pts"]) > 0)
    )
    return from_rings(F.expr(gtype), F.when(complete, rings))


def parse_geojson(text: str) -> Column:
    """Geometry from GeoJSON geometry text."""
    head = f"from_json({text}, 'type string, coordinates string')"
    return from_geojson(f"{head}.type", f"{head}.coordinates")


def geojson_text(geom: str) -> str:
    pos = "transform(g.pts, p -> array(p.x, p.y))"
    r = f"{geom}.rings"
    # A multi polygon starts a new part at each ring that is not a hole.
    parts = (
        f"aggregate({r}, cast(array() as array<array<array<array<double>>>>), (acc, g) -> "
        f"if(g.hole AND size(acc) > 0, "
        f"concat(slice(acc, 1, size(acc) - 1), array(concat(element_at(acc, -1), array({pos})))), "
        f"concat(acc, array(array({pos})))))"
    )
    rings = f"transform({r}, g -> {pos})"
    text = (
        f"CASE {geom}.gtype "
        f"WHEN 'Point' THEN to_json({rings}[0][0]) "
        f"WHEN 'MultiPoint' THEN to_json(transform({r}, g -> array(g.pts[0].x, g.pts[0].y))) "
        f"WHEN 'LineString' THEN to_json({rings}[0]) "
        f"WHEN 'MultiLineString' THEN to_json({rings}) "
        f"WHEN 'Polygon' THEN to_json({rings}) "
        f"WHEN 'MultiPolygon' THEN to_json({parts}) END"
    )
    return f"concat('{{\"type\":\"', {geom}.gtype, '\",\"coordinates\":', {text}, '}}')"


def to_geojson(geom: str) -> Column:
    """GeoJSON geometry text."""
    return F.expr(geojson_text(geom))


# ---------------------------------------------------------------------------------------------------------------
# measures
# ---------------------------------------------------------------------------------------------------------------
def _ring_moment(ring: str) -> str:
    """Twice the signed area and first moments of a ring, relative to its first vertex to keep the digits."""
    x = "({0}.pts[{1}].x - {0}.pts[0].x)".format
    y = "({0}.pts[{1}].y - {0}.pts[0].y)".format
    terms = (
        f"transform(sequence(0, greatest(size({ring}.pts) - 2, 0)), i -> named_struct("
        f"'c', {x(ring, 'i')} * {y(ring, 'least(i + 1, size(' + ring + '.pts) - 1)')} - "
        f"{x(ring, 'least(i + 1, size(' + ring + '.pts) - 1)')} * {y(ring, 'i')}, "
        f"'u', {x(ring, 'i')} + {x(ring, 'least(i + 1, size(' + ring + '.pts) - 1)')}, "
        f"'v', {y(ring, 'i')} + {y(ring, 'least(i + 1, size(' + ring + '.pts) - 1)')}))"
    )
    zero = "named_struct('a', 0D, 'mx', 0D, 'my', 0D)"
    return (
        f"aggregate({terms}, {zero}, (acc, t) -> named_struct("
        "'a', acc.a + t.c, 'mx', acc.mx + t.u * t.c, 'my', acc.my + t.v * t.c))"
    )


def _moments(rings: str) -> str:
    """Area and first moments over all rings, holes subtracted, independent of ring direction."""
    one = _let(
        "m",
        _ring_moment("g"),
        "named_struct('a', if(g.hole, -1D, 1D) * abs(m.a) / 2, "
        "'mx', if(g.hole, -1D, 1D) * signum(m.a) * m.mx / 6 + if(g.hole, -1D, 1D) * abs(m.a) / 2 * g.pts[0].x, "
        "'my', if(g.hole, -1D, 1D) * signum(m.a) * m.my / 6 + if(g.hole, -1D, 1D) * abs(m.a) / 2 * g.pts[0].y)",
    )
    zero = "named_struct('a', 0D, 'mx', 0D, 'my', 0D)"
    return (
        f"aggregate(transform({rings}, g -> {one}), {zero}, (acc, t) -> named_struct("
        "'a', acc.a + t.a, 'mx', acc.mx + t.mx, 'my', acc.my + t.my))"
    )


def area_text(geom: str) -> str:
    return (
        f"CASE WHEN {geom} IS NULL THEN null WHEN {_areal(geom + '.gtype')} "
        f"THEN {_moments(geom + '.rings')}.a ELSE 0D END"
    )


def area(geom: str) -> Column:
    """Planar area, zero for points and lines."""
    return F.expr(area_text(geom))


def length_text(geom: str) -> str:
    x, y = (f"({_end(geom, 1, c)} - {_end(geom, 0, c)})" for c in "xy")
    return (
        f"CASE WHEN {lone_segment(geom)} THEN sqrt({x} * {x} + {y} * {y}) ELSE aggregate({_segments(geom + '.rings')}, 0D, (acc, e) -> "
        "acc + sqrt((e.bx - e.ax) * (e.bx - e.ax) + (e.by - e.ay) * (e.by - e.ay))) END"
    )


def length(geom: str) -> Column:
    """Planar length of all segments."""
    return F.expr(length_text(geom))


def centroid(geom: str) -> Column:
    """``struct<x,y>``: area weighted for polygons, length weighted for lines, vertex mean for what has neither."""
    return F.expr(centroid_text(geom))


def centroid_text(g: str) -> str:
    mean = (
        f"aggregate(flatten(transform({g}.rings, r -> r.pts)), named_struct('n', 0D, 'x', 0D, 'y', 0D), "
        "(acc, p) -> named_struct('n', acc.n + 1, 'x', acc.x + p.x, 'y', acc.y + p.y), "
        "acc -> named_struct('x', acc.x / acc.n, 'y', acc.y / acc.n))"
    )
    along = (
        f"aggregate({_segments(g + '.rings')}, named_struct('n', 0D, 'x', 0D, 'y', 0D), (acc, e) -> "
        + _let(
            "l",
            "sqrt((e.bx - e.ax) * (e.bx - e.ax) + (e.by - e.ay) * (e.by - e.ay))",
            "named_struct('n', acc.n + l, 'x', acc.x + l * (e.ax + e.bx) / 2, 'y', acc.y + l * (e.ay + e.by) / 2)",
        )
        + ", acc -> if(acc.n > 0, named_struct('x', acc.x / acc.n, 'y', acc.y / acc.n), null))"
    )
    across = _let("m", _moments(g + ".rings"), "if(m.a > 0, named_struct('x', m.mx / m.a, 'y', m.my / m.a), null)")
    box = (
        f"named_struct('x', ({g}.bbox.west + {g}.bbox.east) / 2, 'y', ({g}.bbox.south + {g}.bbox.north) / 2)"
    )
    return (
        f"CASE WHEN {g} IS NULL THEN null WHEN {g}.is_box THEN {box} "
        f"WHEN {_areal(g + '.gtype')} THEN coalesce({across}, {along}, {mean}) "
        f"WHEN {g}.gtype IN ('LineString', 'MultiLineString') THEN coalesce({along}, {mean}) ELSE {mean} END"
    )


def distance(a: str, b: str) -> Column:
    """Planar distance of two ``struct<x,y>`` columns."""
    p, q = F.col(a), F.col(b)
    dx, dy = p["x"] - q["x"], p["y"] - q["y"]
    return F.sqrt(dx * dx + dy * dy)


# ---------------------------------------------------------------------------------------------------------------
# predicates
# ---------------------------------------------------------------------------------------------------------------
def bbox_overlap(a: str, b: str) -> Column:
    """BBox columns share at least a boundary point."""
    p, q = F.col(a), F.col(b)
    return (
        (p["west"] <= q["east"]) & (q["west"] <= p["east"]) & (p["south"] <= q["north"]) & (q["south"] <= p["north"])
    )


def bbox_inside(box: str, west: float, south: float, east: float, north: float) -> Column:
    """BBox column strictly inside a literal box; plain comparisons, so they reach the Parquet scan."""
    b = F.col(box)
    return (b["west"] > west) & (b["east"] < east) & (b["south"] > south) & (b["north"] < north)


def lone_segment(shape: str) -> str:
    """A line of two vertices: its ends can be read without walking over rings."""
    return f"({shape}.gtype = 'LineString' AND size({shape}.rings) = 1 AND size(get({shape}.rings, 0).pts) = 2)"


def _end(shape: str, i: int, axis: str) -> str:
    return f"get(get({shape}.rings, 0).pts, {i}).{axis}"


def ends_of(shape: str) -> Column:
    """``struct<ax,ay,bx,by>`` of a :func:`lone_segment`."""
    return F.struct(*[F.expr(_end(shape, i, c)).alias("ab"[i] + c) for i in (0, 1) for c in "xy"])


def box_spans(at, box: str) -> tuple[str, str]:
    """Where, from 0 to 1, a segment enters a rectangle and leaves it; ``at`` gives the text of ``ax, ay, bx, by``."""

    def span(axis: str, lo: str, hi: str) -> tuple[str, str]:
        a, d = at("a" + axis), f"({at('b' + axis)} - {at('a' + axis)})"
        inside = f"{a} BETWEEN {lo} AND {hi}"
        enter = f"if({d} = 0, if({inside}, 0D, 2D), (if({d} > 0, {lo}, {hi}) - {a}) / {d})"
        leave = f"if({d} = 0, if({inside}, 1D, -1D), (if({d} > 0, {hi}, {lo}) - {a}) / {d})"
        return enter, leave

    ex, lx = span("x", f"{box}.west", f"{box}.east")
    ey, ly = span("y", f"{box}.south", f"{box}.north")
    return f"greatest(0D, {ex}, {ey})", f"least(1D, {lx}, {ly})"


def segment_meets_box(at, box: str) -> str:
    """A segment shares a point with a rectangle: the stretch between its slabs is not empty."""
    near = (
        f"least({at('ax')}, {at('bx')}) <= {box}.east AND greatest({at('ax')}, {at('bx')}) >= {box}.west AND "
        f"least({at('ay')}, {at('by')}) <= {box}.north AND greatest({at('ay')}, {at('by')}) >= {box}.south"
    )
    enter, leave = box_spans(at, box)
    return f"({near} AND {enter} <= {leave})"


def _meets_box(segments: str, box: str) -> str:
    """Some segment shares a point with a rectangle."""
    return f"exists({segments}, e -> {segment_meets_box('e.{}'.format, box)})"


def _exact_text(a: str, b: str) -> str:
    """The cheapest exact test for a pair whose boxes overlap: a rectangle or a point needs no segment pairs."""

    def with_box(shape: str, box: str) -> str:
        inside = f"{_areal(shape + '.gtype')} AND {_odd('sg', box + '.bbox.west', box + '.bbox.south')}"
        walked = _let("sg", _segments(shape + ".rings"), f"{_meets_box('sg', box + '.bbox')} OR ({inside})")
        lone = segment_meets_box(lambda name: _end(shape, "ab".index(name[0]), name[1]), box + ".bbox")
        return f"CASE WHEN {lone_segment(shape)} THEN {lone} ELSE {walked} END"

    def with_point(shape: str, point: str) -> str:
        x, y = f"{point}.bbox.west", f"{point}.bbox.south"
        inside = f"{_areal(shape + '.gtype')} AND {_odd('sg', x, y)}"
        return _let("sg", _segments(shape + ".rings"), f"({inside}) OR {_on_edge('sg', x, y)}")

    return (
        f"CASE WHEN {a}.gtype = 'Point' THEN {with_point(b, a)} WHEN {b}.gtype = 'Point' THEN {with_point(a, b)} "
        f"WHEN {b}.is_box THEN {with_box(a, b)} WHEN {a}.is_box THEN {with_box(b, a)} "
        f"ELSE {_general_text(a, b)} END"
    )


def _general_text(a: str, b: str) -> str:
    inside_b = f"exists({a}.rings, g -> {_odd('sb', 'g.pts[0].x', 'g.pts[0].y')})"
    inside_a = f"exists({b}.rings, g -> {_odd('sa', 'g.pts[0].x', 'g.pts[0].y')})"
    touch = f"exists(sa, s -> exists(sb, t -> {_cross('s', 't')}))"
    body = (
        f"({_areal(b + '.gtype')} AND {inside_b}) OR ({_areal(a + '.gtype')} AND {inside_a}) OR {touch}"
    )
    return _let("sa", _segments(a + ".rings"), _let("sb", _segments(b + ".rings"), body))


def triangle_text(shape: str) -> str:
    """One closed ring of three corners that do not lie on a line."""
    p = [f"{shape}.rings[0].pts[{i}]" for i in range(4)]
    turn = _orient(*[f"{c}.x,{c}.y" for c in p[:3]])
    return (
        f"coalesce({shape}.gtype = 'Polygon' AND NOT {shape}.is_box AND size({shape}.rings) = 1 AND NOT {shape}.rings[0].hole AND "
        f"CASE WHEN size({shape}.rings[0].pts) = 4 THEN {p[0]} = {p[3]} AND abs({turn}) > 0 AND abs({turn}) < double('inf') END, false)"
    )


def _in_triangle(a: str, b: str) -> str:
    """All vertices of ``a`` in or on the triangle ``b``: to the left of its edges, taken against the clock."""
    p = [f"{b}.rings[0].pts[{i}]" for i in range(3)]
    turn = _orient(*[f"{c}.x,{c}.y" for c in p])
    left = [_orient(f"tr[{i}].x,tr[{i}].y", f"tr[{j}].x,tr[{j}].y", "p.x,p.y") + " >= 0" for i, j in ((0, 1), (1, 2), (2, 0))]
    corners = f"array({p[0]}, if({turn} > 0, {p[1]}, {p[2]}), if({turn} > 0, {p[2]}, {p[1]}))"
    return _let("tr", corners, f"forall({a}.rings, g -> forall(g.pts, p -> {' AND '.join(left)}))")


def intersects_exact(a: str, b: str) -> Column:
    """Shapes share a point, boundaries counted: some segments meet, or one shape holds a vertex of the other."""
    return F.expr(_exact_text(a, b))


def intersects_text(a: str, b: str) -> str:
    overlap = (
        f"{a}.bbox.west <= {b}.bbox.east AND {b}.bbox.west <= {a}.bbox.east AND "
        f"{a}.bbox.south <= {b}.bbox.north AND {b}.bbox.south <= {a}.bbox.north"
    )
    return f"{overlap} AND (({a}.is_box AND {b}.is_box) OR {_exact_text(a, b)})"


def intersects(a: str, b: str) -> Column:
    """Exact test; bbox overlap settles it when both shapes fill their boxes."""
    both = F.col(a)["is_box"] & F.col(b)["is_box"]
    return bbox_overlap(a + ".bbox", b + ".bbox") & (both | intersects_exact(a, b))


def within(a: str, b: str) -> Column:
    """Every point of ``a`` lies in polygon ``b``: all vertices in or on it, and no piece of ``a`` leaves it.

    Edges of ``a`` are cut at every meeting with an edge of ``b``; each piece must have its middle in or on ``b``. What has all
    vertices in a triangle lies in it.
    """

    def in_or_on(x: str, y: str) -> str:
        return f"({_odd('sb', x, y)} OR {_on_edge('sb', x, y)})"

    meet = (
        "if({d} = 0, null, (({t}.ax - {s}.ax) * ({t}.by - {t}.ay) - ({t}.ay - {s}.ay) * ({t}.bx - {t}.ax)) / {d})"
    ).format(d="((s.bx - s.ax) * (t.by - t.ay) - (s.by - s.ay) * (t.bx - t.ax))", s="s", t="t")
    cuts = f"array_sort(filter(concat(array(0D, 1D), transform(sb, t -> {meet})), u -> u IS NOT NULL AND u BETWEEN 0 AND 1))"
    middle = "((cs[i] + cs[i + 1]) / 2)"
    pieces = _let(
        "cs",
        cuts,
        "forall(sequence(0, size(cs) - 2), i -> "
        + in_or_on(f"(s.ax + {middle} * (s.bx - s.ax))", f"(s.ay + {middle} * (s.by - s.ay))")
        + ")",
    )
    vertices = f"forall({a}.rings, g -> forall(g.pts, p -> {in_or_on('p.x', 'p.y')}))"
    body = f"{_areal(b + '.gtype')} AND {vertices} AND forall({_segments(a + '.rings')}, s -> {pieces})"
    p, q = F.col(a)["bbox"], F.col(b)["bbox"]
    boxed = (
        (p["west"] >= q["west"]) & (p["east"] <= q["east"]) & (p["south"] >= q["south"]) & (p["north"] <= q["north"])
    )
    both = F.col(a)["is_box"] & F.col(b)["is_box"] & (F.col(b)["gtype"] == "Polygon")
    walked = _let("sb", _segments(b + ".rings"), body)
    return boxed & (both | F.expr(f"CASE WHEN {triangle_text(b)} THEN {_in_triangle(a, b)} ELSE {walked} END"))


# ---------------------------------------------------------------------------------------------------------------
# WKB
# ---------------------------------------------------------------------------------------------------------------
# WKB geometry codes.
_WKB = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}


def _rings_of(data: memoryview, at: int, end: int, rings: list) -> tuple[str, int]:
    """Append ``(first byte, vertices, bytes a vertex, big-endian, hole)`` for each ring of the geometry at ``at``; its kind and end."""
    order = "<" if data[at] == 1 else ">"
    (code,) = _struct.unpack_from(order + "I", data, at + 1)
    at += 5
    if code & 0x20000000:  # extended form with a reference-system id
        at += 4
    dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    code &= 0x0FFFFFFF
    if code >= 1000:
        dims = {1: 3, 2: 3, 3: 4}[code // 1000]
        code %= 1000
    kind = _WKB[code]

    def count(at):
        if at + 4 > end:
            raise IndexError
        return _struct.unpack_from(order + "I", data, at)[0], at + 4

    def run(n, at, hole=False):
        after = at + 8 * n * dims
        if after > end:
            raise IndexError
        rings.append((at, n, 8 * dims, order == ">", hole))
        return after

    if kind == "Point":
        return kind, run(1, at)
    n, at = count(at)
    if kind == "LineString":
        return kind, run(n, at)
    for i in range(n):
        if kind == "Polygon":
            m, at = count(at)
            at = run(m, at, i > 0)
        else:
            _, at = _rings_of(data, at, end, rings)
    return kind, at


def _doubles(data, at, big):
    """The doubles that start at the bytes ``at``, whatever their alignment and byte order."""
    import numpy as np

    out = np.empty(len(at), np.float64)
    for k in range(8):
        mine = np.flatnonzero(at % 8 == k)
        if len(mine):
            view = np.frombuffer(data, "<f8", count=(len(data) - k) // 8, offset=k)
            out[mine] = view[at[mine] // 8]
    return np.where(big, out.byteswap(), out)


def _columns_of_wkb(wkb):
    """WKB blobs as an Arrow array of ``gtype`` and ``rings``; unreadable ones have neither.

    Headers are read blob by blob, those of little-endian points, lines and polygons of one ring all at once; coordinates
    always all at once, by the places of their bytes.
    """
    import numpy as np

    wkb = wkb.cast(pa.large_binary())
    n = len(wkb)
    raw = wkb.buffers()[2]
    data = bytes(8) if raw is None else raw.to_pybytes() + bytes(8)
    offsets = np.frombuffer(wkb.buffers()[1], np.int64)[wkb.offset:wkb.offset + n + 1]
    start, end = offsets[:-1], offsets[1:]
    there = ~np.asarray(wkb.is_null()) if wkb.null_count else np.ones(n, bool)
    b = np.frombuffer(data, np.uint8)
    at = lambda i: b[np.minimum(i, len(b) - 1)].astype(np.int64)
    word = lambda i: at(i) | at(i + 1) << 8 | at(i + 2) << 16 | at(i + 3) << 24
    size = end - start
    plain = there & (size >= 9) & (at(start) == 1)
    code = np.where(plain, word(start + 1), 0)
    kinds = np.full(n, -1)
    parts = []  # (blob, first byte, vertices, bytes a vertex, big-endian, hole)
    for kind, head, extra in ((1, 5, None), (2, 9, None), (3, 13, 5)):
        m = plain & (code == kind)
        if extra is not None:
            m &= word(start + extra) == 1
        count = np.ones(n, np.int64) if kind == 1 else word(start + head - 4)
        m &= size >= head + 16 * count
        who = np.flatnonzero(m)
        kinds[who] = kind
        parts.append(np.stack([who, start[who] + head, count[who], np.full(len(who), 16), np.zeros(len(who)), np.zeros(len(who))], 1).astype(np.int64))
    codes = {name: c for c, name in _WKB.items()}
    view, slow = memoryview(data), []
    for i in np.flatnonzero(there & (kinds < 0)).tolist():
        rings: list = []
        try:
            kind, _ = _rings_of(view, int(start[i]), int(end[i]), rings)
        except (KeyError, IndexError, _struct.error):
            continue
        kinds[i] = codes[kind]
        slow.extend((i, *r) for r in rings)
    parts.append(np.array(slow, np.int64).reshape(-1, 6))
    rings = np.concatenate(parts)
    rings = rings[np.argsort(rings[:, 0], kind="stable")]
    blob, first, count, stride, big, hole = rings.T
    vertex = np.concatenate(([0], np.cumsum(count)))
    place = np.repeat(first, count) + (np.arange(vertex[-1]) - np.repeat(vertex[:-1], count)) * np.repeat(stride, count)
    swapped = np.repeat(big, count) == 1
    pts = pa.StructArray.from_arrays([pa.array(_doubles(data, place, swapped)), pa.array(_doubles(data, place + 8, swapped))], names=["x", "y"])
    own = pa.StructArray.from_arrays([pa.array(hole == 1), pa.ListArray.from_arrays(pa.array(vertex, pa.int32()), pts)], names=["hole", "pts"])
    bad = pa.array(kinds < 0)
    ends = np.concatenate(([0], np.cumsum(np.bincount(blob, minlength=n)))) if n else np.zeros(1)
    names = pa.array([_WKB.get(k) for k in kinds.tolist()], pa.string())
    return pa.StructArray.from_arrays([names, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), own, mask=bad)], names=["gtype", "rings"])


_VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_RING = T.StructType([T.StructField("hole", T.BooleanType()), T.StructField("pts", T.ArrayType(_VERTEX))])
_DECODED = T.StructType([T.StructField("gtype", T.StringType()), T.StructField("rings", T.ArrayType(_RING))])


@F.arrow_udf(_DECODED)
def _decode_wkb(wkb: pa.Array) -> pa.Array:
    return _columns_of_wkb(wkb)


def from_wkb(wkb: Column) -> Column:
    """Geometry from WKB bytes (plain, with Z/M, or extended); unreadable bytes give null."""
    decoded = _decode_wkb(wkb)
    return from_rings(decoded["gtype"], decoded["rings"])
