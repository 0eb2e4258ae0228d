"""Clipping to a rectangle: points are kept or dropped, lines and polygons are cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from landstrata.functions.geometry import _let, box_spans, ends_of, from_rings, line, lone_segment, once
from landstrata.model import RINGS

_NONE = "cast(array() as array<struct<x:double,y:double>>)"


def _line_runs(points: str, b: str) -> str:
    """Pieces of a line inside a box; consecutive pieces that meet stay one line."""

    enter, leave = box_spans("s.{}".format, b)
    segments = (
        f"transform(sequence(0, greatest(size({points}) - 2, 0)), i -> named_struct("
        f"'ax', {points}[i].x, 'ay', {points}[i].y, 'bx', {points}[least(i + 1, size({points}) - 1)].x, "
        f"'by', {points}[least(i + 1, size({points}) - 1)].y))"
    )
    near = (
        f"least(s.ax, s.bx) <= {b}.east AND greatest(s.ax, s.bx) >= {b}.west AND "
        f"least(s.ay, s.by) <= {b}.north AND greatest(s.ay, s.by) >= {b}.south"
    )
    spans = f"transform(filter({segments}, s -> {near}), s -> named_struct('s', s, 't0', {enter}, 't1', {leave}))"

    def at(t: str) -> str:
        return (
            f"named_struct('x', if({t} = 1, k.s.bx, k.s.ax + {t} * (k.s.bx - k.s.ax)), "
            f"'y', if({t} = 1, k.s.by, k.s.ay + {t} * (k.s.by - k.s.ay)))"
        )

    pieces = f"transform(filter({spans}, k -> k.t0 < k.t1), k -> array({at('k.t0')}, {at('k.t1')}))"
    return (
        f"aggregate({pieces}, cast(array() as array<array<struct<x:double,y:double>>>), (acc, piece) -> "
        "if(size(acc) > 0 AND element_at(element_at(acc, -1), -1) = piece[0], "
        "concat(slice(acc, 1, size(acc) - 1), array(concat(element_at(acc, -1), array(piece[1])))), "
        "concat(acc, array(piece))))"
    )


def _half_plane(points: str, axis: str, bound: str, keep: str) -> str:
    """One cut of a closed ring: walk its edges, keep the inner side of ``axis keep bound``, close the result."""
    other = "y" if axis == "x" else "x"
    ins = f"u.{axis} {keep} {bound}"
    ine = f"v.{axis} {keep} {bound}"
    ratio = f"(({bound} - u.{axis}) / (v.{axis} - u.{axis}))"
    hit_other = f"u.{other} + {ratio} * (v.{other} - u.{other})"
    hit = (
        f"named_struct('x', {bound}, 'y', {hit_other})" if axis == "x" else f"named_struct('x', {hit_other}, 'y', {bound})"
    )
    edge = f"CASE WHEN {ine} THEN if({ins}, array(v), array({hit}, v)) WHEN {ins} THEN array({hit}) ELSE {_NONE} END"
    walk = (
        f"flatten(transform(sequence(0, size({points}) - 2), i -> "
        + _let("u", f"{points}[i]", _let("v", f"{points}[i + 1]", edge))
        + "))"
    )
    return f"if(size({points}) < 4, {_NONE}, {_let('w', walk, 'concat(w, slice(w, 1, 1))')})"


def _ring_cut(points: str, b: str) -> str:
    east = _half_plane("c1", "x", f"{b}.east", "<=")
    south = _half_plane("c2", "y", f"{b}.south", ">=")
    north = _half_plane("c3", "y", f"{b}.north", "<=")
    west = _half_plane(points, "x", f"{b}.west", ">=")
    return _let("c1", west, _let("c2", east, _let("c3", south, north)))


def _has_area(points: str) -> str:
    return (
        f"size({points}) >= 4 AND aggregate(sequence(0, size({points}) - 2), 0D, (acc, i) -> acc + "
        f"({points}[i].x - {points}[0].x) * ({points}[i + 1].y - {points}[0].y) - "
        f"({points}[i + 1].x - {points}[0].x) * ({points}[i].y - {points}[0].y)) <> 0"
    )


def clip(geom: str, box: str) -> Column:
    """Part of a geometry column inside a bbox column, null when nothing is left.

    A concave polygon cut into pieces keeps them in one ring joined along the box edge.
    """
    g, b = geom, box
    kept_points = (
        f"filter({g}.rings, r -> r.pts[0].x BETWEEN {b}.west AND {b}.east AND r.pts[0].y BETWEEN {b}.south AND {b}.north)"
    )
    runs = f"flatten(transform({g}.rings, r -> {_line_runs('r.pts', b)}))"
    lines = f"transform({runs}, p -> named_struct('hole', false, 'pts', p))"
    cut = f"transform({g}.rings, r -> named_struct('hole', r.hole, 'pts', {_ring_cut('r.pts', b)}))"
    polygons = f"filter({cut}, r -> {_has_area('r.pts')})"
    inside = (
        f"{g}.bbox.west >= {b}.west AND {g}.bbox.east <= {b}.east AND "
        f"{g}.bbox.south >= {b}.south AND {g}.bbox.north <= {b}.north"
    )
    rings = F.expr(
        f"CASE WHEN {g}.gtype IN ('Point', 'MultiPoint') THEN {kept_points} "
        f"WHEN {g}.gtype IN ('LineString', 'MultiLineString') THEN {lines} ELSE {polygons} END"
    ).cast(RINGS)
    # A line in several pieces is a multi line; one piece stays a line.
    several = lambda c: c.withField(
        "gtype", F.when((c["gtype"] == "LineString") & (F.size(c["rings"]) != 1), F.lit("MultiLineString")).otherwise(c["gtype"])
    )
    cut_down = F.get(F.transform(F.array(from_rings(F.expr(f"{g}.gtype"), rings)), several), F.lit(0))
    return F.when(F.expr(inside), F.col(geom)).otherwise(cut_down)


def clip_rows(df: DataFrame, geom: str, box: str) -> DataFrame:
    """Rows with ``geom`` cut to the bbox column ``box``, as :func:`clip` does; rows of which nothing is left go.

    Lines of two vertices are cut by plain arithmetic, the rest by :func:`clip`.
    """
    g, b = F.col(geom)["bbox"], F.col(box)
    whole = (g["west"] >= b["west"]) & (g["east"] <= b["east"]) & (g["south"] >= b["south"]) & (g["north"] <= b["north"])
    # Steps by generators: Spark would copy the arithmetic into each later use and make methods that are too long to compile.
    rows = df.withColumn("__line", once(F.when(F.expr(lone_segment(geom)), ends_of(geom))))
    enter, leave = (F.expr(t) for t in box_spans("__line.{}".format, box))
    rows = rows.withColumn("__span", once(F.when(F.col("__line").isNotNull(), F.struct(enter.alias("a"), leave.alias("b"), whole.alias("whole")))))
    span = F.col("__span")
    rows = rows.filter(span.isNull() | span["whole"] | (span["a"] < span["b"]))

    def at(t: str, axis: str) -> Column:
        p, q = F.col(f"__line.a{axis}"), F.col(f"__line.b{axis}")
        return F.when(span[t] == 1, q).otherwise(p + span[t] * (q - p))

    rows = rows.withColumn("__ends", once(F.struct(*[at(t, c).alias(t + c) for t in "ab" for c in "xy"])))
    cut = line(*[(F.col(f"__ends.{t}x"), F.col(f"__ends.{t}y")) for t in "ab"])
    rows = rows.withColumn("__cut", F.when(span.isNotNull(), F.when(span["whole"], F.col(geom)).otherwise(cut)))
    rows = rows.withColumn("__cut", once(F.when(span.isNotNull(), F.col("__cut")).otherwise(clip(geom, box))))
    return rows.filter(F.col("__cut").isNotNull()).withColumn(geom, F.col("__cut")).drop("__line", "__span", "__ends", "__cut")
