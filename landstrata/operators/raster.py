"""Raster work on pixel tables ``row, col, value``.

Neighbour operators run on square tiles with a halo: border pixels are copied to the tiles next to them and each tile
is one bounded group, so no window spans the raster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from landstrata.functions.crs import GEOGRAPHIC, MERCATOR, mercator_lat, mercator_lon, mercator_x, mercator_y
from landstrata.functions.geometry import from_rings
from landstrata.session import cut_lineage

TILE = 256
# Colour of water pixels.
WATER_RGB = (0, 50, 100)


def with_halo(pixels: DataFrame, tile: int = TILE, after_only: bool = False) -> DataFrame:
    """Add ``tr, tc`` (tile) and ``own``; pixels next to a tile border appear in the neighbour tile with ``own`` false.

    ``after_only`` copies just what a look to the next row and column needs.
    """
    r, c = F.col("row"), F.col("col")
    tr, tc = F.floor(r / tile), F.floor(c / tile)
    at = lambda dr, dc, own: F.struct((tr + dr).alias("tr"), (tc + dc).alias("tc"), F.lit(own).alias("own"))
    places = [at(0, 0, True)]
    north, west = (r % tile) == 0, (c % tile) == 0
    places += [F.when(north, at(-1, 0, False)), F.when(west, at(0, -1, False))]
    if after_only:
        places += [F.when(north & west, at(-1, -1, False))]
    else:
        south, east = (r % tile) == tile - 1, (c % tile) == tile - 1
        places += [F.when(south, at(1, 0, False)), F.when(east, at(0, 1, False))]
    placed = pixels.withColumn("__at", F.explode(F.filter(F.array(*places), lambda p: p.isNotNull())))
    return placed.select(
        *pixels.columns, F.col("__at.tr").alias("tr"), F.col("__at.tc").alias("tc"), F.col("__at.own").alias("own")
    )


def _neighbour(value: str, step: int, window, axis: str) -> Column:
    """Value one pixel further along an axis, null when that pixel is missing."""
    shift = F.lead if step > 0 else F.lag
    there = shift(F.col(axis)).over(window) == F.col(axis) + step
    return F.when(there, shift(F.col(value)).over(window))


def gradients(pixels: DataFrame, value: str = "value", tile: int = TILE) -> DataFrame:
    """Add ``gx, gy``: central differences, one-sided where a neighbour is missing."""
    placed = with_halo(pixels, tile).repartition("tr", "tc")
    along = Window.partitionBy("tr", "tc", "row").orderBy("col")
    down = Window.partitionBy("tr", "tc", "col").orderBy("row")

    def slope(before: str, after: str) -> Column:
        v, a, b = F.col(value), F.col(before), F.col(after)
        return (
            F.when(a.isNotNull() & b.isNotNull(), (b - a) / 2)
            .when(b.isNotNull(), b - v)
            .when(a.isNotNull(), v - a)
            .otherwise(F.lit(0.0))
        )

    near = placed.withColumns(
        {
            "__w": _neighbour(value, -1, along, "col"),
            "__e": _neighbour(value, 1, along, "col"),
            "__n": _neighbour(value, -1, down, "row"),
            "__s": _neighbour(value, 1, down, "row"),
        }
    )
    out = near.withColumns({"gx": slope("__w", "__e"), "gy": slope("__n", "__s")})
    return out.filter("own").select(*pixels.columns, "gx", "gy")


def shade(pixels: DataFrame, azimuth: float = 315.0, altitude: float = 45.0, exaggeration: float = 1.0, tile: int = TILE) -> DataFrame:
    """Add ``shade`` in 0..1: light on the surface, stretched over the raster unless it is flat."""
    scaled = pixels.withColumn("__z", F.col("value") * F.lit(exaggeration))
    g = gradients(scaled, "__z", tile)
    az, alt = math.radians(90 - azimuth), math.radians(altitude)
    # Rows grow southwards, so the slope along rows changes its sign.
    gx, gy = F.col("gx"), -F.col("gy")
    light = (
        -gx * F.lit(math.cos(az) * math.cos(alt)) - gy * F.lit(math.sin(az) * math.cos(alt)) + F.lit(math.sin(alt))
    ) / F.sqrt(gx * gx + gy * gy + 1)
    # Read twice, for the range and for the result; written once, so the slopes are worked out once.
    lit = cut_lineage(g.withColumn("__i", light))
    low, high = _range_of(lit, "__i")
    span = high - low
    stretched = F.when(span > 1e-6, (F.col("__i") - low) / span).otherwise(F.col("__i"))
    bounded = F.least(F.greatest(stretched, F.lit(0.0)), F.lit(1.0))
    return lit.withColumn("shade", bounded).drop("__i", "__z", "gx", "gy")


def _range_of(df: DataFrame, column: str) -> tuple[Column, Column]:
    """Least and greatest value of the whole table as one scalar subquery."""
    one = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).select(F.struct("lo", "hi").alias("r")).scalar()
    return one["lo"], one["hi"]


def hillshade_rgb(pixels: DataFrame, intensity: float = 1.0, tile: int = TILE) -> DataFrame:
    """Add ``red, green, blue`` in 0..255: shade faded toward white, and the water colour at or below zero."""
    shaded = shade(pixels, tile=tile)
    level = F.col("shade")
    if intensity < 1.0:
        level = level * F.lit(intensity) + F.lit(1.0 - intensity)
    grey = (level * 255).cast("int")
    water = F.col("value") <= 0
    band = lambda k: F.when(water, F.lit(WATER_RGB[k])).otherwise(grey)
    return shaded.withColumns({"red": band(0), "green": band(1), "blue": band(2)})


def contours(pixels: DataFrame, interval: float, tile: int = TILE) -> DataFrame:
    """Contour segments ``elevation, x1, y1, x2, y2`` in pixel coordinates (column, row).

    Each square of four neighbouring pixels is cut at every level inside its range; a saddle is settled by the mean
    of its corners. A corner exactly on a level counts as above it.
    """
    return _cuts(pixels, interval, tile).select(
        "row", "col", "elevation", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2")
    )


def _cuts(pixels: DataFrame, interval: float, tile: int) -> DataFrame:
    """``row, col, elevation, s``: a segment with its ends ``p`` and ``q``, each a point and the pixel edge it lies on.

    An edge is named by its pixel and whether it runs east (0) or south (1) from there. At a level an edge has one point,
    and at most two segments end in it.
    """
    placed = with_halo(pixels.select("row", "col", "value"), tile, after_only=True).repartition("tr", "tc")
    along = Window.partitionBy("tr", "tc", "row").orderBy("col")
    east = placed.withColumn("b", _neighbour("value", 1, along, "col"))
    down = Window.partitionBy("tr", "tc", "col").orderBy("row")
    squares = east.withColumns(
        {"a": F.col("value"), "d": _neighbour("value", 1, down, "row"), "c": _neighbour("b", 1, down, "row")}
    ).filter("own AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL")
    # a north-west, b north-east, c south-east, d south-west
    low, high = F.least("a", "b", "c", "d"), F.greatest("a", "b", "c", "d")
    first = F.floor(low / F.lit(interval)) + 1
    last = F.floor(high / F.lit(interval))
    cut = squares.filter(first <= last).withColumn(
        "elevation", F.explode(F.transform(F.sequence(first, last), lambda k: k * F.lit(float(interval))))
    )
    level = F.col("elevation")
    up = {k: F.col(k) >= level for k in "abcd"}
    case = sum((up[k].cast("int") * w for k, w in zip("abcd", (8, 4, 2, 1))), F.lit(0))
    t = lambda p, q: F.try_divide(level - F.col(p), F.col(q) - F.col(p))
    x, y = F.col("col").cast("double"), F.col("row").cast("double")
    end = lambda x, y, dr, dc, o: F.struct(x.alias("x"), y.alias("y"), (F.col("row") + dr).cast("bigint").alias("r"), (F.col("col") + dc).cast("bigint").alias("c"), F.lit(o).alias("o"))
    north, south = end(x + t("a", "b"), y, 0, 0, 0), end(x + t("d", "c"), y + 1, 1, 0, 0)
    left, right = end(x, y + t("a", "d"), 0, 0, 1), end(x + 1, y + t("b", "c"), 0, 1, 1)
    pair = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    mean_up = (F.col("a") + F.col("b") + F.col("c") + F.col("d")) / 4 >= level
    k = F.col("__case")
    segments = (
        F.when(k.isin(1, 14), F.array(pair(left, south)))
        .when(k.isin(2, 13), F.array(pair(south, right)))
        .when(k.isin(3, 12), F.array(pair(left, right)))
        .when(k.isin(4, 11), F.array(pair(north, right)))
        .when(k.isin(6, 9), F.array(pair(north, south)))
        .when(k.isin(7, 8), F.array(pair(left, north)))
        .when((k == 5) == mean_up, F.array(pair(left, north), pair(south, right)))
        .otherwise(F.array(pair(left, south), pair(north, right)))
    )
    return (
        cut.withColumn("__case", case)
        .filter(~k.isin(0, 15))
        .withColumn("s", F.explode(segments))
        .select("row", "col", "elevation", "s")
    )


_PIECES = "id string, elevation double, pr long, pc long, po long, qr long, qc long, qo long, xs array<double>, ys array<double>, n long, tr long, tc long"
_STEP = "child string, id string, elevation double, pr long, pc long, po long, qr long, qc long, qo long, n long, tr long, tc long, start long, size long, flip boolean, first boolean"


def _follow(ends: list[tuple]) -> list[tuple[list[tuple[int, bool]], bool]]:
    """Chains of links ``(end, other end)``, of which at most two share an end: the links in order, each with whether it is
    turned around, and whether the chain closes."""
    at: dict = {}
    for i, (a, b) in enumerate(ends):
        at.setdefault(a, []).append(i)
        at.setdefault(b, []).append(i)
    used, out = [False] * len(ends), []

    def extend(tip, turned: bool) -> tuple[list[tuple[int, bool]], tuple]:
        found = []
        while True:
            i = next((j for j in at[tip] if not used[j]), None)
            if i is None:
                return found, tip
            used[i] = True
            a, b = ends[i]
            back = a != tip
            found.append((i, back != turned))
            tip = a if back else b

    for i, (a, b) in enumerate(ends):
        if used[i]:
            continue
        used[i] = True
        ahead, tip = extend(b, False)
        behind = [] if tip == a else extend(a, True)[0]
        out.append(([*reversed(behind), (i, False), *ahead], tip == a))
    return out


def _pieces(pdf):
    """The chains of the segments of one tile."""
    import pandas as pd

    pdf = pdf.sort_values(["elevation", "row", "col", "pr", "pc", "po"])
    rows = list(zip(pdf["elevation"], pdf["pr"], pdf["pc"], pdf["po"], pdf["px"], pdf["py"], pdf["qr"], pdf["qc"], pdf["qo"], pdf["qx"], pdf["qy"]))
    places = list(zip(pdf["row"].tolist(), pdf["col"].tolist(), pdf["pr"].tolist(), pdf["pc"].tolist(), pdf["po"].tolist()))
    out = []
    for chain, _ in _follow([((e, *p), (e, *q)) for e, *p, _, _, q0, q1, q2, _, _ in rows for q in [(q0, q1, q2)]]):
        edges, xs, ys = [], [], []
        for n, (i, turned) in enumerate(chain):
            e, pr, pc, po, px, py, qr, qc, qo, qx, qy = rows[i]
            a, b = ((pr, pc, po), px, py), ((qr, qc, qo), qx, qy)
            if turned:
                a, b = b, a
            for edge, x, y in [a, b] if n == 0 else [b]:
                edges.append(edge)
                xs.append(x)
                ys.append(y)
        # A segment's square and first edge are its own; an edge on a tile's border is in two pieces.
        name = ":".join(map(str, (repr(float(e)), *min(places[i] for i, _ in chain))))
        out.append((name, e, *edges[0], *edges[-1], xs, ys, 1, int(pdf["tr"].iloc[0]), int(pdf["tc"].iloc[0])))
    return pd.DataFrame(out, columns=[f.split(" ")[0] for f in _PIECES.split(", ")])


def _longer(pdf):
    """Chains of one larger tile from those of its tiles: a row for each, with its place in the longer one."""
    import pandas as pd

    pdf = pdf.sort_values("id")
    ids, sizes, levels = pdf["id"].tolist(), pdf["n"].tolist(), pdf["elevation"].tolist()
    ends = [((e, *k[:3]), (e, *k[3:])) for e, *k in zip(levels, *(pdf[c].tolist() for c in ("pr", "pc", "po", "qr", "qc", "qo")))]
    out = []
    for chain, _ in _follow(ends):
        total, start, name = sum(sizes[i] for i, _ in chain), 0, min(ids[i] for i, _ in chain)
        side = lambda link, last: ends[link[0]][last != link[1]][1:]
        edges = (*side(chain[0], False), *side(chain[-1], True))
        for n, (i, turned) in enumerate(chain):
            out.append((ids[i], name, levels[i], *edges, total, int(pdf["tr"].iloc[0]), int(pdf["tc"].iloc[0]), start, sizes[i], turned, n == 0))
            start += sizes[i]
    return pd.DataFrame(out, columns=[f.split(" ")[0] for f in _STEP.split(", ")])


def contour_lines(pixels: DataFrame, interval: float, tile: int = TILE, fanout: int = 8) -> DataFrame:
    """Contours as whole lines ``elevation, closed, geom``, each as long as it goes.

    The segments of a tile are joined to pieces, those of ``fanout`` by ``fanout`` tiles to longer ones, and so on until one
    tile holds the raster. After the first step only names and ends go on, of pieces that reach a border of their tile; the
    places of the pieces in their line come back the same way, and the points are put together once, line by line.
    """
    cuts = _cuts(pixels, interval, tile)
    flat = [F.col(f"s.{e}.{k}").alias(f"{e}{k}") for e in "pq" for k in ("r", "c", "o", "x", "y")]
    placed = cuts.select("row", "col", "elevation", F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc"), *flat)
    pieces = cut_lineage(placed.groupBy("tr", "tc").applyInPandas(_pieces, _PIECES))
    reach = pieces.agg(F.min("tr").alias("r"), F.min("tc").alias("c"), F.greatest(F.max("tr") - F.min("tr"), F.max("tc") - F.min("tc")).alias("span")).first()
    top, left, span = reach["r"] or 0, reach["c"] or 0, reach["span"] or 0

    def goes_on(size: int) -> Column:
        """An end lies on a border between tiles of this size, and the piece is not closed."""
        border = lambda e: F.when(F.col(f"{e}o") == 0, (F.col(f"{e}r") - top * tile) % size == 0).otherwise((F.col(f"{e}c") - left * tile) % size == 0)
        closed = (F.col("pr") == F.col("qr")) & (F.col("pc") == F.col("qc")) & (F.col("po") == F.col("qo"))
        return ~closed & (border("p") | border("q"))

    now, tiles, steps = pieces.drop("xs", "ys").withColumns({"tr": F.col("tr") - top, "tc": F.col("tc") - left}), 1, []
    while tiles <= span:
        inner = now.where(goes_on(tile * tiles))
        tiles *= fanout
        step = cut_lineage(inner.withColumns({"tr": F.floor(F.col("tr") / fanout), "tc": F.floor(F.col("tc") / fanout)}).groupBy("tr", "tc").applyInPandas(_longer, _STEP))
        steps.append(step)
        now = step.where("first").select("id", "elevation", "pr", "pc", "po", "qr", "qc", "qo", "n", "tr", "tc")
    # Downwards: the line a piece is part of, its place there and its direction.
    known = None
    for step in reversed(steps):
        own = step.select("child", "id", "n", "start", "size", "flip")
        if known is None:
            known = own.select("child", F.col("id").alias("line"), F.col("start").alias("place"), F.col("flip").alias("turned"))
            continue
        up = known.withColumnsRenamed({"child": "id"})
        joined = own.join(up, "id", "left")
        turned = F.coalesce("turned", F.lit(False))
        inner = F.when(turned, F.col("n") - F.col("start") - F.col("size")).otherwise(F.col("start"))
        known = joined.select("child", F.coalesce("line", "id").alias("line"), (F.coalesce("place", F.lit(0)) + inner).alias("place"), (F.col("flip") != turned).alias("turned"))
    pts = F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y"))
    if known is None:
        lines = pieces.select("elevation", pts.alias("pts"))
    else:
        placed = pieces.join(known.withColumnRenamed("child", "id"), "id", "left")
        way = F.when(F.coalesce("turned", F.lit(False)), F.reverse(pts)).otherwise(pts)
        parts = placed.groupBy(F.coalesce("line", "id").alias("line"), "elevation").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("place", F.lit(0)).alias("place"), way.alias("pts")))).alias("parts"))
        # Every part but the first starts where the one before it ends.
        whole = F.flatten(F.transform("parts", lambda k, i: F.when(i == 0, k["pts"]).otherwise(F.slice(k["pts"], F.lit(2), F.size(k["pts"])))))
        lines = parts.select("elevation", whole.alias("pts"))
    ring = F.array(F.struct(F.lit(False).alias("hole"), F.col("pts").alias("pts")))
    return lines.select("elevation", (F.col("pts")[0] == F.element_at("pts", -1)).alias("closed"), from_rings(F.lit("LineString"), ring).alias("geom"))


def contour_line_layer(pixels: DataFrame, interval: float, alterations: dict | None = None, tile: int = TILE) -> DataFrame:
    """Contour lines as features with an ``elevation`` property, then altered."""
    from landstrata.operators.alter import alter

    out = contour_lines(pixels, interval, tile).select(F.create_map(F.lit("elevation"), F.col("elevation").cast("string")).alias("properties"), "geom")
    return alter(out, alterations) if alterations else out


def contour_layer(pixels: DataFrame, interval: float, alterations: dict | None = None, tile: int = TILE) -> DataFrame:
    """Contour segments as line features with an ``elevation`` property, then altered."""
    from landstrata.functions.geometry import line
    from landstrata.operators.alter import alter

    c = contours(pixels, interval, tile)
    out = c.select(
        F.create_map(F.lit("elevation"), F.col("elevation").cast("string")).alias("properties"),
        line((F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2"))).alias("geom"),
    )
    return alter(out, alterations) if alterations else out


def resample(
    pixels: DataFrame, source: dict, target: dict, width: int, source_crs: str = "EPSG:4326", target_crs: str = "EPSG:4326"
) -> DataFrame:
    """Crop, reproject and resample bilinearly to ``width`` columns; rows follow from the aspect of the box.

    ``source`` has ``west, north, dx, dy`` (north-west corner and pixel sizes), ``target`` ``west, south, east,
    north``. Each source pixel is sent to the (up to four) target weights it has by an equi join, and the weights are
    summed per target pixel; a target pixel over missing source pixels uses those that are there.
    """
    step = (target["east"] - target["west"]) / width
    height = max(1, math.floor((target["north"] - target["south"]) / step + 0.5))
    spark = pixels.sparkSession
    grid = spark.range(height * width).select(
        F.floor(F.col("id") / width).alias("row"), (F.col("id") % width).alias("col")
    )
    x = F.lit(target["west"]) + (F.col("col") + 0.5) * F.lit(step)
    y = F.lit(target["north"]) - (F.col("row") + 0.5) * F.lit((target["north"] - target["south"]) / height)
    if target_crs == MERCATOR and source_crs in GEOGRAPHIC:
        x, y = mercator_lon(x), mercator_lat(y)
    elif source_crs == MERCATOR and target_crs in GEOGRAPHIC:
        x, y = mercator_x(x), mercator_y(y)
    elif {source_crs, target_crs} - set(GEOGRAPHIC) and source_crs != target_crs:
        raise ValueError(f"unsupported reference systems {source_crs}, {target_crs}")
    at = grid.select(
        "row",
        "col",
        ((x - F.lit(source["west"])) / F.lit(source["dx"]) - 0.5).alias("u"),
        ((F.lit(source["north"]) - y) / F.lit(source["dy"]) - 0.5).alias("v"),
    )
    u0, v0 = F.floor("u"), F.floor("v")
    fu, fv = F.col("u") - u0, F.col("v") - v0
    corner = lambda dr, dc, w: F.struct((v0 + dr).alias("sr"), (u0 + dc).alias("sc"), w.alias("w"))
    needs = at.withColumn(
        "n",
        F.explode(
            F.filter(
                F.array(
                    corner(0, 0, (1 - fu) * (1 - fv)), corner(0, 1, fu * (1 - fv)),
                    corner(1, 0, (1 - fu) * fv), corner(1, 1, fu * fv),
                ),
                lambda k: k["w"] > 0,
            )
        ),
    ).select("row", "col", F.col("n.sr").alias("sr"), F.col("n.sc").alias("sc"), F.col("n.w").alias("w"))
    values = pixels.select(F.col("row").alias("sr"), F.col("col").alias("sc"), "value")
    return (
        needs.join(values, ["sr", "sc"])
        .groupBy("row", "col")
        .agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
    )


def region_pixels(pixels: DataFrame, source: dict, regions: DataFrame, name: str = "name", geom: str = "geom", tile: int = TILE) -> DataFrame:
    """The pixels of each region: every pixel whose centre lies in the region's box, once for each region it is in.

    ``source`` has ``west, north, dx, dy`` (north-west corner and pixel sizes). A region is filed under the tiles its box
    covers and meets the pixels in an equi join on the tile. Beside ``row, col, value`` come ``region`` and the pixel's
    place in the region's own raster, ``region_row`` and ``region_col`` from 0 at its north-west pixel.
    """
    b = F.col(geom)["bbox"]
    # The first pixel whose centre is inside, and the last one.
    first = lambda edge, start, step: F.ceil((edge - F.lit(start)) / F.lit(step) - 0.5)
    last = lambda edge, start, step: F.floor((edge - F.lit(start)) / F.lit(step) - 0.5)
    spans = regions.where(b["west"].isNotNull()).select(
        F.col(name).alias("region"), first(b["west"], source["west"], source["dx"]).alias("c0"), last(b["east"], source["west"], source["dx"]).alias("c1"),
        F.ceil((F.lit(source["north"]) - b["north"]) / F.lit(source["dy"]) - 0.5).alias("r0"), F.floor((F.lit(source["north"]) - b["south"]) / F.lit(source["dy"]) - 0.5).alias("r1"),
    ).where("c0 <= c1 and r0 <= r1")
    cover = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / tile), F.floor(F.col(z) / tile)))
    filed = spans.withColumn("tr", cover("r0", "r1")).withColumn("tc", cover("c0", "c1"))
    placed = pixels.withColumns({"tr": F.floor(F.col("row") / tile), "tc": F.floor(F.col("col") / tile)})
    inside = placed.join(filed, ["tr", "tc"]).where(F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1")))
    return inside.select("region", (F.col("row") - F.col("r0")).alias("region_row"), (F.col("col") - F.col("c0")).alias("region_col"), *[F.col(f"`{c}`") for c in pixels.columns])


def blend(value: Column, grey: Column, percent: float) -> Column:
    """``percent`` of grey mixed into a value."""
    return value * F.lit(1.0 - percent / 100.0) + grey * F.lit(percent / 100.0)


def stretch(df: DataFrame, column: str = "value", name: str = "byte") -> DataFrame:
    """Least to greatest value stretched over 0..255."""
    low, high = _range_of(df, column)
    scaled = F.when(high > low, (F.col(column) - low) / (high - low) * 255).otherwise(F.lit(0.0))
    return df.withColumn(name, F.floor(scaled + 0.5).cast("int"))
