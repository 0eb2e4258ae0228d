"""Geographic and web-mercator coordinates, map tiles and pixel bins."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH = 6378137.0  # radius used by EPSG:3857, metres
GEOGRAPHIC = ("EPSG:4326", "EPSG:4269")
MERCATOR = "EPSG:3857"


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * F.lit(EARTH)


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * F.lit(EARTH)


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / F.lit(EARTH))


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.exp(y / F.lit(EARTH))) * 2 - F.lit(math.pi / 2))


def reproject(geom: str, source: str, target: str) -> Column:
    """Geometry in another reference system; the two geographic ones are taken as equal."""
    for code in (source, target):
        if code not in GEOGRAPHIC and code != MERCATOR:
            raise ValueError(f"unsupported reference system {code}")
    if (source == target) or (source in GEOGRAPHIC and target in GEOGRAPHIC):
        return F.col(geom)
    fx, fy = (mercator_x, mercator_y) if target == MERCATOR else (mercator_lon, mercator_lat)

    def vertex(p: Column) -> Column:
        return F.struct(fx(p["x"]).alias("x"), fy(p["y"]).alias("y"))

    g = F.col(geom)
    rings = F.transform(
        g["rings"], lambda r: F.struct(r["hole"].alias("hole"), F.transform(r["pts"], vertex).alias("pts"))
    )
    b = g["bbox"]
    # Both axes are monotone, so the bbox and the box flag carry over.
    box = F.struct(
        fx(b["west"]).alias("west"), fy(b["south"]).alias("south"), fx(b["east"]).alias("east"), fy(b["north"]).alias("north")
    )
    made = F.struct(g["gtype"].alias("gtype"), g["is_box"].alias("is_box"), box.alias("bbox"), rings.alias("rings"))
    return F.when(g.isNotNull(), made)


def web_tile(lon: Column, lat: Column, zoom: int) -> Column:
    """``struct<x,y,z>`` of the map tile that holds a point."""
    n = float(2**zoom)
    r = F.radians(lat)
    stretch = F.log(F.tan(r) + F.lit(1.0) / F.cos(r))
    x = F.floor((lon / F.lit(360.0) + F.lit(0.5)) * F.lit(n))
    y = F.floor((F.lit(1.0) - stretch / F.lit(math.pi)) * F.lit(n / 2))
    return F.struct(x.alias("x"), y.alias("y"), F.lit(zoom).cast("bigint").alias("z"))


def pixel_bin(lon: Column, lat: Column, box: dict, width: int, height: int, symbol: int = 1) -> Column:
    """``struct<px,py>`` of a point on a map image, null where a centred symbol would leave the image."""
    w, h = box["east"] - box["west"], box["north"] - box["south"]
    # Image coordinates are cut toward zero.
    px = ((lon - F.lit(box["west"])) / F.lit(w) * F.lit(float(width))).cast("bigint")
    py = ((F.lit(box["north"]) - lat) / F.lit(h) * F.lit(float(height))).cast("bigint")
    half = symbol // 2
    left, top = px - half, py - half
    fits = (left >= 0) & (top >= 0) & (left + symbol <= width) & (top + symbol <= height)
    return F.when(fits, F.struct(px.alias("px"), py.alias("py")))
