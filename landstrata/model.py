"""Column types shared by all layers.

A feature is one row: ``feature_id``, ``geom`` and ``properties``. ``geom`` keeps every GeoJSON geometry as a flat
list of rings: a point is one ring of one vertex, a line one ring, a polygon its outer ring followed by its holes,
and a multi geometry the rings of its parts one after another.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

POINT = "struct<x:double,y:double>"
RINGS = f"array<struct<hole:boolean,pts:array<{POINT}>>>"
BBOX = "struct<west:double,south:double,east:double,north:double>"
GEOM = f"struct<gtype:string,is_box:boolean,bbox:{BBOX},rings:{RINGS}>"
PROPS = "map<string,string>"
FEATURE = f"feature_id string, geom {GEOM}, properties {PROPS}"
LAYER = f"{FEATURE}, ts timestamp, file string, pos bigint"

POLYGONAL = ("Polygon", "MultiPolygon")
LINEAR = ("LineString", "MultiLineString")


def feature_key(name: Column, geometry_text: Column) -> Column:
    """Deterministic feature identity from name and geometry text."""
    return F.sha2(F.concat_ws("|", F.coalesce(name, F.lit("")), geometry_text), 256)
