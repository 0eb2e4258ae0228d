"""Regions: loading, neighbours, map grids, extracts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from landstrata.functions.clip import clip_rows
from landstrata.functions.geometry import box_polygon, from_rings
from landstrata.functions.props import map_merge, props_or_empty, value_of
from landstrata.functions.text import canonical_name
from landstrata.operators.skew import LIMIT, neighbors_in_order
from landstrata.operators.spatial_join import spatial_pairs

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def row_letters(row, rows: int):
    """Letters of a row counted from 0: A to Z, AA to AZ and so on, for a grid of ``rows`` rows."""
    out, rest = F.lit(""), F.lit(row) if isinstance(row, int) else row
    more = rows
    while more > 0:
        one = F.substring(F.lit(LETTERS), (F.pmod(rest, F.lit(26)) + 1).cast("int"), F.lit(1))
        out = F.when(rest >= 0, F.concat(one, out)).otherwise(out)
        rest = F.floor(rest / 26).cast("int") - 1
        more = more // 26
    return out


def map_grid(spark: SparkSession, bbox: dict, columns: int) -> DataFrame:
    """Square cells over a bbox from its north-west corner, named ``{col}_{Letter}``, with neighbour names.

    Rows past Z are AA, AB and so on; the last row may reach over the south edge.
    """
    size = abs(bbox["east"] - bbox["west"]) / columns
    rows = math.ceil(abs(bbox["north"] - bbox["south"]) / size)
    cells = spark.range(rows * columns).select(
        F.floor(F.col("id") / columns).cast("int").alias("row"), (F.col("id") % columns).cast("int").alias("col")
    )
    name = lambda c, r: F.concat((c + 1).cast("string"), F.lit("_"), row_letters(r, rows))
    r, c = F.col("row"), F.col("col")
    west, east = F.lit(bbox["west"]) + c * size, F.lit(bbox["west"]) + (c + 1) * size
    north, south = F.lit(bbox["north"]) - r * size, F.lit(bbox["north"]) - (r + 1) * size
    return cells.select(
        "row",
        "col",
        name(c, r).alias("name"),
        F.when(r > 0, name(c, r - 1)).alias("north_name"),
        F.when(r < rows - 1, name(c, r + 1)).alias("south_name"),
        F.when(c > 0, name(c - 1, r)).alias("west_name"),
        F.when(c < columns - 1, name(c + 1, r)).alias("east_name"),
        box_polygon(west, south, east, north).alias("geom"),
    )


def grid_cell(lon, lat, bbox: dict, columns: int):
    """Name of the map-grid cell that holds a point, null outside the grid; no join is needed on a regular grid."""
    size = abs(bbox["east"] - bbox["west"]) / columns
    rows = math.ceil(abs(bbox["north"] - bbox["south"]) / size)
    col = F.floor((lon - F.lit(bbox["west"])) / F.lit(size)).cast("int")
    row = F.floor((F.lit(bbox["north"]) - lat) / F.lit(size)).cast("int")
    inside = (col >= 0) & (col < columns) & (row >= 0) & (row < rows)
    return F.when(inside, F.concat((col + 1).cast("string"), F.lit("_"), row_letters(row, rows)))


def link_neighbors(df: DataFrame, position: str, name: str = "name", keys: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """Add ``prev`` and ``next`` names in position order, the ends joined to each other."""
    return neighbors_in_order(df, keys or [], [position], name, circular=True, limit=limit)


def load_regions(
    features: DataFrame, position: str = "pos", start_at: int = 0, limit: int = 0, prefer: str = "Description", limit_mode: str = "absolute"
) -> DataFrame:
    """Regions from polygon features: name, caption, text, bbox and neighbours.

    ``position`` counts from 0. With ``limit_mode='absolute'`` the limit is an index, so ``limit - start_at`` regions
    come out; with ``'count'`` it is their number. ``prefer='name'`` takes a ``name`` property before
    ``Description``.
    """
    i = F.col(position)
    chosen = features.filter(i >= start_at)
    if limit > 0:
        chosen = chosen.filter(i < (limit if limit_mode == "absolute" else start_at + limit))
    props = F.col("properties")
    default = F.concat(F.lit("Region "), i.cast("string"))
    title = F.coalesce(value_of(props, "Description"), default)
    if prefer == "name":
        title = F.coalesce(value_of(props, "name"), title)
    regions = chosen.filter(F.col("geom").isNotNull()).select(
        position,
        canonical_name(title).alias("name"),
        title.alias("caption"),
        F.coalesce(value_of(props, "text"), default).alias("text"),
        F.col("geom.bbox").alias("bbox"),
        "geom",
        *(["neighbors"] if "neighbors" in features.columns else []),
    )
    linked = link_neighbors(regions, position)
    circular = F.create_map(F.lit("prev"), F.col("prev"), F.lit("next"), F.col("next"))
    given = F.col("neighbors") if "neighbors" in features.columns else F.lit(None).cast("map<string,string>")
    return linked.withColumn("neighbors", F.coalesce(given, circular)).drop("prev", "next")


def region_extract(features: DataFrame, regions: DataFrame, feature_id: str = "feature_id", region_name: str = "name", **options) -> DataFrame:
    """All features of all layers cut to all regions in one job: one row per feature and region it reaches into."""
    slim = regions.select(region_name, "geom")
    pairs = spatial_pairs(
        features, slim, left_id=feature_id, right_id=region_name, right_prefix="region_", predicate="bbox", **options
    )
    cut = clip_rows(pairs.withColumn("__box", F.col("region_geom.bbox")), "geom", "__box")
    return cut.drop("__box", "region_geom").withColumnRenamed("region_" + region_name, "region")


def visible_layers(df: DataFrame, default_layers: list[str], overrides: DataFrame, region: str = "region", layer: str = "layer") -> DataFrame:
    """Rows whose layer is shown in their region: the region's own list where it has one, else the default list.

    ``overrides`` has one row per region and layer of such a list.
    """
    own = overrides.select(F.col(region), F.col(layer)).distinct()
    has_own = own.select(region).distinct()
    by_own = df.join(own, [region, layer], "left_semi")
    by_default = df.filter(F.col(layer).isin(default_layers)).join(has_own, region, "left_anti")
    return by_own.unionByName(by_default)


def slice_rows(df: DataFrame, position: str, start_at: int = 0, limit: int = 0, first_n: int = 0) -> DataFrame:
    """Rows of a position range; positions count from 0 and ``limit`` is an absolute index."""
    out = df.filter(F.col(position) >= start_at)
    if limit > 0:
        out = out.filter(F.col(position) < limit)
    if first_n > 0:
        out = out.filter(F.col(position) < first_n)
    return out


# ---------------------------------------------------------------------------------------------------------------
# frames
# ---------------------------------------------------------------------------------------------------------------
def squarify(df: DataFrame, geom: str = "geom", props: str = "properties") -> DataFrame:
    """Polygons become the square of their longer side around the same centre, with the old sizes as properties."""
    b = F.col(geom)["bbox"]
    width, height = b["east"] - b["west"], b["north"] - b["south"]
    size = F.greatest(width, height)
    cx, cy, half = (b["west"] + b["east"]) / 2, (b["south"] + b["north"]) / 2, size / 2
    square = box_polygon(cx - half, cy - half, cx + half, cy + half)
    polygon = F.coalesce(F.col(geom)["gtype"].isin("Polygon", "MultiPolygon"), F.lit(False))
    notes = F.create_map(
        F.lit("_squarified"), F.lit("true"),
        F.lit("_original_width"), width.cast("string"),
        F.lit("_original_height"), height.cast("string"),
        F.lit("_square_size"), size.cast("string"),
    )
    p = props_or_empty(F.col(props))
    return df.withColumns(
        {geom: F.when(polygon, square).otherwise(F.col(geom)), props: F.when(polygon, map_merge(p, notes)).otherwise(p)}
    )


def fit_frame(bbox: str, frame_width: float, frame_height: float):
    """BBox grown around its centre to the aspect ratio of a frame."""
    b = F.col(bbox)
    aspect = frame_width / frame_height
    width, height = b["east"] - b["west"], b["north"] - b["south"]
    grow_x = F.when(width / height < aspect, (height * aspect - width) / 2).otherwise(F.lit(0.0))
    grow_y = F.when(width / height < aspect, F.lit(0.0)).otherwise((width / aspect - height) / 2)
    return F.struct(
        (b["west"] - grow_x).alias("west"),
        (b["south"] - grow_y).alias("south"),
        (b["east"] + grow_x).alias("east"),
        (b["north"] + grow_y).alias("north"),
    )


def extent(df: DataFrame, geom: str = "geom", keys: list[str] | None = None) -> DataFrame:
    """BBox of a layer, or of each group."""
    b = F.col(geom)["bbox"]
    return df.groupBy(*(keys or [])).agg(
        F.min(b["west"]).alias("west"), F.min(b["south"]).alias("south"), F.max(b["east"]).alias("east"), F.max(b["north"]).alias("north")
    )


def overview_extent(df: DataFrame, scale: float = 1.8) -> DataFrame:
    """An extent row scaled around its centre and made square."""
    w, h = F.col("east") - F.col("west"), F.col("north") - F.col("south")
    cx, cy = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
    half = F.greatest(w, h) * scale / 2
    return df.withColumns({"west": cx - half, "south": cy - half, "east": cx + half, "north": cy + half})


def validate_boxes(df: DataFrame, max_degrees: float = 20.0) -> DataFrame:
    """Records with text ``north, south, east, west`` become polygons or get a ``reject_reason``."""
    n, s, e, w = (F.col(c).try_cast("double") for c in ("north", "south", "east", "west"))
    raw_missing = F.col("north").isNull() | F.col("south").isNull() | F.col("east").isNull() | F.col("west").isNull()
    bad = lambda v, low, high: ~v.between(low, high)
    reason = (
        F.when(raw_missing, "missing")
        .when(n.isNull() | s.isNull() | e.isNull() | w.isNull(), "not a number")
        .when(bad(s, -90.0, 90.0) | bad(n, -90.0, 90.0), "latitude range")
        .when(bad(w, -180.0, 180.0) | bad(e, -180.0, 180.0), "longitude range")
        .when(s >= n, "latitude order")
        .when(w >= e, "longitude order")
        .when(((e - w) > max_degrees) | ((n - s) > max_degrees), "too big")
    )
    out = df.withColumn("reject_reason", reason)
    return out.withColumn("geom", F.when(F.col("reject_reason").isNull(), box_polygon(w, s, e, n)))


def polygon_parts(df: DataFrame, geom: str = "geom") -> DataFrame:
    """One row per part of a multi geometry, numbered by ``part_id`` from 0."""
    starts = F.expr(f"filter(sequence(0, size({geom}.rings) - 1), i -> NOT {geom}.rings[i].hole)")
    part = df.withColumn("__starts", starts).withColumn("__at", F.explode(F.expr(
        "transform(__starts, (s, i) -> named_struct('id', i, 'lo', s, 'hi', coalesce(get(__starts, i + 1), "
        f"size({geom}.rings))))"
    )))
    rings = F.expr(f"slice({geom}.rings, __at.lo + 1, __at.hi - __at.lo)")
    kind = F.regexp_replace(F.col(geom)["gtype"], "^Multi", "")
    return part.withColumns({"part_id": F.col("__at.id"), geom: from_rings(kind, rings)}).drop("__starts", "__at")
