"""World data, map-database nodes, vector files, sheets and coordinate lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from landstrata.functions.crs import reproject
from landstrata.functions.geometry import (
    bbox_inside,
    box_polygon,
    envelope,
    from_wkb,
    parse_geojson,
    point,
    to_geojson,
)
from landstrata.functions.props import props_from_columns
from landstrata.functions.text import degree_minutes
from landstrata.model import feature_key


#: GeoJSON files longer than this are read by several tasks.
SPLIT_BYTES = 128 << 20


def _with_id(df: DataFrame) -> DataFrame:
    name = F.try_element_at(F.col("properties"), F.lit("name"))
    return df.withColumn("feature_id", feature_key(name, F.coalesce(to_geojson("geom"), F.lit("")))).select(
        "feature_id", "geom", "properties"
    )


def world_rows(spark: SparkSession, path: str, bbox: dict, where: Column | str | None = None) -> DataFrame:
    """Parquet rows whose ``bbox.{xmin,xmax,ymin,ymax}`` lies strictly inside a box.

    The comparisons are on plain columns, so they prune row groups; directory keys become columns and prune folders;
    ``filename`` tells the file of each row.
    """
    df = spark.read.parquet(path)
    return world_filter(df.select("*", F.col("_metadata.file_path").alias("filename")), bbox, where)


def world_filter(df: DataFrame, bbox: dict, where: Column | str | None = None) -> DataFrame:
    b = F.col("bbox")
    inside = (
        (b["xmin"] > bbox["west"]) & (b["xmax"] < bbox["east"]) & (b["ymin"] > bbox["south"]) & (b["ymax"] < bbox["north"])
    )
    df = df.filter(inside)
    return df if where is None else df.filter(where)


def world_features(
    spark: SparkSession,
    path: str,
    bbox: dict,
    where: Column | str | None = None,
    geometry: str = "wkb",
    columns: dict[str, str] | None = None,
    expand: float = 0.0,
) -> DataFrame:
    """Features of world data: the shape from its WKB, or the envelope of its bbox; all other columns as properties.

    ``columns`` adds properties from expressions such as ``names.primary``.
    """
    return world_shapes(world_rows(spark, path, bbox, where), geometry, columns, expand)


def world_shapes(rows: DataFrame, geometry: str = "wkb", columns: dict[str, str] | None = None, expand: float = 0.0) -> DataFrame:
    """Features from rows of world data; see :func:`world_features`."""
    for name, expression in (columns or {}).items():
        rows = rows.withColumn(name, F.expr(expression))
    if geometry == "wkb":
        shaped = rows.withColumn("geom", from_wkb(F.col("geometry")))
    elif geometry == "envelope":
        box = F.struct(*[F.col("bbox")[a].alias(c) for a, c in (("xmin", "west"), ("ymin", "south"), ("xmax", "east"), ("ymax", "north"))])
        shaped = rows.withColumn("__b", box).withColumn("geom", envelope("__b", expand)).drop("__b")
    else:
        raise ValueError(f"unknown geometry {geometry!r}")
    plain = [c for c, t in rows.dtypes if not t.startswith(("struct", "array", "map", "binary"))]
    nested = [c for c, t in rows.dtypes if t.startswith(("struct", "array", "map")) and c != "bbox"]
    texts = {c: F.to_json(F.col(c)) for c in nested}
    return _with_id(shaped.withColumns(texts).withColumn("properties", props_from_columns(plain + nested)))


def map_nodes(df: DataFrame, tag: str, bbox: dict, add_labels: bool = False) -> DataFrame:
    """Nodes (``id, lon, lat, tags``) that have a tag and lie in a box, borders counted."""
    inside = F.col("lon").between(bbox["west"], bbox["east"]) & F.col("lat").between(bbox["south"], bbox["north"])
    rows = df.filter(inside & F.map_contains_key(F.col("tags"), tag))
    props = F.col("tags")
    if add_labels:
        from landstrata.functions.props import map_merge

        props = map_merge(F.create_map(F.lit("label"), F.coalesce(F.try_element_at(props, F.lit("name")), F.col("id").cast("string"))), props)
    return _with_id(rows.select(point(F.col("lon"), F.col("lat")).alias("geom"), props.alias("properties")))


def vector_file(
    spark: SparkSession,
    path: str,
    file_format: str | None = None,
    layer: str | None = None,
    bbox: dict | None = None,
    source_crs: str = "EPSG:4326",
    target_crs: str = "EPSG:4326",
) -> DataFrame:
    """Features of a GeoJSON, Parquet or CSV file; ``layer`` picks a layer of a many-layer table.

    ``bbox`` (in the source system) keeps features whose bbox overlaps it; an inlet without a geometry setting gives
    none.
    """
    from landstrata.sources.geojson import read_collection
    from landstrata.sources.geojson_split import read_split_collection

    kind = file_format or path.rsplit(".", 1)[-1].lower()
    if kind in ("geojson", "json"):
        # A file of many blocks is read by as many tasks; its length is metadata.
        longest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
        read = read_split_collection if longest > SPLIT_BYTES else read_collection
        rows = read(spark, path).select("feature_id", "geom", "properties")
    elif kind == "parquet":
        rows = spark.read.parquet(path)
        if layer is not None:
            rows = rows.filter(F.col("layer") == layer)
    elif kind == "csv":
        rows = read_sheet(spark, path)
    else:
        raise ValueError(f"no reader for {kind!r}")
    rows = rows.filter(F.col("geom").isNotNull())
    if bbox is not None:
        b = F.col("geom.bbox")
        rows = rows.filter(
            (b["west"] <= bbox["east"]) & (b["east"] >= bbox["west"]) & (b["south"] <= bbox["north"]) & (b["north"] >= bbox["south"])
        )
    return rows.withColumn("geom", reproject("geom", source_crs, target_crs)).select("feature_id", "geom", "properties")


def clip_scan(df: DataFrame, bbox: dict, box: str = "geom.bbox") -> DataFrame:
    """Features strictly inside a box."""
    return df.filter(bbox_inside(box, bbox["west"], bbox["south"], bbox["east"], bbox["north"]))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Sheet with a header row; ``geometry`` holds GeoJSON text and every other column is a property."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return sheet_features(rows)


def sheet_features(rows: DataFrame) -> DataFrame:
    others = [c for c in rows.columns if c != "geometry"]
    shaped = rows.select(parse_geojson("geometry").alias("geom"), props_from_columns(others).alias("properties"))
    return _with_id(shaped)


def read_coordinate_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``lat lon [name]`` in degree-minute text; longitudes are written without their minus sign."""
    return coordinate_features(spark.read.text(path))


def coordinate_features(lines: DataFrame, text: str = "value") -> DataFrame:
    words = F.split(F.btrim(F.col(text), F.lit(" \t\r\n\f\v")), r"\s+", 3)
    rows = lines.select(words.alias("w")).filter(F.col("w")[0] != "")
    lat, lon = degree_minutes(F.col("w")[0]), -degree_minutes(F.get("w", F.lit(1)))
    name = F.get("w", F.lit(2))
    empty = F.expr("cast(map() as map<string,string>)")
    props = F.when(name.isNotNull(), F.create_map(F.lit("name"), name)).otherwise(empty)
    return _with_id(rows.select(point(lon, lat).alias("geom"), props.alias("properties")))
