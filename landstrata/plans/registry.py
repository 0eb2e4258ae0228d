"""Named asset functions: configuration names to ``(spark, config, inputs) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from landstrata.functions.geometry import centroid, point
from landstrata.operators import cells, raster, regions
from landstrata.operators.alter import add_links, alter
from landstrata.operators.alter import filter_properties
from landstrata.operators.annotate import annotate
from landstrata.operators.layers import apply_deltas
from landstrata.plans import sql
from landstrata.sources import documents, vector
from landstrata.sources.store import export_sheet

AssetFunction = Callable[[SparkSession, dict, dict[str, DataFrame]], DataFrame]

ASSETS: dict[str, AssetFunction] = {}
# Names that configurations use for the same functions.
ALIASES = {
    "overture_duckdb": "world_features",
    "fetch_osm": "map_nodes",
    "local_ogr": "vector_file",
    "import_sheet": "sheet",
    "local_raster": "raster",
    "fetch_url": "raster",
    "url_raster": "raster",
    "hillshade": "derived_hillshade",
    "contours": "gdal_contours",
}


def asset(name: str):
    def add(f: AssetFunction) -> AssetFunction:
        ASSETS[name] = f
        return f

    return add


def materialize(spark: SparkSession, config: dict, name: str, inputs: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run an asset of a configuration by its name."""
    spec = config["assets"][name]
    settings = {**spec.get("config", {}), **{k: v for k, v in spec.items() if k != "config"}}
    # The area of interest stands at the top of a configuration or in one of its sections.
    sections = [config, *(v for v in config.values() if isinstance(v, dict))]
    settings.setdefault("bbox", next((v["bbox"] for v in sections if "bbox" in v), None))
    kind = settings.get("fetch_type") or settings.get("type")
    function = ASSETS.get(ALIASES.get(kind, kind))
    if function is None:
        raise ValueError(f"asset {name}: no function {kind!r}")
    out = function(spark, settings, inputs or {})
    if "properties" in out.columns:
        if settings.get("alterations"):
            out = alter(out, settings["alterations"], strict=False)  # configurations carry parts with no meaning
        if settings.get("filter"):
            # A filter on the asset itself counts as well.
            out = filter_properties(out, settings["filter"])
    return out


@asset("world_features")
def _world(spark, s, inputs):
    return vector.world_features(
        spark, s["path"], s["bbox"], s.get("where"), s.get("geometry_from", "wkb"), s.get("columns"), s.get("expand", 0.0)
    )


@asset("map_nodes")
def _nodes(spark, s, inputs):
    return vector.map_nodes(spark.read.parquet(s["path"]), s.get("tag", "natural"), s["bbox"], s.get("add_labels", False))


@asset("vector_file")
def _file(spark, s, inputs):
    box = s["bbox"] if "geometry" in s else None
    return vector.vector_file(spark, s["path"], s.get("format"), s.get("layer"), box, s.get("source_crs", "EPSG:4326"), s.get("crs", "EPSG:4326"))


@asset("sheet")
def _sheet(spark, s, inputs):
    return vector.read_sheet(spark, s["path"])


@asset("coordinate_list")
def _list(spark, s, inputs):
    return vector.read_coordinate_list(spark, s["path"])


@asset("raster")
def _raster(spark, s, inputs):
    pixels = documents.read_pixels(spark, s["path"])
    if s.get("resample_width") and s.get("source"):
        return raster.resample(pixels, s["source"], s["bbox"], s["resample_width"], s.get("source_crs", "EPSG:4326"), s.get("crs", "EPSG:4326"))
    return pixels


@asset("documents")
def _documents(spark, s, inputs):
    return documents.read_documents(spark, s["path"], s["bbox"])


@asset("derived_hillshade")
def _hillshade(spark, s, inputs):
    return raster.hillshade_rgb(inputs[s["in_layer"]], s.get("intensity", 1.0))


@asset("gdal_contours")
def _contours(spark, s, inputs):
    """Whole contour lines, or with ``segments`` the segments they are made of."""
    return (raster.contour_layer if s.get("segments") else raster.contour_line_layer)(inputs[s["in_layer"]], s["interval"])


@asset("raster_extract")
def _region_raster(spark, s, inputs):
    """The pixels of a raster layer in each region of another."""
    return raster.region_pixels(inputs[s["in_layer"]], s["source"], inputs[s["regions"]], s.get("region_name", "name"))


@asset("annotate")
def _annotate(spark, s, inputs):
    """A layer with the properties of another one's features that it meets."""
    options = {k: s[k] for k in ("multi", "updated", "order", "match", "property_match") if k in s}
    return annotate(inputs[s["in_layer"]], inputs[s["annotations"]], **options)


@asset("centroid")
def _centroid(spark, s, inputs):
    """Features as the points of their centroids."""
    at = inputs[s["in_layer"]].withColumn("__c", centroid("geom"))
    return at.withColumn("geom", point(F.col("__c.x"), F.col("__c.y"))).drop("__c")


@asset("sql")
def _sql(spark, s, inputs):
    """A read-only query over the inputs as views."""
    sql.register_layers(inputs, only=s.get("layers"))
    return sql.run_query(spark, s["query"], sql.bbox_args(s["bbox"]) if s.get("bbox") and ":west" in s["query"] else None)


@asset("h3_cells")
def _cells(spark, s, inputs):
    return cells.cell_features(
        inputs[s["in_layer"]], s.get("source_id", "feature_id"), start=s.get("starting_resolution", 11),
        max_cells=s.get("max_cells", 10), kind=s.get("geometry_type", "polygon").lower(),
    )


@asset("gazetteer")
def _grid(spark, s, inputs):
    return regions.map_grid(spark, s["bbox"], s["num_cols"])


@asset("runbook")
def _regions(spark, s, inputs):
    return regions.load_regions(inputs[s["in_layer"]], start_at=s.get("start_at", 0), limit=s.get("limit", 0))


@asset("gsheet_export")
def _export(spark, s, inputs):
    return export_sheet(inputs[s["in_layer"]])


def refresh_layer(deltas: DataFrame, base_url: str = "", layer: DataFrame | None = None, builder=apply_deltas, zoom: int = 17) -> DataFrame:
    """A layer from its deltas with links added; ``builder`` may be any ``(layer, deltas) -> DataFrame``."""
    return add_links(builder(layer, deltas), base_url, zoom)


def geometry_type(df: DataFrame, *kinds: str, geom: str = "geom") -> DataFrame:
    return df.filter(F.col(geom)["gtype"].isin(*kinds))


def with_geometry(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Features that have a usable geometry."""
    from landstrata.functions.geometry import is_valid

    return df.filter(is_valid(geom))


def named(df: DataFrame, names: list[str], column: str = "name") -> DataFrame:
    """Rows with one of the names; no match at all is an error."""
    out = df.filter(F.col(column).isin(names))
    if out.isEmpty():
        raise ValueError(f"nothing is named {names}")
    return out
