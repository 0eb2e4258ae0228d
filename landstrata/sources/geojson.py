"""GeoJSON scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from landstrata.functions.geometry import from_geojson, once, to_geojson
from landstrata.functions.props import props_or_empty
from landstrata.model import feature_key

COLLECTION = (
    "type string, name string, layer string, action string, "
    "features array<struct<type:string,id:string,geometry:struct<type:string,coordinates:string>,properties:string,"
    "neighbors:map<string,string>>>"
)
_TYPED = "map<string,variant>"


def features_of(collections: DataFrame, keep: list[str] | None = None, features: str = "features") -> DataFrame:
    """One row per feature of parsed collections, with its position ``pos`` in the collection."""
    names = keep or []
    rows = collections.select(*names, F.posexplode(F.col(features)).alias("pos", "f"))
    return feature_rows(rows, names)


def feature_rows(rows: DataFrame, names: list[str]) -> DataFrame:
    """Feature columns from a parsed feature struct ``f`` beside ``pos``.

    Property numbers become text as they are written. ``falsy_keys`` names the properties whose JSON value was a zero
    or ``false``, which text alone would not tell from ``"0"``.
    """
    text = F.col("f.properties")
    props = props_or_empty(F.from_json(text, "map<string,string>"))
    parsed = rows.select(
        *names,
        F.col("pos").cast("bigint").alias("pos"),
        F.to_json(F.col("f.geometry")).alias("__raw"),
        once(from_geojson("f.geometry.type", "f.geometry.coordinates")).alias("geom"),
        props.alias("properties"),
        falsy_keys(text).alias("falsy_keys"),
        F.col("f.neighbors").alias("neighbors"),
    )
    # The same geometry gives the same id from any source, however its file wrote the numbers.
    shape = F.coalesce(to_geojson("geom"), F.col("__raw"), F.lit(""))
    key = feature_key(F.try_element_at(F.col("properties"), F.lit("name")), shape)
    return parsed.select(*names, "pos", key.alias("feature_id"), "geom", "properties", "falsy_keys", "neighbors")


def falsy_keys(properties_text: str | Column) -> Column:
    """Keys whose JSON value is the number zero or ``false``."""
    text = F.col(properties_text) if isinstance(properties_text, str) else properties_text
    typed = F.from_json(text, _TYPED)
    zero = lambda v: (
        F.schema_of_variant(v).isin("BOOLEAN") & ~F.coalesce(F.try_variant_get(v, "$", "boolean"), F.lit(True))
    ) | (
        ~F.schema_of_variant(v).isin("BOOLEAN", "STRING")
        & (F.coalesce(F.try_variant_get(v, "$", "double"), F.lit(1.0)) == 0)
    )
    return F.map_keys(F.map_filter(typed, lambda k, v: F.coalesce(zero(v), F.lit(False))))


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON collection files; one that is not whole JSON fails the read."""
    return features_of(spark.read.schema(COLLECTION).option("multiLine", True).option("mode", "FAILFAST").json(path))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of newline-delimited GeoJSON, which is split over tasks within a file.

    ``pos`` is not known in such files and is null.
    """
    schema = "type string, id string, geometry struct<type:string,coordinates:string>, properties string, neighbors map<string,string>"
    rows = spark.read.schema(schema).json(path)
    f = F.struct(*[F.col(c) for c in ("type", "id", "geometry", "properties", "neighbors")])
    return feature_rows(rows.select(f.alias("f"), F.lit(None).cast("bigint").alias("pos")), [])
