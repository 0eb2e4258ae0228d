"""Document and raster files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def document_parts(path: Column) -> Column:
    """``struct<name,file_type>``: file stem, and suffix with its dot."""
    base = F.element_at(F.split(path, "/"), -1)
    dot = base.rlike(r"^.+\.[^.]*$")
    return F.struct(
        F.when(dot, F.regexp_extract(base, r"^(.+)\.[^.]*$", 1)).otherwise(base).alias("name"),
        F.when(dot, F.regexp_extract(base, r"(\.[^.]*)$", 1)).otherwise(F.lit("")).alias("file_type"),
    )


def read_documents(spark: SparkSession, path: str, bbox: dict) -> DataFrame:
    """One metadata row per file of a folder (folders in it are skipped); the bytes are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return document_rows(files, bbox)


def document_rows(files: DataFrame, bbox: dict, path: str = "path") -> DataFrame:
    parts = document_parts(F.col(path))
    corners = F.struct(*[F.lit(float(bbox[k])).alias(k) for k in ("north", "south", "east", "west")])
    return files.select(
        parts["name"].alias("name"), parts["file_type"].alias("file_type"), corners.alias("corners"), F.col(path).alias("image_path")
    )


def read_pixels(spark: SparkSession, path: str, tile: str | None = None) -> DataFrame:
    """Pixel table ``row, col, value``."""
    df = spark.read.parquet(path)
    return df.filter(F.col("tile_id") == tile) if tile is not None else df
