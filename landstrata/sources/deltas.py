"""The delta inbox: files named ``{asset}__{yyyyMMdd_HHmmss}__{action}.geojson`` in one folder per layer, and the
append-only delta log they end up in."""

from __future__ import annotations

from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from landstrata.operators.layers import check_actions, delta_name_parts
from landstrata.sources.geojson import COLLECTION, features_of

COLUMNS = ["layer", "asset", "ts", "action", "file", "pos", "feature_id", "geom", "properties", "falsy_keys"]
BROKEN = "__broken"
#: Beside the features of a batch: for a file that cannot be applied, why and where it is.
REJECT = "struct<reason:string,path:string,arrived:timestamp>"


def _named(raw: DataFrame, layer: str | None) -> DataFrame:
    raw = raw.withColumns({"__arrived": F.col("_metadata.file_modification_time"), "file": F.col("_metadata.file_name"), "__path": F.col("_metadata.file_path")})
    parts = delta_name_parts(F.col("file"))
    # An upload carries its layer and action in the payload; a delta file in its folder and name.
    folder = F.element_at(F.split(F.col("__path"), "/"), -2)
    return raw.withColumns(
        {
            "layer": F.lit(layer) if layer else F.coalesce(F.col("layer"), folder),
            "asset": parts["asset"],
            # An upload may have no time in its name: then it is the time it arrived.
            "ts": F.coalesce(parts["ts"], F.col("__arrived")),
            "action": F.coalesce(parts["action"], F.col("action")),
        }
    )


def _parse(raw: DataFrame, layer: str | None) -> DataFrame:
    return features_of(_named(raw, layer), ["layer", "asset", "ts", "action", "file"]).select(COLUMNS)


def _parse_or_reject(raw: DataFrame, layer: str | None) -> DataFrame:
    """Features of whole files, and one row with ``reject`` for each other file: what is not whole JSON, or has no features."""
    reason = F.when(F.col(BROKEN).isNotNull(), F.lit("not whole JSON")).when(F.col("features").isNull(), F.lit("no feature collection"))
    named = _named(raw, layer).withColumn("reject", F.when(reason.isNotNull(), F.struct(reason.alias("reason"), F.col("__path").alias("path"), F.col("__arrived").alias("arrived"))))
    # Half a file gives no feature: it is whole or rejected.
    one = F.expr("cast(array(null) as array<struct<type:string,id:string,geometry:struct<type:string,coordinates:string>,properties:string,neighbors:map<string,string>>>)")
    held = named.withColumn("features", F.when(F.col("reject").isNotNull(), one).otherwise(F.col("features")))
    return features_of(held, ["layer", "asset", "ts", "action", "file", "reject"]).select(*COLUMNS, "reject")


def _whole_or_broken(reader):
    """JSON files read whole; one that does not parse gives a row with its text in ``BROKEN``."""
    return reader.schema(f"{COLLECTION}, {BROKEN} string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN)


def read_inbox(spark: SparkSession, path: str, layer: str | None = None, broken: str = "fail") -> DataFrame:
    """Features of all delta files; an unknown action fails the read.

    A file that is not whole JSON fails it too, or is left out with ``broken='skip'``, as in the stream; see :func:`read_rejects`.
    """
    if broken == "fail":
        return check_actions(_parse(spark.read.schema(COLLECTION).option("multiLine", True).option("mode", "FAILFAST").json(path), layer))
    if broken != "skip":
        raise ValueError(f"unknown treatment of broken files {broken!r}")
    return check_actions(_parse_or_reject(_whole_or_broken(spark.read).json(path), layer).where("reject is null").drop("reject"))


def rejects_of(features: DataFrame) -> DataFrame:
    return features.where("reject is not null").select("file", "reject.path", "layer", "reject.arrived", "reject.reason")


def read_rejects(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """Delta files that cannot be applied: ``file, path, layer, arrived, reason``."""
    return rejects_of(_parse_or_reject(_whole_or_broken(spark.read).json(path), layer))


def stream_inbox(
    spark: SparkSession, path: str, archive: str | None = None, layer: str | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """The inbox as a stream; with ``archive`` consumed files are moved there. A file that cannot be read is one row with ``reject``."""
    reader = _whole_or_broken(spark.readStream)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _parse_or_reject(reader.json(path), layer)


def delta_file_name(asset: str, action: str, at: datetime | None = None) -> str:
    at = at or datetime.now(timezone.utc)
    return f"{asset}__{at.strftime('%Y%m%d_%H%M%S')}__{action}"


def append_to_log(
    features: DataFrame, log: str, layer: str, action: str, asset: str = "assetless", at: datetime | None = None, position: str | None = None
) -> str:
    """Append a batch of features to the delta log; returns the batch name.

    The log is partitioned by layer, so a refresh reads just its layer. Batch names are unique, also within a second.
    Positions are row ids where no column gives them: unique, not dense. Given ones must be unique; nulls get ids
    below zero.
    """
    at = at or datetime.now(timezone.utc)
    name = f"{delta_file_name(asset, action, at)}__{uuid4().hex[:12]}"
    pos = F.monotonically_increasing_id()
    if position:
        pos = F.coalesce(F.col(position).cast("bigint"), -1 - pos)
    batch = features.select(
        F.lit(layer).alias("layer"),
        F.lit(asset).alias("asset"),
        F.lit(at.replace(microsecond=0)).cast("timestamp").alias("ts"),
        F.lit(action).alias("action"),
        F.lit(name).alias("file"),
        pos.alias("pos"),
        "feature_id",
        "geom",
        "properties",
        F.col("falsy_keys") if "falsy_keys" in features.columns else F.expr("cast(array() as array<string>)").alias("falsy_keys"),
    )
    check_actions(batch).write.mode("append").partitionBy("layer").parquet(log)
    return name


def read_log(spark: SparkSession, log: str, layer: str) -> DataFrame:
    return spark.read.parquet(log).filter(F.col("layer") == layer).select(COLUMNS)
