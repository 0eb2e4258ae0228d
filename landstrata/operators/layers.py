"""Layers as the result of their deltas, and set operations on features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from landstrata.functions.props import map_merge, props_or_empty, truthy_only
from landstrata.operators.skew import SALTS, first_per_group, join_null_safe, number_rows
from landstrata.operators.annotate import latest_at_places
from landstrata.operators.spatial_join import meeting_places, place_key, with_place

# Delta actions.
ACTIONS = ("create", "annotate", "delete")
GONE = "\0gone"  # stands for a delete among the keys an annotation writes


def delta_name_parts(file_name: Column) -> Column:
    """``struct<asset,ts,action>`` from ``{asset}__{yyyyMMdd_HHmmss}__{action}.{type}``."""
    stem = F.regexp_replace(F.element_at(F.split(file_name, "/"), -1), r"\.[^.]*$", "")
    parts = F.split(stem, "__")
    return F.struct(
        F.get(parts, F.lit(0)).alias("asset"),
        F.try_to_timestamp(F.get(parts, F.lit(1)), F.lit("yyyyMMdd_HHmmss")).alias("ts"),
        F.get(parts, F.lit(2)).alias("action"),
    )


def check_actions(deltas: DataFrame, action: str = "action") -> DataFrame:
    """Fail on an action that is not known, when the rows are read."""
    known = F.when(F.col(action).isin(*ACTIONS), True).otherwise(
        F.raise_error(F.concat(F.lit("unknown delta action: "), F.coalesce(F.col(action), F.lit("null")))).cast("boolean")
    )
    return deltas.filter(known)


NAMES = ["feature_id", "geom", "properties", "ts", "file", "pos"]
AT = "struct<ts:timestamp,file:string,pos:bigint>"
MARKS = f"map<string,struct<value:string,at:{AT}>>"


def change_marks(rows: DataFrame, changes: DataFrame, feature_id: str = "feature_id", near: DataFrame | None = None, by_id: bool = True, **join_options) -> DataFrame:
    """What annotations and deletes write on rows that are older than they: ``(row, key, value, at)``, one for each row and key.

    An *annotate* writes its truthy values on features that it meets; a *delete* writes the key ``GONE`` on features that
    it meets or that have its id. Of all changes that write a key the latest stays, so the marks of several sets of changes
    can be put together in any order: the latest ``at`` of a row and key holds. ``row`` is a row's ``file`` and ``pos``.
    ``near`` may name the rows that changes can meet, where the caller can read fewer than all ``rows``; without ``by_id``
    (no delete among the changes) ``rows`` are not read at all.
    """
    falsy = F.col("falsy_keys") if "falsy_keys" in changes.columns else None
    over = truthy_only(props_or_empty(F.col("properties")), falsy)
    changes = changes.select(F.col(feature_id).alias("id"), "geom", over.alias("over"), "ts", "file", "pos", "action")
    when = F.struct("ts", "file", "pos")
    written = F.when(F.col("action") == "delete", F.create_map(F.lit(GONE), F.lit(""))).otherwise(F.col("over"))
    # Rows at one place meet the same changes, and the latest of a key is the one that is later than a row, if any is.
    entries = changes.select(place_key("geom").alias("__rp"), when.alias("__by"), F.explode(written).alias("__key", "__value"))
    slim = rows if near is None else near
    best = latest_at_places(meeting_places(slim, changes, **join_options), entries)
    slim = with_place(slim.select(row_key().alias("row"), "geom", "ts", "file"), "geom").drop("geom")
    at = F.col("__by").alias("at")
    marks = slim.hint("merge").join(best, "__lp").filter(F.struct("__by.ts", "__by.file") > F.struct("ts", "file"))
    marks = marks.select("row", F.col("__key").alias("key"), F.col("__value").alias("value"), at)
    if not by_id:
        return latest_marks(marks)
    # One delete of an id is enough, the latest: ids may repeat on both sides.
    later = F.struct("anno_ts", "anno_file") > F.struct("ts", "file")
    named = changes.filter(F.col("action") == "delete").groupBy(F.col("id").alias("anno_id")).agg(F.max(when).alias("__at"))
    named = named.select("anno_id", *[F.col(f"__at.{c}").alias("anno_" + c) for c in ("ts", "file", "pos")])
    at = F.struct(F.col("anno_ts").alias("ts"), F.col("anno_file").alias("file"), F.col("anno_pos").alias("pos")).alias("at")
    met = rows.select(feature_id, row_key().alias("row"), "ts", "file").hint("merge").join(named, F.col(feature_id) == F.col("anno_id")).filter(later)
    return latest_marks(marks.unionByName(met.select("row", F.lit(GONE).alias("key"), F.lit("").alias("value"), at)))


def row_key() -> Column:
    """``file`` and ``pos`` name a created row, since ids may repeat."""
    return F.concat_ws("#", "file", F.col("pos").cast("string"))


def latest_marks(marks: DataFrame) -> DataFrame:
    """One mark of each row and key; one leaves each task, so a feature with very many annotations stays small."""
    return marks.groupBy("row", "key").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))


def with_marks(rows: DataFrame, marks: DataFrame, single: bool = False) -> DataFrame:
    """Rows with their ``marks`` as a map beside those they had, the later of each key; deleted rows go.

    ``single`` marks are one of each row and key already.
    """
    one = F.struct(F.col("key"), F.struct("value", "at").alias("mark"))
    effect = (marks if single else latest_marks(marks)).groupBy("row").agg(F.map_from_entries(F.collect_list(one)).alias("__new"))
    rows = rows.withColumn("__row", row_key())
    joined = rows.join(effect.withColumnRenamed("row", "__row").hint("merge"), "__row", "left").drop("__row")
    none = F.expr(f"cast(map() as {MARKS})")
    new = F.coalesce(F.col("__new"), none)
    if "marks" in rows.columns:
        newer = lambda k, a, b: F.when(a.isNull() | (b["at"] > a["at"]), F.coalesce(b, a)).otherwise(a)
        new = F.map_zip_with(F.coalesce("marks", none), new, newer)
    return joined.withColumn("marks", new).drop("__new").filter(~F.map_contains_key("marks", F.lit(GONE)))


def marked_properties() -> Column:
    """``properties`` with the values of ``marks`` on top; null properties stay null on rows without a mark."""
    values = F.transform_values("marks", lambda k, m: m["value"])
    return F.when(F.size("marks") > 0, map_merge(props_or_empty(F.col("properties")), values)).otherwise(F.col("properties"))


def apply_deltas(layer: DataFrame | None, deltas: DataFrame, feature_id: str = "feature_id", **join_options) -> DataFrame:
    """A layer (``feature_id, geom, properties, ts, file, pos``) after a set of deltas, in time order.

    All deltas go through one plan, whatever their number: a *create* adds its features; an *annotate* writes its
    truthy values on features that are older and that it meets, the latest value of each key winning; a *delete*
    takes away older features that it meets or that have its id. Start from ``None`` to rebuild a layer from all its
    deltas.
    """
    names = [feature_id, *NAMES[1:]]
    deltas = check_actions(deltas)
    rows = deltas.filter(F.col("action") == "create").select(names)
    if layer is not None:
        rows = layer.select(names).unionByName(rows)
    marks = change_marks(rows, deltas.filter(F.col("action") != "create"), feature_id, **join_options)
    return with_marks(rows, marks, single=True).withColumn("properties", marked_properties()).select(names)


def bag_union(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, nothing removed."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def upsert(layer: DataFrame, sheet: DataFrame, mode: str = "upsert", feature_id: str = "feature_id") -> DataFrame:
    """Re-import of an edited sheet: changed rows replace theirs and new ones are added (``upsert``; rows the sheet
    lacks stay), or the layer becomes the sheet (``replace``)."""
    if mode == "replace":
        return sheet
    if mode == "upsert":
        return layer.join(sheet.select(feature_id).distinct(), feature_id, "left_anti").unionByName(sheet)
    raise ValueError(f"unknown mode {mode!r}")


def remove_features(layer: DataFrame, deletions: DataFrame, feature_id: str = "feature_id") -> DataFrame:
    return layer.join(deletions.select(feature_id).distinct(), feature_id, "left_anti")


def deduplicate(df: DataFrame, position: str, keys: list[str] | None = None) -> DataFrame:
    """Keep the first record (by ``position``) of each set of equal ones, by ``keys`` or by the whole record."""
    if keys:
        return first_per_group(df, keys, [position])
    rest = [c for c in df.columns if c != position]
    return df.groupBy(*rest).agg(F.min(position).alias(position)).select(df.columns)


def gather(sources: dict[str, DataFrame]) -> DataFrame:
    """Union of several sources with their name in ``source``."""
    return bag_union(*[df.withColumn("source", F.lit(name)) for name, df in sources.items()])


def latest_batch(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Rows of the latest batch of each key: a newer raster delta replaces the older one."""
    newest = df.groupBy(*keys).agg(F.max(ts).alias("__newest"))
    return join_null_safe(df, newest, keys, salts=SALTS).filter(F.col(ts) == F.col("__newest")).drop("__newest")


def in_time_order(deltas: DataFrame, name: str = "n") -> DataFrame:
    """Deltas with their number in the order in which they hold: by time, then by file."""
    return number_rows(deltas, "ts", ties=["file"], name=name)


def choose_version(versions: DataFrame, back: int = 0, name: str = "version") -> DataFrame:
    """The latest version, or the one ``back`` steps before it; ``staging`` does not count."""
    ranked = versions.select(name).filter(F.col(name) != "staging").distinct().orderBy(F.desc(name))
    return ranked.offset(back).limit(1)
