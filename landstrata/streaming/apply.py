"""Incremental layer refresh from the delta inbox with Structured Streaming.

A batch writes what it adds and nothing else: created features as rows, and for its annotations and deletes one mark for each
row and key they write. Marks carry the time of their change and the latest one holds, so batches may come in any order: a
late delta ends in the same layer as one in time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from landstrata.operators.layers import NAMES, apply_deltas, bag_union, change_marks, check_actions
from landstrata.sources.deltas import read_inbox, rejects_of, stream_inbox
from landstrata.sources.store import REJECTS, CommitConflict, LayerStore, is_done

#: A layer is compacted when it has more segments than this, or more marks than this share of its rows.
SEGMENTS, SHARE = 64, 0.25
_TRIES = 5
_EVER = -(1 << 62)


class LateDelta(Exception):
    """A delta is older than what a layer has applied, and the caller asked for that to be an error."""


def apply_batch(
    store: LayerStore, batch: DataFrame, batch_id: int | None = None, query: str | None = None, late: str = "error", segments: int = SEGMENTS, share: float = SHARE
) -> dict[str, str]:
    """Apply one micro-batch to every layer it names; returns what was done to each.

    What is written is in proportion to the batch: rows for creates, marks for the rows that annotations and deletes meet.
    A batch id that the same ``query`` repeats is skipped, which makes a retried batch harmless. A delta that is older than
    what a layer has applied is an error, or with ``late='merge'`` takes its place in time: its marks give way to later ones,
    and late creates get the marks of the later changes in the layer's log. Files that could not be read go to the
    store's rejects.
    """
    if late not in ("error", "merge"):
        raise ValueError(f"unknown treatment of late deltas {late!r}")
    batch = batch.persist()  # read by the summary and by each layer; lost blocks are read again from the files
    try:
        if "reject" in batch.columns:
            rejects = rejects_of(batch)
            if not rejects.isEmpty():
                store.write(REJECTS, rejects, "append", batch_id, query=query)
            batch = batch.where("reject is null").drop("reject")
        create = F.col("action") == "create"
        micros = F.coalesce(F.unix_micros("ts"), F.lit(_EVER))  # without a time: before all others
        box = lambda f, side: f(F.when(~create, F.col(f"geom.bbox.{side}"))).alias(side)
        summary = (
            check_actions(batch)
            .groupBy("layer")
            .agg(
                F.count_if(create).alias("creates"), F.count_if(~create).alias("changes"), F.count_if(F.col("action") == "delete").alias("deletes"), F.min(micros).alias("first"),
                F.min(F.when(create, micros)).alias("first_create"),
                box(F.min, "west"), box(F.min, "south"), box(F.max, "east"), box(F.max, "north"),
            )
            .collect()  # one row per layer of the batch
        )
        return {row["layer"]: _apply(store, batch.filter(F.col("layer") == row["layer"]), row, batch_id, query, late, segments, share) for row in summary}
    finally:
        batch.unpersist()


def _apply(store: LayerStore, part: DataFrame, row, batch_id: int | None, query: str | None, late: str, segments: int, share: float) -> str:
    layer = row["layer"]
    for _ in range(_TRIES):
        state = store.state(layer)
        if batch_id is not None and is_done(state, batch_id, query):
            return "skip"
        if late == "error" and state["max_ts"] is not None and row["first"] < state["max_ts"]:
            raise LateDelta(f"{layer}: a delta is older than what the layer has applied")
        covered = store.segments(state, "covered")
        mine = part
        if covered:  # a rebuild took some files in already
            known = store.spark.read.parquet(*covered).select("file", "ts").distinct()
            mine = part.join(known, ["file", "ts"], "left_anti")
        try:
            state = store.commit(layer, state, "append", _segments(store, state, mine, row), batch_id, query)
        except CommitConflict:
            continue  # what another writer committed may concern these deltas
        count = lambda *kinds: sum(s["rows"] for s in state["segments"] if s["kind"] in kinds)  # noqa: B023, E731
        if sum(s["kind"] in ("rows", "marked", "marks") for s in state["segments"]) > segments or count("marks") > max(1000, share * count("rows", "marked")):
            store.compact(layer)
        return "changes" if row["changes"] else "append"
    raise CommitConflict(f"{layer}: no commit in {_TRIES} tries")


def _segments(store: LayerStore, state: dict, part: DataFrame, row) -> list[dict]:
    """The segments that a batch adds to a layer."""
    layer, out, marks = row["layer"], [], []
    created = part.where("action = 'create'").select(NAMES)
    if row["creates"]:
        out.append(store.add_segment(layer, created))
        log = store.segments(state, "log")
        if log and row["first_create"] <= (state["max_change_ts"] or _EVER):
            # Late rows meet the changes that are later than the first of them.
            later = store.spark.read.parquet(*log).where(F.unix_micros("ts") >= row["first_create"])
            marks.append(change_marks(created, later))
    if row["changes"]:
        changes = part.where("action <> 'create'")
        old = store.created(state)
        rows = old.unionByName(created) if row["creates"] else old
        # The box of all changes goes to the scan; rows outside of it can only be met by their id.
        b, near = F.col("geom.bbox"), rows.limit(0)
        if row["west"] is not None:
            near = rows.where((b["west"] <= row["east"]) & (b["east"] >= row["west"]) & (b["south"] <= row["north"]) & (b["north"] >= row["south"]))
        marks.append(change_marks(rows, changes, near=near, by_id=row["deletes"] > 0))
        out.append(store.add_segment(layer, changes.select(*NAMES, "action", "falsy_keys") if "falsy_keys" in part.columns else changes.select(*NAMES, "action"), "log"))
    if marks:
        found = store.add_segment(layer, bag_union(*marks), "marks")
        # A batch whose changes meet nothing adds no segment of marks.
        out.extend([found] if found["rows"] else [])
    return out


def start_refresh(
    spark: SparkSession,
    inbox: str,
    store: LayerStore,
    checkpoint: str,
    archive: str | None = None,
    processing_time: str | None = None,
    files_per_trigger: int | None = None,
    layer: str | None = None,
):
    """Start the refresh: all pending files once, or with ``processing_time`` at that interval after uploads.

    Late deltas take their place in time; files that cannot be read are listed in ``store.rejects()`` and do not stop it.
    """
    stream = stream_inbox(spark, inbox, archive, layer, files_per_trigger)

    def batch(df: DataFrame, batch_id: int) -> None:
        # The id stays with the checkpoint folder: a new folder is a new query, whose batches count from 0 again.
        apply_batch(store, df, batch_id, df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), late="merge")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    if processing_time:
        return writer.trigger(processingTime=processing_time).start()
    return writer.trigger(availableNow=True).start()


def rebuild(spark: SparkSession, store: LayerStore, layer: str, *paths: str) -> None:
    """Replay all deltas of a layer and commit the result with the names of the files it covers: a stream that meets one of
    them later, or again, skips it."""
    deltas = _all_deltas(spark, layer, *paths)
    rows, changes = deltas.where("action = 'create'").select(NAMES), deltas.where("action <> 'create'")
    new = [
        store.add_segment(layer, rows),
        store.add_segment(layer, change_marks(rows, changes), "marks"),
        store.add_segment(layer, changes.select(*NAMES, "action", "falsy_keys"), "log"),
        store.add_segment(layer, deltas.select("file", "ts").distinct(), "covered"),
    ]
    for _ in range(_TRIES):
        try:
            store.commit(layer, store.state(layer), "replace", new, name="rebuild")
            return
        except CommitConflict:
            continue
    raise CommitConflict(f"{layer}: no commit in {_TRIES} tries")


def _all_deltas(spark: SparkSession, layer: str, *paths: str) -> DataFrame:
    parts = [read_inbox(spark, path, layer, broken="skip") for path in paths]
    return parts[0] if len(parts) == 1 else bag_union(*parts)


def replay(spark: SparkSession, store: LayerStore, layer: str, *paths: str) -> DataFrame:
    """The layer from all its deltas, archived and pending, without files that cannot be read; equals the incremental result."""
    return apply_deltas(None, _all_deltas(spark, layer, *paths))
