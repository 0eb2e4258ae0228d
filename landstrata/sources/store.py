"""Layer tables on shared storage.

A layer is a list of written segments, named by its latest commit: one small JSON file ``commits/{layer}/{number}.json`` that
holds the whole list, so a reader needs one file and always sees one state. The file of a number is created by one writer
only; another that wanted the same number starts again from the new state. A version is such a list for several layers,
``versions/{name}.json``: publishing copies no data, and is there whole or not at all. Segments are never written over
and never removed here, so versions stay readable.

Segments are of these kinds: ``rows`` (features as created, or any table), ``marked`` (rows with a column ``marks``),
``marks`` (what changes wrote on rows, merged on read), ``log`` (the changes themselves, for rows that come late),
``covered`` (names of delta files that a rebuild took in).
"""

from __future__ import annotations

import json
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from landstrata.functions.props import column_names
from landstrata.model import LAYER
from landstrata.operators.layers import GONE, NAMES, marked_properties, with_marks
from landstrata.sources import files

#: A system layer of the store, not among its layers.
REJECTS = "_rejects"
_TRIES = 20


class CommitConflict(Exception):
    """Another writer has committed since the state that a commit builds on."""


def empty_state() -> dict:
    return {"seq": -1, "segments": [], "keys": [], "last": {}, "max_ts": None, "max_change_ts": None, "entry": None}


def moment(micros: int | None) -> datetime | None:
    return None if micros is None else datetime.fromtimestamp(micros / 1e6, timezone.utc).replace(tzinfo=None)


class LayerStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- commits ---------------------------------------------------------------------------------------------
    def _numbers(self, layer: str) -> list[int]:
        names = files.children(self.spark, f"{self.root}/commits/{layer}", folders=False)
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read_commit(self, layer: str, number: int) -> dict:
        return json.loads(files.read_text(self.spark, f"{self.root}/commits/{layer}/{number:012d}.json"))

    def state(self, layer: str) -> dict:
        """The latest commit: the layer's segments, property keys, the last batch of each query, times in microseconds."""
        numbers = self._numbers(layer)
        return self._read_commit(layer, numbers[-1]) if numbers else empty_state()

    def _commits(self, layer: str) -> list[dict]:
        """What each commit did, oldest first."""
        return [self._read_commit(layer, n)["entry"] for n in self._numbers(layer)]

    def commit(self, layer: str, base: dict, mode: str, segments: list[dict], batch: int | None = None, query: str | None = None, name: str | None = None) -> dict:
        """The state after ``base`` with ``segments`` added (``append``) or in place of all (``replace``); raises :class:`CommitConflict`."""
        if mode not in ("append", "replace"):
            raise ValueError(f"unknown mode {mode!r}")
        kept = base["segments"] if mode == "append" else []
        latest = lambda times: max((t for t in times if t is not None), default=None)
        state = {
            "seq": base["seq"] + 1,
            "segments": [*kept, *segments],
            "keys": sorted({*(base["keys"] if mode == "append" else []), *(k for s in segments for k in s.get("keys", []))}),
            # A stream's batches come in order, so its last one tells which are done.
            "last": {**base["last"], **({_query(query): batch} if batch is not None else {})},
            "max_ts": latest([base["max_ts"], *(s["max_ts"] for s in segments)]),
            "max_change_ts": latest([base["max_change_ts"], *(s["max_ts"] for s in segments if s["kind"] == "log")]),
            "entry": {"mode": name or mode, "batch": batch, "query": query, "rows": sum(s["rows"] for s in segments), "segments": [s["path"] for s in segments]},
        }
        if not files.create(self.spark, f"{self.root}/commits/{layer}/{state['seq']:012d}.json", json.dumps(state)):
            raise CommitConflict(f"{layer}: commit {state['seq']} is another writer's")
        return state

    def has_batch(self, layer: str, batch: int, query: str | None = None) -> bool:
        return is_done(self.state(layer), batch, query)

    def add_segment(self, layer: str, df: DataFrame, kind: str = "rows") -> dict:
        """Write a segment that no commit names yet. Its row count and latest time are observed while it is written; its
        property keys are read from the key column alone."""
        path = f"{self.root}/layers/{layer}/{uuid4().hex}"
        seen = Observation()
        has_ts = dict(df.dtypes).get("ts") == "timestamp"
        ts = F.max(F.unix_micros("ts")) if has_ts else F.lit(None).cast("bigint")
        df.observe(seen, F.count(F.lit(1)).alias("n"), ts.alias("t") if has_ts else F.max(F.lit(None).cast("bigint")).alias("t")).write.mode("errorifexists").parquet(path)
        got = seen.get
        out = {"path": path, "kind": kind, "rows": got["n"], "max_ts": got["t"]}
        keys = None
        if got["n"] and kind == "marks":
            keys = F.col("key")
        elif got["n"] and kind in ("rows", "marked") and dict(df.dtypes).get("properties") == "map<string,string>":
            keys = F.explode(F.map_keys("properties"))
            if kind == "marked":
                keys = F.explode(F.array_union(F.coalesce(F.map_keys("properties"), F.array()), F.map_keys("marks")))
        if keys is not None:
            # The distinct keys of a layer are the few column names of its exports.
            found = self.spark.read.parquet(path).select(keys.alias("k")).distinct().collect()
            out["keys"] = sorted(r["k"] for r in found if r["k"] != GONE)
        return out

    def write(
        self, layer: str, df: DataFrame, mode: str = "replace", batch: int | None = None, applied: DataFrame | None = None, query: str | None = None
    ) -> bool:
        """Write rows and commit them. A ``batch`` that the same ``query`` committed before is skipped (returns False).

        Batch numbers start anew in every stream, so a stream gives its own id as ``query``.

        ``applied`` are the deltas behind the rows; their latest time counts too, since annotations and deletes
        leave no row of their own. If another writer commits meanwhile, the commit is made on top of its.
        """
        if mode not in ("replace", "append"):
            raise ValueError(f"unknown mode {mode!r}")
        if batch is not None and self.has_batch(layer, batch, query):
            return False
        segment = self.add_segment(layer, df)
        if applied is not None:
            last = applied.agg(F.max(F.unix_micros("ts"))).first()[0]
            segment["max_ts"] = max((t for t in (last, segment["max_ts"]) if t is not None), default=None)
        for _ in range(_TRIES):
            base = self.state(layer)
            if batch is not None and is_done(base, batch, query):
                return False
            try:
                self.commit(layer, base, mode, [segment], batch, query)
                return True
            except CommitConflict:
                continue
        raise CommitConflict(f"{layer}: no commit in {_TRIES} tries")

    # -- reading ---------------------------------------------------------------------------------------------
    def segments(self, state: dict, *kinds: str) -> list[str]:
        return [s["path"] for s in state["segments"] if s["kind"] in kinds]

    def created(self, state: dict) -> DataFrame:
        """The rows of a layer as they were created, before any change is merged in."""
        paths = self.segments(state, "rows", "marked")
        return self.spark.read.schema(LAYER).parquet(*paths) if paths else self.spark.createDataFrame([], LAYER)

    def read_state(self, state: dict) -> DataFrame:
        """A layer in a state, its changes merged into the rows they belong to."""
        plain, marked, marks = (self.segments(state, k) for k in ("rows", "marked", "marks"))
        if not plain and not marked:
            return self.spark.createDataFrame([], LAYER)
        if not marked and not marks:
            return self.spark.read.parquet(*plain)
        return self.merged(state).withColumn("properties", marked_properties()).select(NAMES)

    def merged(self, state: dict) -> DataFrame:
        """Rows with the column ``marks``; deleted rows are gone."""
        plain, marked, marks = (self.segments(state, k) for k in ("rows", "marked", "marks"))
        parts = [self.spark.read.parquet(*p).select(*NAMES, *extra) for p, extra in ((plain, []), (marked, ["marks"])) if p]
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        written = self.spark.read.parquet(*marks) if marks else self.spark.createDataFrame([], "row string, key string, value string, at struct<ts:timestamp,file:string,pos:bigint>")
        return with_marks(rows, written.select("row", "key", "value", "at"))

    def read(self, layer: str) -> DataFrame:
        """The layer now; empty when it was never written."""
        return self.read_state(self.state(layer))

    def compact(self, layer: str) -> bool:
        """Rows and marks as one segment; False if another writer came between. What late changes need stays: rows keep
        their own properties beside the marks with their times, and the log of changes is kept."""
        base = self.state(layer)
        if not self.segments(base, "marks", "marked") and len(self.segments(base, "rows")) < 2:
            return False
        whole = self.merged(base) if self.segments(base, "marks", "marked") else self.read_state(base)
        new = self.add_segment(layer, whole, "marked" if "marks" in whole.columns else "rows")
        log = self.segments(base, "log")
        kept = [s for s in base["segments"] if s["kind"] == "covered"]
        if log:
            kept.append(self.add_segment(layer, self.spark.read.parquet(*log), "log"))
        try:
            self.commit(layer, base, "replace", [new, *kept], name="compact")
            return True
        except CommitConflict:
            return False

    def max_ts(self, layer: str) -> datetime | None:
        """Latest delta time applied, over all commits."""
        return moment(self.state(layer)["max_ts"])

    def keys(self, layer: str) -> list[str]:
        """All property keys of a layer, kept with its commits."""
        return self.state(layer)["keys"]

    def layers(self) -> list[str]:
        return sorted(n for n in files.children(self.spark, f"{self.root}/commits") if n != REJECTS)

    def rejects(self) -> DataFrame:
        """Delta files that could not be read: ``file, path, layer, arrived, reason``."""
        return self.read(REJECTS)

    def clear(self, layer: str) -> None:
        """Make a layer empty, its columns kept."""
        self.write(layer, self.read(layer).limit(0))

    # -- versions --------------------------------------------------------------------------------------------
    def versions(self) -> list[str]:
        return sorted(n[:-5] for n in files.children(self.spark, f"{self.root}/versions", folders=False) if n.endswith(".json") and not n.startswith("."))

    def publish(self, version: str, layers: list[str] | None = None) -> list[str]:
        """Name the present state of layers. A version that is there already is an error, also for the later of two writers."""
        have = self.layers()
        names = layers or have
        unknown = sorted(set(names) - set(have))
        if unknown:
            raise ValueError(f"no such layers: {', '.join(unknown)}")
        if not files.create(self.spark, f"{self.root}/versions/{version}.json", json.dumps({n: self.state(n) for n in names})):
            raise ValueError(f"version {version} already exists")
        return names

    def read_version(self, layer: str, version: str | None = None, back: int = 0) -> DataFrame:
        """A layer of a version: by name, or the latest or the one ``back`` steps before it."""
        have = self.versions()
        if version is None:
            if len(have) <= back:
                raise ValueError(f"{len(have)} version(s), need {back + 1}")
            version = have[-1 - back]
        if version not in have:
            raise ValueError(f"no such version: {version}")
        held = json.loads(files.read_text(self.spark, f"{self.root}/versions/{version}.json"))
        if layer not in held:
            raise ValueError(f"version {version} has no layer {layer}")
        return self.read_state(held[layer])


def _query(query: str | None) -> str:
    return query or ""


def is_done(state: dict, batch: int, query: str | None) -> bool:
    """Whether the query committed this batch, or one after it."""
    return batch <= state["last"].get(_query(query), -1)


# ---------------------------------------------------------------------------------------------------------------
# exports
# ---------------------------------------------------------------------------------------------------------------
def export_sheet(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One text column per property key in sorted order and ``geometry`` text; a missing value is ``''``.

    The keys are the distinct ones of the layer unless given, a small list that becomes the header.
    """
    from landstrata.functions.geometry import to_geojson

    if keys is None:
        rows = df.select(F.explode(F.map_keys("properties")).alias("k")).distinct().collect()
        keys = [r["k"] for r in rows]
    value = lambda k: F.coalesce(F.try_element_at(F.col("properties"), F.lit(k)), F.lit(""))
    named = column_names(sorted(keys), {"geometry"})
    return df.select(*[value(k).alias(n) for k, n in named.items()], to_geojson("geom").alias("geometry"))


def write_sheet(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Sheet export as CSV with a header, quoted as spreadsheets do; the sheet reader takes it back."""
    export_sheet(df, keys).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def feature_text(df: DataFrame) -> DataFrame:
    """One GeoJSON feature per row in ``value``."""
    from landstrata.functions.geometry import to_geojson

    return df.select(
        F.concat(
            F.lit('{"type":"Feature","geometry":'),
            F.coalesce(to_geojson("geom"), F.lit("null")),
            F.lit(',"properties":'),
            F.coalesce(F.to_json("properties", {"ignoreNullFields": "false"}), F.lit("{}")),
            F.lit("}"),
        ).alias("value")
    )


def write_features(df: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON features."""
    feature_text(df).write.mode("errorifexists").text(path)


def write_result(df: DataFrame, path: str, return_format: str = "csv", header: bool = False) -> None:
    """A query result as CSV or JSON lines; other formats are an error."""
    if return_format == "csv":
        df.write.mode("errorifexists").option("header", header).csv(path)
    elif return_format == "json":
        df.write.mode("errorifexists").json(path)
    else:
        raise ValueError(f"unknown format {return_format!r}")


def result_text(df: DataFrame, return_format: str = "json") -> DataFrame:
    """Result rows as text, one per row."""
    if return_format == "json":
        return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    if return_format == "csv":
        return df.select(F.to_csv(F.struct("*")).alias("value"))
    raise ValueError(f"unknown format {return_format!r}")


def write_sidecars(documents: DataFrame, path: str) -> None:
    documents.write.mode("errorifexists").json(path)


