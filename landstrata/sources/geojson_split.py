"""One GeoJSON FeatureCollection read by many tasks.

The text reader cuts a file into blocks of bytes and each block into records that end with ``}``. What a block's text means
depends on what stands before it, so it is read twice. First every block is summed up for both cases, that it starts
inside a text or outside: how the nesting changes, how far it comes down, and where a ``"features"`` list opens. From the
sums, one small row a block, follows the state in which each block starts. Then every block cuts out its features, the
objects at depth three of that list; features that reach over blocks are put together from their parts.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from landstrata.session import checkpoint_dir
from landstrata.sources.geojson import feature_rows

_OPENS = re.compile(rb'"features"\s*:\s*\[')
_FEATURE = "type string, id string, geometry struct<type:string,coordinates:string>, properties string, neighbors map<string,string>"
_SUMS = "file string, block long, size long, bytes long, start_inside boolean, end_inside boolean, change long, least long, opened array<struct<depth:long,least_after:long>>"
_STATES = "file string, block long, inside boolean, depth long, mode string, cut boolean"
_PARTS = "file string, block long, i long, kind int, text string"
_WHOLE, _HEAD, _TAIL, _MIDDLE = range(4)


def _structure(data: bytes, inside: bool):
    """Places of the braces and brackets outside of texts, their steps (1 or -1) and the sum of steps up to each; the places
    of quotes; and whether the data ends inside a text."""
    import numpy as np

    b = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(b == 34)
    if b"\\" in data:
        escaped = []
        for q in quotes[(quotes > 0) & (b[np.maximum(quotes - 1, 0)] == 92)].tolist():
            n = q
            while n > 0 and data[n - 1] == 92:
                n -= 1
            if (q - n) % 2:
                escaped.append(q)
        quotes = np.setdiff1d(quotes, escaped, assume_unique=True)
    marks = np.flatnonzero((b == 123) | (b == 125) | (b == 91) | (b == 93))
    marks = marks[(np.searchsorted(quotes, marks) + inside) % 2 == 0]
    steps = np.where((b[marks] == 123) | (b[marks] == 91), 1, -1)
    return b, marks, steps, np.cumsum(steps), quotes, (len(quotes) + inside) % 2 == 1


def _openings(data: bytes, marks, depth, quotes, inside: bool):
    """``(depth before it, index of its bracket)`` of each place where a member ``"features"`` opens a list, outside of texts."""
    import numpy as np

    for m in _OPENS.finditer(data):
        q = np.searchsorted(quotes, m.start())
        if q < len(quotes) and quotes[q] == m.start() and (q + inside) % 2 == 0:
            at = int(np.searchsorted(marks, m.end() - 1))
            yield (int(depth[at - 1]) if at else 0), at


def _chunks(batches, columns: list[str]):
    """``(values of columns, data)`` for each batch and block in turn; the closing brace of each record is put back."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        table = pa.Table.from_batches([batch])
        while table.num_rows:
            file, block = table["file"][0], table["block"][0]
            same = pc.and_(pc.equal(table["file"], file), pc.equal(table["block"], block)).to_pylist()
            n = same.index(False) if False in same else len(same)
            part, table = table.slice(0, n), table.slice(n)
            yield tuple(part[c][0].as_py() for c in columns), b"}".join([*part["value"].cast(pa.binary()).to_pylist(), b""])


def _sum_up(batches):
    """Two rows a block, one for each case of its start."""
    import pyarrow as pa

    names = [f.split()[0] for f in _SUMS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.struct([("depth", pa.int64()), ("least_after", pa.int64())]))]
    at, cases, length = None, [], 0

    def out():
        rows = [
            (*at, length, bool(start), c["inside"], c["depth"], c["least"], [{"depth": d, "least_after": a} for d, a in c["opened"].items() if d <= c["least"] + 1])
            for start, c in enumerate(cases)
        ]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    for key, data in _chunks(batches, ["file", "block", "size"]):
        if key != at:
            if at:
                yield out()
            at, length = key, 0
            cases = [{"inside": bool(s), "depth": 0, "least": 0, "opened": {}} for s in (0, 1)]
        length += len(data)
        for c in cases:
            _, marks, _, depth, quotes, ends = _structure(data, c["inside"])
            depth = depth + c["depth"]
            lowest = int(depth.min()) if len(depth) else c["depth"]
            c["opened"] = {d: min(a, lowest) for d, a in c["opened"].items()}
            for before, i in _openings(data, marks, depth - c["depth"], quotes, c["inside"]):
                if before + c["depth"] <= min(c["least"], lowest) + 1:  # else it is no member of the whole
                    c["opened"].setdefault(before + c["depth"], int(depth[i:].min()))
            c["least"] = min(c["least"], lowest)
            c["depth"] = int(depth[-1]) if len(depth) else c["depth"]
            c["inside"] = ends
    if at:
        yield out()


def _follow(sums):
    """The state in which each block of one file starts; an error if the file is not whole."""
    import pandas as pd

    sums = sums.sort_values(["block", "start_inside"])
    file, size, total = sums["file"].iloc[0], sums["size"].iloc[0], sums["bytes"].sum() // 2
    inside, depth, mode, rows = False, 0, "before", []
    blocks = sorted(sums["block"].unique())
    for block in blocks:
        one = sums[(sums["block"] == block) & (sums["start_inside"] == inside)].iloc[0]
        # The last record has no closing brace of its own where the file does not end with one.
        rows.append((file, block, inside, depth, mode, bool(block == blocks[-1] and total > size)))
        if mode == "in" and depth + one["least"] < 2:
            mode = "after"
        elif mode == "before":
            for o in one["opened"]:
                if depth + o["depth"] == 1:
                    mode = "in" if depth + o["least_after"] >= 2 else "after"
        inside, depth = bool(one["end_inside"]), depth + int(one["change"])
    if inside or depth != (-1 if total > size else 0):
        raise ValueError(f"not whole JSON: {file}")
    return pd.DataFrame(rows, columns=[f.split()[0] for f in _STATES.split(", ")])


def _cut_out(batches):
    """The features of each block, and the parts of those that reach over its ends."""
    import numpy as np
    import pyarrow as pa

    names = [f.split()[0] for f in _PARTS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
    at, rows = None, []

    def end_of_block():
        """What is open goes over to the next block."""
        if held:
            rows.append((*at, n if begun else -1, _TAIL if begun else _MIDDLE, b"".join(held).decode()))

    for (file, block, in_text, level, how), data in _chunks(batches, ["file", "block", "inside", "depth", "mode"]):
        if (file, block) != at:
            if at:
                end_of_block()
            at, inside, now, mode, n = (file, block), in_text, level, how, 0
            # Inside a feature of an earlier block, or not; ``held`` are the parts of the open feature.
            held, begun, over = [], False, mode == "in" and now >= 3
        b, marks, steps, depth, quotes, inside_next = _structure(data, inside)
        depth = depth + now
        first, last = 0, len(marks)
        if mode == "before":
            opens = [i for before, i in _openings(data, marks, depth - now, quotes, inside) if before + now == 1]
            first, mode = (opens[0] + 1, "in") if opens else (last, mode)
        if mode == "in":
            closed = np.flatnonzero(depth[first:] < 2)
            if len(closed):
                last, mode = first + int(closed[0]), "after"
            span = slice(first, last)
            starts = marks[span][(steps[span] == 1) & (depth[span] == 3) & (b[marks[span]] == 123)].tolist()
            ends = marks[span][(steps[span] == -1) & (depth[span] == 2) & (b[marks[span]] == 125)].tolist()
            if (held or over) and ends:
                end = ends.pop(0) + 1
                text = b"".join([*held, data[:end]]).decode()
                rows.append((*at, n if begun else -1, _WHOLE if begun else _HEAD, text))
                n += begun
                held, begun, over = [], False, False
            elif held or over:
                held.append(data)
            for s, e in zip(starts, ends):
                rows.append((*at, n, _WHOLE, data[s:e + 1].decode()))
                n += 1
            if len(starts) > len(ends):
                held, begun = [data[starts[-1]:]], True
        inside, now = inside_next, int(depth[-1]) if len(depth) else now
        if len(rows) >= 5000:
            yield batch(rows)
            rows.clear()
    if at:
        end_of_block()
    yield batch(rows)


def read_split_collection(spark: SparkSession, path: str) -> DataFrame:
    """Features of large GeoJSON collection files, each read by as many tasks as it has blocks (``spark.sql.files.maxPartitionBytes``).

    The same rows as :func:`landstrata.sources.geojson.read_collection`; a file that is not whole JSON fails the read. The cut
    features are written once in the checkpoint folder. One row a block is broadcast, so use it for few large files.
    """
    records = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value"
    )
    sums = records.mapInArrow(_sum_up, _SUMS)
    states = sums.groupBy("file").applyInPandas(_follow, _STATES)
    scratch = f"{checkpoint_dir(spark).rstrip('/')}/geojson-{uuid.uuid4().hex}"
    states.write.parquet(f"{scratch}/states")
    states = spark.read.schema(_STATES).parquet(f"{scratch}/states")
    # A broadcast join leaves the records in their order.
    known = records.drop("size").join(F.broadcast(states), ["file", "block"])
    known.mapInArrow(_cut_out, _PARTS).write.parquet(f"{scratch}/parts")
    parts = spark.read.schema(_PARTS).parquet(f"{scratch}/parts")
    begun = parts.where(F.col("i") >= 0).groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = begun.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = parts.join(F.broadcast(offsets), ["file", "block"], "left").withColumn("pos", F.col("before") + F.col("i"))
    whole = placed.where(F.col("kind") == _WHOLE).select("pos", "text")
    # At most two parts a block: the end of an earlier feature, then the start of one that goes on.
    order = Window.partitionBy("file").orderBy("block", F.col("kind") == _TAIL)
    seams = placed.where(F.col("kind") != _WHOLE).withColumn("g", F.count_if(F.col("kind") == _TAIL).over(order))
    joined = seams.groupBy("file", "g").agg(
        F.max(F.when(F.col("kind") == _TAIL, F.col("pos"))).alias("pos"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", (F.col("kind") != _TAIL).alias("later"), "text"))), lambda x: x["text"]), "").alias("text"),
    )
    rows = whole.unionByName(joined.select("pos", "text"))
    return feature_rows(rows.select("pos", F.from_json("text", _FEATURE, {"mode": "FAILFAST"}).alias("f")), [])
