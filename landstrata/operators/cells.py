"""Hexagon covers of layers and grid distances between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from landstrata.functions import hexgrid
from landstrata.functions.geometry import _segments
from landstrata.functions.props import map_merge, props_or_empty
from landstrata.model import LINEAR, POLYGONAL
from landstrata.operators.skew import attach_group_values, row_hash
from landstrata.session import cut_lineage

FANOUT = 8  # cells per axis of a block of the search pyramid
SMALL = 100_000  # rows of a pyramid level that may be broadcast


def cover(df: DataFrame, geom: str = "geom", start: int = 11, max_cells: int = 10, kind: str = "polygon") -> DataFrame:
    """Add ``res``, ``cell_count``, ``cells`` and ``representative`` to polygon or line features.

    A polygon takes the finest resolution from ``start`` down with at most ``max_cells`` cells (none at all leaves
    ``res`` null and no cells); a line takes ``start`` as it is. All work is per row, no shuffle.
    """
    if kind == "polygon":
        shaped = df.filter(F.col(geom)["gtype"].isin(*POLYGONAL)).withColumn("__m", hexgrid.metric_shape(geom))
        out = shaped.withColumn("res", hexgrid.cover_resolution("__m", start, max_cells))
        out = out.withColumn("cells", hexgrid.cover_cells("__m", "res")).drop("__m")
    elif kind == "linestring":
        lines = df.filter(F.col(geom)["gtype"].isin(*LINEAR))
        out = lines.withColumns({"res": F.lit(start), "cells": hexgrid.line_cells(geom, start)})
    else:
        raise ValueError(f"unsupported geometry type {kind!r}; only 'polygon' and 'linestring' are")
    return out.withColumns(
        {"cell_count": F.size("cells").cast("bigint"), "representative": F.array_min("cells")}
    )


def each_cell(covered: DataFrame, name: str = "c") -> DataFrame:
    """One row per cell of a cover.

    A plain ``explode`` would make Spark test the array in a filter below it and so build every cover again.
    """
    return covered.withColumn(name, F.explode_outer("cells")).filter(F.col(name).isNotNull())


def line_cover(df: DataFrame, keys: list[str], geom: str = "geom", res: int = 8) -> DataFrame:
    """``(*keys, res, q, r)``: the cells on the grid path of each line, once for each set of ``keys``.

    Every segment is a row with its own path, so no array grows with a line; only lines of several segments need their
    cells made distinct. Without keys the cells of the whole layer come out, each once.
    """
    g = F.col(geom)
    named = [F.col(f"`{k}`") for k in keys]
    lines = df.where(g["gtype"].isin(*LINEAR))
    several = (F.size(g["rings"]) > 1) | (F.size(g["rings"][0]["pts"]) > 2)
    paths = hexgrid.segment_paths(lines.select(*named, several.alias("__several"), F.explode(F.expr(_segments(f"{geom}.rings"))).alias("__s")), "__s", res)
    cells = paths.select(*named, F.lit(res).alias("res"), "q", "r", "__several")
    if not keys:
        return cells.drop("__several").distinct()
    # The path of one segment never comes back to a cell.
    return cells.where("__several").drop("__several").distinct().union(cells.where("not __several").drop("__several"))


def cell_features(df: DataFrame, source_id: str, geom: str = "geom", props: str = "properties", **options) -> DataFrame:
    """One hexagon feature per covered cell, with the source's properties and the cell's own."""
    covered = each_cell(cover(df, geom, **options), "__c")
    q, r, res = F.col("__c.q"), F.col("__c.r"), F.col("res")
    index = hexgrid.index_name(res, q, r)
    notes = F.create_map(
        F.lit("h3_index"), index,
        F.lit("h3_resolution"), res.cast("string"),
        F.lit("h3_cell_count"), F.col("cell_count").cast("string"),
        F.lit("source_feature_id"), F.col(source_id).cast("string"),
    )
    return covered.select(
        F.col(source_id).alias("source_feature_id"),
        index.alias("h3_index"),
        res.alias("h3_resolution"),
        F.col("cell_count").alias("h3_cell_count"),
        q.alias("q"),
        r.alias("r"),
        map_merge(props_or_empty(F.col(props)), notes).alias("properties"),
        hexgrid.boundary(q, r, res).alias("geom"),
    )


def cell_points(df: DataFrame, lon: str, lat: str, res: int) -> DataFrame:
    """Add ``res, q, r`` of the cell each point lies in."""
    return df.withColumn("__c", hexgrid.cell(F.col(lon), F.col(lat), res)).select(
        *df.columns, F.lit(res).alias("res"), F.col("__c.q").alias("q"), F.col("__c.r").alias("r")
    )


def _levels(**frames: DataFrame) -> dict[str, list[int]]:
    """Resolutions present in each frame, in one job; there are sixteen at most."""
    tagged = [df.select(F.lit(name).alias("side"), "res") for name, df in frames.items()]
    rows = tagged[0].unionByName(tagged[1]).distinct().collect()
    return {name: sorted(r["res"] for r in rows if r["side"] == name) for name in frames}


def nearest_cell_distance(source: DataFrame, target: DataFrame, name: str = "distance") -> DataFrame:
    """Distinct source cells (``res, q, r``) with the least number of grid steps to any target cell.

    Both cells of a pair are taken to the finer of their resolutions. The search goes down a pyramid of blocks over
    the target cells: a source cell keeps only blocks that may hold something nearer than the nearest it has seen, so
    it is never compared with all targets.
    """
    # Both cell sets are read many times below; they are small beside what they come from and are written once.
    src = cut_lineage(source.select(F.col("res").cast("int").alias("res"), "q", "r").distinct())
    tgt = cut_lineage(target.select(F.col("res").cast("int").alias("res"), "q", "r").distinct())
    present = _levels(source=src, target=tgt)
    s_levels, t_levels = present["source"], present["target"]
    if not t_levels or not s_levels:
        return src.withColumn(name, F.lit(None).cast("bigint"))
    # A source meets targets of its own or a coarser resolution on its own grid ("own"), finer ones on theirs.
    views, targets = [], []
    for rs in s_levels:
        if any(rt <= rs for rt in t_levels):
            views.append((rs, f"own{rs}", rs))
            targets.append((f"own{rs}", rs, [rt for rt in t_levels if rt <= rs]))
        views += [(rs, f"fine{rt}", rt) for rt in t_levels if rt > rs]
    targets += [(f"fine{rt}", rt, [rt]) for rt in t_levels if any(rs < rt for rs in s_levels)]

    def at(res_from: int, res_to: int):
        if res_from == res_to:
            return F.struct(F.col("q").alias("q"), F.col("r").alias("r"))
        return hexgrid.recenter(F.col("q"), F.col("r"), F.lit(res_from), F.lit(res_to))

    seen = None
    for rs, group, res in views:
        part = src.filter(F.col("res") == rs).select(
            "res", "q", "r", F.lit(group).alias("g"), at(rs, res).alias("p")
        )
        seen = part if seen is None else seen.unionByName(part)
    base = None
    for group, res, froms in targets:
        for rt in froms:
            part = tgt.filter(F.col("res") == rt).select(F.lit(group).alias("g"), at(rt, res).alias("p"))
            base = part if base is None else base.unionByName(part)
    base = cut_lineage(base.select("g", F.col("p.q").alias("q"), F.col("p.r").alias("r")).distinct())
    reach = base.agg(
        F.max("q").alias("q1"), F.min("q").alias("q0"), F.max("r").alias("r1"), F.min("r").alias("r0"), F.count(F.lit(1)).alias("n")
    ).collect()[0]
    width = max(reach["q1"] - reach["q0"], reach["r1"] - reach["r0"]) + 1
    depth = 1
    while FANOUT**depth < width:
        depth += 1
    groups = len(targets)

    def bound(level: int) -> int:
        """Most blocks a level can have."""
        per_axis = width // FANOUT**level + 2
        return min(reach["n"], groups * per_axis * per_axis)

    # The pyramid upwards: the blocks of a level, with the span of each axis and one cell of theirs, from those of the level
    # below, so the targets are read once.
    pyramid, below = None, base.selectExpr("g", "q AS cq", "r AS cr", "q AS qa", "q AS qb", "r AS ra", "r AS rb", "q + r AS sa", "q + r AS sb", "named_struct('q', q, 'r', r) AS rep")
    for level in range(1, depth + 1):
        below = (
            below.withColumns({"cq": F.floor(F.col("cq") / F.lit(float(FANOUT))), "cr": F.floor(F.col("cr") / F.lit(float(FANOUT)))})
            .groupBy("g", "cq", "cr")
            .agg(*[F.expr(f"{f}({c}) AS {c}") for f, c in (("min", "qa"), ("max", "qb"), ("min", "ra"), ("max", "rb"), ("min", "sa"), ("max", "sb"), ("min", "rep"))])
        )
        one = below.withColumn("level", F.lit(level))
        pyramid = one if pyramid is None else pyramid.unionByName(one)
    pyramid = cut_lineage(pyramid)

    def blocks_of(level: int) -> DataFrame:
        """Blocks of a level and their parent block."""
        return pyramid.where(F.col("level") == level).selectExpr("*", f"floor(cq / {FANOUT}D) AS bq", f"floor(cr / {FANOUT}D) AS br").drop("level")

    def steps(q: str, r: str) -> str:
        return f"greatest(abs(pq - {q}), abs(pr - {r}), abs(pq + pr - {q} - {r}))"

    lower = "greatest(qa - pq, pq - qb, ra - pr, pr - rb, sa - pq - pr, pq + pr - sb, 0)"
    me = ["res", "q", "r"]
    # Few bytes and much work a row: dealt over as many tasks as a shuffle has, which the windows below keep.
    tasks = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frontier = seen.selectExpr(*me, "g", "p.q AS pq", "p.r AS pr").repartition(tasks, *me)
    for level in range(depth, 0, -1):
        blocks = blocks_of(level)
        keys = ["g", "bq", "br"]
        if level == depth:
            keys, blocks = ["g"], blocks.drop("bq", "br")  # a handful of top blocks in each group
        if bound(level) <= SMALL:
            blocks = F.broadcast(blocks)
        frontier = (
            frontier.join(blocks, keys)
            .selectExpr(*me, "g", "pq", "pr", "cq", "cr", f"{lower} AS lb", f"{steps('rep.q', 'rep.r')} AS ub")
            .selectExpr("*", "min(ub) OVER (PARTITION BY res, q, r) AS best")
            .filter("lb <= best")
            .selectExpr(*me, "g", "pq", "pr", "cq AS bq", "cr AS br")
        )
    leaves = base.selectExpr("g", "q AS tq", "r AS tr", f"floor(q / {FANOUT}D) AS bq", f"floor(r / {FANOUT}D) AS br")
    if reach["n"] <= SMALL:
        leaves = F.broadcast(leaves)
    return (
        frontier.join(leaves, ["g", "bq", "br"])
        .groupBy(*me)
        .agg(F.expr(f"cast(min({steps('tq', 'tr')}) AS bigint)").alias(name))
    )


def add_cell_distance(df: DataFrame, target: DataFrame, name: str) -> DataFrame:
    """Rows with ``res, q, r`` and the grid distance of their cell to the target cells."""
    near = nearest_cell_distance(df, target, name)
    # Many rows may share a cell; there is one distance row per cell, copied to the salts that spread those rows.
    near = near.withColumn("res", F.col("res").cast(df.schema["res"].dataType))
    return attach_group_values(df, near, ["res", "q", "r"], row_hash(df), how="left")
