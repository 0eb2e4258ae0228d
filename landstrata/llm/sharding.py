"""Resharding by minimum-cost flow: new shard sizes with the fewest bytes moved.

A layout is a Parquet folder partitioned by ``shard``; its files are the blocks. A flow from the old shards' sizes to the
new capacities says how many bytes each old shard sends to each new one. Files that fall inside one such share
stay or move whole; only files at the border of two shares are split by row. Only moved and split files are rewritten.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from landstrata.llm.common import broadcast_if_small, cut_lineage, scratch


def _size() -> Column:
    return F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long") + 1


def write_layout(docs: DataFrame, shard: Column, path: str | None = None) -> tuple[str, StructType]:
    """Write whole rows as ``row`` under ``shard=<n>`` folders, each task for itself; gives the folder and its schema.

    Rows are kept in a struct, so that no column of theirs can clash with ``shard``.
    """
    path = path or scratch(docs.sparkSession, "shards")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), shard.cast("int").alias("shard"))
    rows.write.partitionBy("shard").parquet(path)
    return path, rows.schema


def min_cost_flow(sizes: dict[int, int], capacities: dict[int, int], cost) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard, at the least summed ``cost(old, new)``; capacities must hold all sizes.

    Successive shortest paths with potentials, over as many nodes as there are shards.
    """
    if sum(sizes.values()) > sum(capacities.values()):
        raise ValueError("the capacities are smaller than what is stored")
    olds, news = sorted(sizes), sorted(capacities)
    source, sink = ("s",), ("t",)
    room: dict[tuple, int] = {}
    price: dict[tuple, float] = {}
    out: dict[tuple, list] = {}

    def arc(u, v, r, c):
        room[u, v], room[v, u] = r, 0
        price[u, v], price[v, u] = c, -c
        out.setdefault(u, []).append(v)
        out.setdefault(v, []).append(u)

    for i in olds:
        arc(source, ("o", i), sizes[i], 0)
        for j in news:
            arc(("o", i), ("n", j), sizes[i], cost(i, j))
    for j in news:
        arc(("n", j), sink, capacities[j], 0)
    height = dict.fromkeys(out, 0)
    left = sum(sizes.values())
    while left:
        far, by, heap = {source: 0}, {}, [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for v in out[u]:
                e = d + price[u, v] + height[u] - height[v]
                if room[u, v] and e < far.get(v, float("inf")):
                    far[v], by[v] = e, u
                    heapq.heappush(heap, (e, v))
        top = far[sink]
        for v in height:
            height[v] += min(far.get(v, top), top)
        path, v = [], sink
        while v != source:
            path.append((by[v], v))
            v = by[v]
        push = min(left, *(room[e] for e in path))
        for u, v in path:
            room[u, v] -= push
            room[v, u] += push
        left -= push
    return {(i, j): room[("n", j), ("o", i)] for i in olds for j in news if room[("n", j), ("o", i)]}


def even_capacities(total: int, shards: int) -> dict[int, int]:
    return {j: total // shards + (j < total % shards) for j in range(shards)}


def _rows(spark: SparkSession, path: str, kind) -> DataFrame:
    return spark.read.schema(kind).parquet(path).select("row", "shard", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))


def reshard(spark: SparkSession, layout: tuple[str, StructType], capacities=None, shards: int = 16, cost=lambda i, j: int(i != j), path: str | None = None) -> DataFrame:
    """Bring a ``layout`` (folder, schema) to new ``capacities`` (bytes by shard; equal ones for ``shards`` if not given).

    Gives the rows of the new layout as read from its files: ``row, shard, slot``, slots gapless from 0 in each
    shard. A row's size is its text's UTF-8 bytes and one more; null texts have none. A row belongs to the share that holds
    its middle byte, so a shard is off by at most half a row for each share that it is made of; in a
    split file large rows come first, so that small ones lie at the borders. The old files stay as they are; those that are neither
    moved nor split are part of the new layout, the rest of it is written to ``path``. With capacities above the
    stored total, shards fill up as the flow says.
    """
    path = path or scratch(spark, "resharded")
    old, kind = layout
    rows = _rows(spark, old, kind)
    files = cut_lineage(rows.groupBy("shard", "file").agg(F.sum(_size()).alias("size"), F.count(F.lit(1)).alias("rows")))
    sizes = {r["shard"]: r["size"] for r in files.groupBy("shard").agg(F.sum("size").alias("size")).collect()}
    total = sum(sizes.values())
    flow = min_cost_flow(sizes, capacities or even_capacities(total, shards), cost)
    shares = []
    for i in sizes:
        a = 0
        for j in sorted((j for o, j in flow if o == i), key=lambda j: (j != i, j)):  # what stays comes first
            shares.append((i, a, a + flow[i, j], j))
            a += flow[i, j]
    # At most one row for each pair of shards.
    shares = spark.createDataFrame(shares, "from_shard int, a long, b long, to_shard int")
    sums = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("start", F.coalesce(F.sum("size").over(sums), F.lit(0)))
    inside = (F.col("shard") == F.col("from_shard")) & (F.col("start") >= F.col("a")) & (F.col("start") + F.col("size") <= F.col("b"))
    placed = cut_lineage(placed.join(F.broadcast(shares), inside, "left").select("shard", "file", "start", "rows", "to_shard"))

    # One row a file: broadcast while they are few, so that texts need no shuffle.
    whole = placed.where("to_shard is not null and to_shard <> shard").select("file", "to_shard")
    moved = rows.join(broadcast_if_small(whole), "file").select("row", F.col("to_shard").alias("shard"))
    split = rows.join(broadcast_if_small(placed.where("to_shard is null").select("file", "start")), "file").withColumn("size", _size())
    order = Window.partitionBy("file").orderBy(F.desc("size"), "at").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("start") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2
    split = split.withColumn("middle", middle)
    share = (F.col("shard") == F.col("from_shard")) & (F.col("middle") >= F.col("a")) & (F.col("middle") < F.col("b"))
    split = split.join(F.broadcast(shares), share).select("row", F.col("to_shard").alias("shard"))
    moved.union(split).write.partitionBy("shard").parquet(path)

    fresh = _rows(spark, path, kind)
    kept = placed.where("to_shard = shard").select("shard", "file", "rows")
    made = cut_lineage(fresh.groupBy("shard", "file").agg(F.count(F.lit(1)).alias("rows")))
    before = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    manifest = broadcast_if_small(kept.union(made).select("file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base")))
    layout = rows.join(broadcast_if_small(kept.select("file")), "file", "left_semi").select("row", "shard", "file", "at").unionByName(fresh)
    return layout.join(manifest, "file").select("row", "shard", (F.col("base") + F.col("at")).alias("slot"))
