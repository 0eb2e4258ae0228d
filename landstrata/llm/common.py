"""Helpers shared by the operators: tables, scratch folders, numbering and connected components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from landstrata.session import checkpoint_dir, cut_lineage


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_RECORDS: list[list[str]] = []


@contextmanager
def recorded(paths: list[str]):
    """Note the scratch folders that are named meanwhile in ``paths``, so that they can be removed when nobody reads them any more."""
    _RECORDS.append(paths)
    try:
        yield paths
    finally:
        _RECORDS.remove(paths)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch folders. Frames that read them are lost, so what they gave must have been written."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    paths.clear()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, inside the shared folder that the cluster names for checkpoints."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    for paths in _RECORDS:
        paths.append(path)
    return path


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage ends at the files."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df``, for broadcast if it is counted to be of at most ``rows`` short rows; else Spark joins it by shuffle.

    ``df`` should be a written table or a few steps from one, as it is counted first.
    """
    return F.broadcast(df) if df.count() <= rows else df


def number_within(df: DataFrame, keys: list[str], order: list[Column], spread: Column, name: str, rows: int = 100_000) -> DataFrame:
    """Gapless numbers from 0 within each group of ``keys``, without one task per group.

    A group of n rows is dealt by the hash of ``spread`` over about n / ``rows`` buckets; rows are numbered inside
    their bucket and the sizes of the earlier buckets are added. ``order`` should tell all rows apart that differ
    in what is kept, so that a repeated task numbers them alike. Null keys form a group. ``df`` is read three
    times, so it should be a written table.
    """
    same = lambda a, b: [a[f"`{k}`"].eqNullSafe(b[f"`__{k}`"]) for k in keys]
    renamed = {k: f"__{k}" for k in keys}
    sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("__parts"))
    # One row per group of keys; a group that needs one bucket does not have to be looked up.
    split = sizes.where("__parts > 1").withColumnsRenamed(renamed)
    dealt = df.join(split, same(df, split), "left").drop(*renamed.values())
    dealt = dealt.withColumn("__bucket", F.pmod(F.xxhash64(spread), F.coalesce(F.col("__parts"), F.lit(1))).cast("int")).drop("__parts")
    counts = dealt.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    base = base.withColumnsRenamed({**renamed, "__bucket": "__b"})
    inside = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*order)) - 1
    placed = dealt.withColumn("__i", inside)
    out = placed.join(base, [*same(placed, base), placed["__bucket"] == base["__b"]], "inner")
    return out.withColumn(name, F.col("__i") + F.col("__base")).drop(*renamed.values(), "__bucket", "__b", "__i", "__base")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of the edges ``(a, b)``; component is the smallest node it reaches.

    Alternating large-star and small-star steps: each hangs a node's neighbours on the least node it knows, until
    only stars on the least nodes are left. Every step is two aggregations and a join on the node; the edges of
    each round are cut by a checkpoint. Self links and repeated links do no harm.
    """
    def least(both: DataFrame) -> DataFrame:
        return both.groupBy("u").agg(F.min("v").alias("m"))

    def large(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = least(both).select("u", F.least("u", "m").alias("m"))
        return both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = least(down)
        hung = down.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return hung.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()

    mark = lambda e: e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
    now = cut_lineage(edges.select("a", "b").where("a <> b").distinct())
    nodes = now.select(F.col("a").alias("node")).union(now.select(F.col("b").alias("node"))).distinct()
    seen = mark(now)
    for _ in range(rounds):
        now = cut_lineage(small(large(now)))
        last, seen = seen, mark(now)
        if seen == last:
            break
    else:
        raise RuntimeError("components did not settle; raise rounds")
    # Stars: a hangs on b. Nodes that nothing hangs higher are their own component.
    return nodes.join(now.select(F.col("a").alias("node"), "b"), "node", "left").select("node", F.coalesce("b", "node").alias("component"))
