"""Geometry and attributes derived from the driver tables by formulas that Spark and DuckDB both evaluate.

Every frame has its twin in ``VIEWS``; ``sql(text)`` puts the views a query names in front of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from landstrata.functions import geometry as g
from landstrata.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, oracle: str | None = None):
    """Register a query, and its SQL when there is one."""

    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shapes(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table that geometry is made of, dealt over the cores: the tables here are one file each."""
    return read_table(spark, f"{sf}/{name}.parquet", spark.sparkContext.defaultParallelism)


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, minus zero as zero."""
    col = F.col(c) if isinstance(c, str) else c
    v = F.round(col, digits)
    return F.when(v == 0, F.lit(0.0)).otherwise(v)


def _scatter(key: Column, factor: int, base: int) -> Column:
    return (key * factor % 10000) / F.lit(10000.0) + F.lit(float(base))


def pts(spark, sf) -> DataFrame:
    e = shapes(spark, sf, "events")
    x, y = _scatter(F.col("event_id"), 7919, -124), _scatter(F.col("event_id"), 6007, 39)
    return e.select("event_id", "event_type", "user_id", "value", "ts", x.alias("x"), y.alias("y"), g.point(x, y).alias("geom"))


def box(spark, sf) -> DataFrame:
    p = shapes(spark, sf, "part")
    cx, cy = _scatter(F.col("p_partkey"), 4231, -124), _scatter(F.col("p_partkey"), 3011, 39)
    h = F.col("p_size") / F.lit(5000.0)
    return p.select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", cx.alias("cx"), cy.alias("cy"),
        (cx - h).alias("w"), (cy - h).alias("s"), (cx + h).alias("e"), (cy + h).alias("n"),
        g.box_polygon(cx - h, cy - h, cx + h, cy + h).alias("geom"),
    )


def tri(spark, sf) -> DataFrame:
    """Right triangles in the south-west half of the boxes: shapes that do not fill their bbox."""
    b = box(spark, sf)
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(p("w", "s"), p("e", "s"), p("w", "n"), p("w", "s"))
    rings = F.array(F.struct(F.lit(False).alias("hole"), ring.alias("pts")))
    geom = F.struct(
        F.lit("Polygon").alias("gtype"), F.lit(False).alias("is_box"),
        g.bbox(F.col("w"), F.col("s"), F.col("e"), F.col("n")).alias("bbox"), rings.alias("rings"),
    )
    return b.withColumn("geom", geom)


def reg(spark, sf) -> DataFrame:
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    w = (k % 5) * F.lit(0.2) + F.lit(-124.0)
    s = F.floor(k / 5) * F.lit(0.2) + F.lit(39.0)
    return n.select(
        k.cast("bigint").alias("k"), F.col("n_name").alias("name"), w.alias("w"), s.alias("s"), (w + 0.2).alias("e"), (s + 0.2).alias("n"),
        g.box_polygon(w, s, w + 0.2, s + 0.2).alias("geom"),
    )


def lin(spark, sf) -> DataFrame:
    """A segment per line item from its supplier's place to its part's place."""
    t = shapes(spark, sf, "lineitem")
    ax, ay = _scatter(F.col("l_suppkey"), 4231, -124), _scatter(F.col("l_suppkey"), 3011, 39)
    bx, by = _scatter(F.col("l_partkey"), 4231, -124), _scatter(F.col("l_partkey"), 3011, 39)
    return t.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_quantity",
        ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), g.line((ax, ay), (bx, by)).alias("geom"),
    )


def attr(spark, sf) -> DataFrame:
    """Orders as features whose property map has absent, null and empty values."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    entry = lambda key, value, there: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"), there.alias("there"))
    entries = F.array(
        entry("a", F.when(k % 3 != 0, F.concat(F.lit("PRIVATE GATED road "), (k % 100).cast("string"))), k % 4 != 0),
        entry("b", F.concat(F.lit("b"), (k % 7).cast("string")), F.lit(True)),
        entry("c", F.col("o_orderpriority"), k % 5 != 0),
        entry("d", F.when(k % 2 == 0, None).when(k % 7 == 0, F.lit("")).otherwise(F.col("o_orderstatus")), F.lit(True)),
    )
    there = F.filter(entries, lambda e: e["there"])
    props = F.map_from_entries(F.transform(there, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    return o.select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice", props.alias("properties"))


def delta(spark, sf) -> DataFrame:
    """Orders as deltas on points: most create a feature, some annotate or delete what lies in a small box."""
    o = shapes(spark, sf, "orders")
    k = F.col("o_orderkey")
    x, y = _scatter(k, 7919, -124), _scatter(k, 6007, 39)
    act = F.when(k % 11 == 0, "delete").when(k % 5 == 0, "annotate").otherwise("create")
    h = F.when(act == "create", F.lit(0.0)).otherwise(F.lit(0.004))
    pt, bx = g.point(x, y), g.box_polygon(x - h, y - h, x + h, y + h)
    geom = F.struct(
        F.when(act == "create", "Point").otherwise("Polygon").alias("gtype"), F.lit(True).alias("is_box"),
        bx["bbox"].alias("bbox"), F.when(act == "create", pt["rings"]).otherwise(bx["rings"]).alias("rings"),
    )
    note = F.when(k % 2 == 0, F.concat(F.lit("n"), k.cast("string"))).otherwise(F.lit(""))
    props = F.when(act == "annotate", F.create_map(F.lit("note"), note, F.lit("by"), F.col("o_orderstatus"))).otherwise(
        F.create_map(F.lit("name"), k.cast("string"))
    )
    return o.select(
        F.lit("places").alias("layer"), F.col("o_orderpriority").alias("asset"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        act.alias("action"), F.lpad(k.cast("string"), 12, "0").alias("file"), F.lit(0).cast("bigint").alias("pos"),
        k.cast("string").alias("feature_id"), geom.alias("geom"), props.alias("properties"),
    )


def dem(spark, sf) -> DataFrame:
    """Events as a raster of 128 columns."""
    e = table(spark, sf, "events")
    row, col = F.floor(F.col("event_id") / 128), F.col("event_id") % 128
    value = (row * 7 + col * 13) % 97 - 10 + F.col("value") / F.lit(50.0)
    return e.select(row.alias("row"), col.alias("col"), value.alias("value"))


VIEWS = {
    "pts": """select event_id, event_type, user_id, value, ts,
        cast((event_id * 7919) % 10000 as double) / 10000 + cast(-124 as double) as x,
        cast((event_id * 6007) % 10000 as double) / 10000 + cast(39 as double) as y from events""",
    "box": """select *, cx - h as w, cy - h as s, cx + h as e, cy + h as n from (select p_partkey, p_name, p_brand, p_type, p_size,
        cast((p_partkey * 4231) % 10000 as double) / 10000 + cast(-124 as double) as cx,
        cast((p_partkey * 3011) % 10000 as double) / 10000 + cast(39 as double) as cy,
        cast(p_size as double) / cast(5000 as double) as h from part)""",
    "reg": """select k, name, w, s, w + cast(0.2 as double) as e, s + cast(0.2 as double) as n from (
        select cast(n_nationkey as bigint) as k, n_name as name,
        cast(n_nationkey % 5 as double) * cast(0.2 as double) + cast(-124 as double) as w,
        floor(cast(n_nationkey as double) / 5) * cast(0.2 as double) + cast(39 as double) as s from nation)""",
    "lin": """select l_orderkey, l_linenumber, l_suppkey, l_partkey, l_returnflag, l_quantity,
        cast((l_suppkey * 4231) % 10000 as double) / 10000 + cast(-124 as double) as ax,
        cast((l_suppkey * 3011) % 10000 as double) / 10000 + cast(39 as double) as ay,
        cast((l_partkey * 4231) % 10000 as double) / 10000 + cast(-124 as double) as bx,
        cast((l_partkey * 3011) % 10000 as double) / 10000 + cast(39 as double) as "by" from lineitem""",
    "attr": """select o_orderkey, o_orderpriority, o_orderstatus, o_totalprice,
        o_orderkey % 4 <> 0 as a_there, case when o_orderkey % 4 <> 0 and o_orderkey % 3 <> 0 then 'PRIVATE GATED road ' || cast(o_orderkey % 100 as varchar) end as a,
        'b' || cast(o_orderkey % 7 as varchar) as b,
        o_orderkey % 5 <> 0 as c_there, case when o_orderkey % 5 <> 0 then o_orderpriority end as c,
        case when o_orderkey % 2 = 0 then null when o_orderkey % 7 = 0 then '' else o_orderstatus end as d from orders""",
    "delta": """select o_orderkey as k, o_orderpriority as asset, o_orderdate as ts, o_orderstatus,
        case when o_orderkey % 11 = 0 then 'delete' when o_orderkey % 5 = 0 then 'annotate' else 'create' end as action,
        cast((o_orderkey * 7919) % 10000 as double) / 10000 + cast(-124 as double) as x,
        cast((o_orderkey * 6007) % 10000 as double) / 10000 + cast(39 as double) as y from orders""",
    "dem": """select cast(event_id // 128 as bigint) as "row", event_id % 128 as col,
        cast(((event_id // 128) * 7 + (event_id % 128) * 13) % 97 - 10 as double) + value / cast(50 as double) as value from events""",
}
# Views that stand on other views.
_NEEDS = {"pib": ("pts", "box")}
VIEWS["pib"] = """select event_id, event_type, user_id, value, x, y, p_partkey, p_type, p_brand, p_size, cx, cy
        from pts join box on x between w and e and y between s and n"""


def sql(text: str) -> str:
    """Query text with the derived views it uses as common table expressions."""
    named = [v for v in VIEWS if re.search(rf"\b(from|join|,)\s*{v}\b", text)]
    needed: list[str] = []
    for v in named:
        for d in (*_NEEDS.get(v, ()), v):
            if d not in needed:
                needed.append(d)
    ctes = ", ".join(f"{v} as ({VIEWS[v]})" for v in needed)
    body = text.strip()
    if not ctes:
        return body
    if body.lower().startswith("with "):
        return f"with {ctes}, {body[5:]}"
    return f"with {ctes} {body}"
