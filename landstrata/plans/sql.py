"""Layers as SQL views, queries over them, and spatial functions for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from landstrata.functions import geometry
from landstrata.functions.props import column_names
from landstrata.model import BBOX, GEOM

# What a query may consist of, as the parser names it. All else is refused: commands, transforms, names worked out at run time.
NODES = frozenset(
    "Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation PipeOperator "
    "Pivot Project RepartitionByExpression Sample Sort SubqueryAlias Tail Union UnresolvedHaving UnresolvedHint UnresolvedInlineTable "
    "UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableOrView UnresolvedTableValuedFunction UnresolvedWith Unpivot "
    "WithWindowDefinition CurrentNamespace$ ShowTables ShowColumns DescribeRelation DescribeColumn DescribeQueryCommand ExplainCommand".split()
)
# Functions that call the JVM, and the table functions that read nothing but their arguments.
CALLS = frozenset({"reflect", "try_reflect", "java_method"})
TABLE_FUNCTIONS = frozenset("range explode explode_outer inline inline_outer json_tuple posexplode posexplode_outer stack variant_explode variant_explode_outer sql_keywords collations".split())


def register_layer(df: DataFrame, name: str, keys: list[str] | None = None) -> None:
    """A view of a layer: one column per property key, then ``geom`` and its bbox as plain columns."""
    if keys is None:
        keys = sorted(r["k"] for r in df.select(F.explode(F.map_keys("properties")).alias("k")).distinct().collect())
    named = column_names(keys, {"feature_id", "geom", "west", "south", "east", "north"})
    value = lambda k: F.try_element_at(F.col("properties"), F.lit(k))
    b = F.col("geom.bbox")
    df.select(
        "feature_id",
        *[value(k).alias(n) for k, n in named.items()],
        "geom",
        *[b[c].alias(c) for c in ("west", "south", "east", "north")],
    ).createOrReplaceTempView(name)


def register_layers(layers: dict[str, DataFrame], kinds: dict[str, str] | None = None, only: list[str] | None = None) -> list[str]:
    """Views for all vector layers; rasters and documents are left out."""
    made = []
    for name, df in layers.items():
        if (only is None or name in only) and (kinds or {}).get(name, "vector") not in ("raster", "document"):
            register_layer(df, name)
            made.append(name)
    return made


def _sequence(items) -> list:
    return [items.apply(i) for i in range(items.size())]


def _names_of(node, field: str) -> list[str]:
    return [str(x) for x in _sequence(getattr(node, field)())]


def _check_calls(expression) -> None:
    if expression.getClass().getSimpleName() == "UnresolvedFunction" and _names_of(expression, "nameParts")[-1].lower() in CALLS:
        raise ValueError("only queries are accepted: a call of the JVM")
    for child in _sequence(expression.children()):
        _check_calls(child)


def check_query(spark: SparkSession, query: str) -> None:
    """Refuse what is not a plain query over views and tables, by its parsed plan: nothing of it has been resolved or run yet.

    A name of two parts must name a database; a format or a class before a path names none.
    """

    def walk(node) -> None:
        kind = node.getClass().getSimpleName()
        if kind not in NODES:
            raise ValueError(f"only queries are accepted, not {kind}")
        if kind in ("UnresolvedRelation", "UnresolvedTableOrView"):
            name = _names_of(node, "multipartIdentifier")
            if len(name) > 1 and not spark.catalog.databaseExists(".".join(f"`{p}`" for p in name[:-1])):
                raise ValueError(f"only views and tables are read, not {'.'.join(name)}")
        if kind == "UnresolvedTableValuedFunction" and _names_of(node, "name")[-1].lower() not in TABLE_FUNCTIONS:
            raise ValueError(f"unknown table function {_names_of(node, 'name')[-1]}")
        for expression in _sequence(node.expressions()):
            _check_calls(expression)
        inner = {"ExplainCommand": "logicalPlan", "DescribeQueryCommand": "plan"}.get(kind)
        for child in [*_sequence(node.children()), *_sequence(node.innerChildren()), *_sequence(node.subqueries()), *([getattr(node, inner)()] if inner else [])]:
            # Besides plans, a node may show expressions among its inner children.
            if _is_plan(spark, child):
                walk(child)

    walk(spark._jsparkSession.sessionState().sqlParser().parsePlan(query))


def _is_plan(spark: SparkSession, node) -> bool:
    plan = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
    return plan.isInstance(node)


def register_store(store, layers: list[str] | None = None) -> list[str]:
    """Views for the layers of a store, their columns from the keys that its commits keep: no layer is read for them."""
    names = layers or store.layers()
    for name in names:
        register_layer(store.read(name), name, store.keys(name))
    return names


def run_query(spark: SparkSession, query: str, args: dict | None = None) -> DataFrame:
    """A read-only query over the views; what would write, run a program, call the JVM or read a path is refused before it runs."""
    check_query(spark, query)
    return spark.sql(query, args=args) if args else spark.sql(query)


def bbox_args(bbox: dict) -> dict:
    """Named parameters ``:west, :south, :east, :north`` for query templates."""
    return {k: float(bbox[k]) for k in ("west", "south", "east", "north")}


def columns_of(spark: SparkSession, table: str) -> DataFrame:
    """Name, type and nullability of a table's columns."""
    rows = [(c.name, c.dataType, c.nullable) for c in spark.catalog.listColumns(table)]
    return spark.createDataFrame(rows, "column_name string, data_type string, nullable boolean")


def tables(spark: SparkSession) -> DataFrame:
    rows = [(t.name, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_name string, temporary boolean")


def register_functions(spark: SparkSession) -> list[str]:
    """Spatial functions for SQL text, as SQL functions that Spark expands into the plan."""
    point = "struct<x:double,y:double>"
    bodies = {
        f"st_point(x double, y double) RETURNS {GEOM}": _sql_point(),
        f"st_makeenvelope(w double, s double, e double, n double) RETURNS {GEOM}": _sql_box(),
        f"st_envelope(g {GEOM}) RETURNS {BBOX}": "g.bbox",
        f"st_centroid_box(g {GEOM}) RETURNS {point}": (
            "named_struct('x', (g.bbox.west + g.bbox.east) / 2, 'y', (g.bbox.south + g.bbox.north) / 2)"
        ),
        f"st_pointdistance(a {point}, b {point}) RETURNS double": (
            "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
        ),
        f"st_bboxoverlap(a {GEOM}, b {GEOM}) RETURNS boolean": (
            "a.bbox.west <= b.bbox.east AND b.bbox.west <= a.bbox.east AND "
            "a.bbox.south <= b.bbox.north AND b.bbox.south <= a.bbox.north"
        ),
        f"st_intersects(a {GEOM}, b {GEOM}) RETURNS boolean": geometry.intersects_text("a", "b"),
        f"st_centroid(g {GEOM}) RETURNS {point}": geometry.centroid_text("g"),
        f"st_area(g {GEOM}) RETURNS double": geometry.area_text("g"),
        f"st_length(g {GEOM}) RETURNS double": geometry.length_text("g"),
        f"st_asgeojson(g {GEOM}) RETURNS string": geometry.geojson_text("g"),
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in bodies]


def _sql_point() -> str:
    return (
        "named_struct('gtype', 'Point', 'is_box', true, 'bbox', named_struct('west', x, 'south', y, 'east', x, 'north', y), "
        "'rings', array(named_struct('hole', false, 'pts', array(named_struct('x', x, 'y', y)))))"
    )


def _sql_box() -> str:
    corner = "named_struct('x', {0}, 'y', {1})".format
    ring = ", ".join(corner(*c) for c in (("w", "s"), ("e", "s"), ("e", "n"), ("w", "n"), ("w", "s")))
    return (
        "named_struct('gtype', 'Polygon', 'is_box', true, 'bbox', named_struct('west', w, 'south', s, 'east', e, 'north', n), "
        f"'rings', array(named_struct('hole', false, 'pts', array({ring}))))"
    )
