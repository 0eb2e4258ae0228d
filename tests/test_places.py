"""Joins by distinct shapes: copies do not multiply, and no side is broadcast by the size that Spark expects of it."""

import time

from pyspark.sql import functions as F

from landstrata.functions import geometry as g
from landstrata.operators import annotate as an
from landstrata.operators import layers
from landstrata.operators.spatial_join import spatial_join, spatial_pairs
from test_scale import brute, found, mixed


def test_large_sides_are_not_broadcast(spark):
    at = lambda m: (F.col("id") * m % 9973) / 100.0
    p = spark.range(3000).select("id", g.point(at(7), at(11)).alias("geom"))
    b = spark.range(3000).select("id", g.box_polygon(at(5), at(3), at(5) + 0.1, at(3) + 0.1).alias("geom"))
    options = {"left_id": "id", "right_id": "id"}
    for df in (spatial_pairs(p, b, **options), spatial_pairs(p, b, by_place=True, **options), spatial_join(p, b, "left_semi", **options)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_pairs_by_place_equal_brute_force(spark):
    a = mixed(spark, 60, 1).withColumn("id", F.explode(F.array(*[F.col("id") + 1000 * i for i in range(6)]))).withColumn("m", F.when(F.col("id") % 4 > 0, F.col("id") % 2))
    b = mixed(spark, 50, 11).withColumn("id", F.explode(F.array(*[F.col("id") + 1000 * i for i in range(5)]))).withColumn("m", F.when(F.col("id") % 5 > 0, F.col("id") % 2))
    ids = {"left_id": "id", "right_id": "id"}
    want = brute(a, b, "id", "id")
    assert found(spatial_pairs(a, b, **ids), "id", "id") == want == found(spatial_pairs(a, b, by_place=False, **ids), "id", "id")
    plain, shared = ({(r.id, r.anno_id) for r in spatial_pairs(a, b, equal=[("m", "m")], on=F.col("id") < F.col("anno_id"), by_place=x, **ids).collect()} for x in (False, True))
    assert shared == plain and plain
    met = {i for i, _ in want}
    assert {r.id for r in spatial_join(a, b, "left_semi", **ids).collect()} == met
    assert {r.id for r in spatial_join(a, b, "left_anti", **ids).collect()} == {r.id for r in a.collect()} - met


def test_one_partner_equals_choice_among_pairs(spark):
    a, b = mixed(spark, 60, 1), mixed(spark, 50, 11)
    b = b.withColumn("id", F.explode(F.array(F.col("id"), F.col("id") + 1000))).withColumnRenamed("id", "other")
    ids = {"left_id": "id", "right_id": "other"}
    pairs = spatial_pairs(a, b, **ids)
    for pick in ("nearest", "farthest"):
        want = {(r.id, r.anno_other) for r in an.one_match(pairs, "id", "anno_other", pick).collect()}
        assert {(r.id, r.anno_other) for r in an.one_partner(a, b, pick=pick, **ids).collect()} == want


def test_many_features_and_annotations_at_one_place(spark):
    """400 million pairs of rows, one pair of shapes."""
    n, props = 20_000, lambda k, v: F.create_map(F.lit(k), v.cast("string"))
    feats = spark.range(n).select(F.col("id").alias("feature_id"), g.point(F.lit(1.0), F.lit(1.0)).alias("geom"), props("kind", F.col("id")).alias("properties"))
    annos = spark.range(n).select(F.col("id").alias("feature_id"), g.box_polygon(*[F.lit(v) for v in (0.0, 0.0, 2.0, 2.0)]).alias("geom"), props("note", F.col("id")).alias("properties"))
    began = time.time()
    out = an.annotate(feats, annos)
    assert out.where("properties['note'] = '19999' and properties['kind'] = cast(feature_id as string)").count() == n
    assert time.time() - began < 60


def test_duplicates_are_merged_once_a_shape(spark, monkeypatch):
    """40 million pairs of rows, but few distinct properties; before, each pair was merged."""
    monkeypatch.setattr(an, "COPIES_AT_ONCE", 300)
    n = 4000
    props = lambda k, v: F.create_map(F.lit(k), v.cast("string"))
    feats = spark.range(10 * n).select(F.col("id").alias("feature_id"), g.point(F.lit(1.0), F.lit(1.0)).alias("geom"), props("kind", F.col("id") % 3).alias("properties"))
    annos = spark.range(1000).select(F.col("id").alias("feature_id"), g.box_polygon(*[F.lit(v) for v in (0.0, 0.0, 2.0, 2.0)]).alias("geom"), props("note", F.when(F.col("id") > 0, "x").otherwise("")).alias("properties"))
    began = time.time()
    out = an.annotate(feats, annos, multi="duplicate")
    seen = out.groupBy(F.col("properties")["kind"].alias("k"), F.col("properties")["note"].alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("feature_id").alias("ids")).collect()
    kinds = [sum(i % 3 == k for i in range(10 * n)) for k in range(3)]
    assert {(r.k, r.n): r.rows for r in seen} == {(str(k), v): m * kinds[k] for k in range(3) for v, m in (("x", 999), (None, 1))}
    assert time.time() - began < 60


def test_duplicates_of_odd_features(spark):
    """A null id, a null map, an empty one, a missing shape, equal rows: each meets what its shape meets, or stays as it is."""
    here, away = "point(1, 1)", "point(9, 9)"
    at = {here: g.point(F.lit(1.0), F.lit(1.0)), away: g.point(F.lit(9.0), F.lit(9.0))}
    rows = [(1, here, {"a": "1"}), (1, here, {"a": "1"}), (None, here, {"a": "2"}), (2, here, None), (3, here, {}), (4, away, None), (5, None, {"a": "5"}), (6, away, {"a": "6"})]
    df = spark.createDataFrame(rows, "feature_id int, at string, properties map<string,string>")
    feats = df.withColumn("geom", F.when(F.col("at") == here, at[here]).when(F.col("at") == away, at[away]))
    notes = spark.createDataFrame([(1, {"a": "x", "b": ""}), (2, {"b": "y"}), (3, {"b": "y"}), (4, None)], "feature_id int, properties map<string,string>")
    annos = notes.withColumn("geom", g.box_polygon(*[F.lit(v) for v in (0.0, 0.0, 2.0, 2.0)]))
    got = [(r.feature_id, r.at, r.properties) for r in an.annotate(feats, annos, multi="duplicate").collect()]
    want = [(i, p, dict(m or {}, **over)) for i, p, m in rows if p == here for over in ({"a": "x"}, {"b": "y"}, {"b": "y"}, {})]
    want += [r for r in rows if r[1] != here]
    key = lambda r: (str(r[0]), str(r[1]), str(sorted((r[2] or {}).items())), r[2] is None)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_many_changes_at_one_place(spark):
    """Each row gets the latest change that is later than itself; 100 million pairs of rows."""
    n = 20_000
    at = F.timestamp_seconds(F.col("id"))
    where = F.when(F.col("id") % 2 == 0, g.point(F.lit(1.0), F.lit(1.0))).otherwise(g.box_polygon(*[F.lit(v) for v in (0.0, 0.0, 2.0, 2.0)]))
    last = F.col("id") > n - 3
    deltas = spark.range(n).select(
        F.col("id").cast("string").alias("feature_id"), where.alias("geom"), F.create_map(F.lit("v"), F.col("id").cast("string")).alias("properties"), at.alias("ts"),
        F.lpad(F.col("id").cast("string"), 8, "0").alias("file"), F.lit(0).cast("bigint").alias("pos"),
        F.when(F.col("id") % 2 == 0, "create").when(F.col("id") == 5, "delete").otherwise("annotate").alias("action"),
    ).where(~last | (F.col("id") % 2 == 0))
    began = time.time()
    got = {int(r.feature_id): r.v for r in layers.apply_deltas(None, deltas).selectExpr("feature_id", "properties['v'] as v").collect()}
    assert got == {i: str(n - 3 if i < n - 3 else i) for i in range(6, n, 2)}
    assert time.time() - began < 60


def test_shapes_of_few_vertices_need_no_edges(spark, monkeypatch):
    """Pairs of triangles and boxes are settled in one join, without edges."""
    from landstrata.operators import edge_join

    monkeypatch.setattr(edge_join, "_edges", None)
    a = mixed(spark, 40, 1)
    for find, predicate in ((edge_join.intersecting_ids, "intersects"), (edge_join.ids_within, "within")):
        out = find(a, a, "id", "id")
        plain = spatial_pairs(a, a, left_id="id", right_id="id", predicate=predicate).select("id", "anno_id").collect()
        assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in plain)
