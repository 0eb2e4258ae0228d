"""Hot keys, hot cells and plan shapes."""

from pyspark.sql import Window, functions as F

from checks.derived import box, pts, tri
from conftest import SF
from landstrata.functions import geometry as g
from landstrata.operators import cells, profile, skew
from landstrata.operators.spatial_join import spatial_join, spatial_pairs


def brute(left, right, a, b):
    r = right.select(F.col(b).alias("k"), F.col("geom").alias("other"))
    return sorted(tuple(x) for x in left.crossJoin(r).filter(g.intersects("geom", "other")).select(a, "k").collect())


def found(pairs, a, b):
    return sorted(tuple(x) for x in pairs.select(a, "anno_" + b).collect())


def mixed(spark, n, seed):
    """Shapes from points to ones that span everything, a third of them at one place."""
    size = F.pow(F.lit(2.0), F.floor(F.rand(seed) * 14) - 10)
    x = F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise(F.rand(seed + 1) * 20)
    y = F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise(F.rand(seed + 2) * 20)
    base = spark.range(n).select("id", x.alias("x"), y.alias("y"), size.alias("z"))
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    X, Y, Z = F.col("x"), F.col("y"), F.col("z")
    ring = F.array(p(X, Y), p(X + Z, Y + Z / 3), p(X + Z / 4, Y + Z), p(X, Y))
    rings = F.array(F.struct(F.lit(False).alias("hole"), ring.alias("pts")))
    triangle = g.from_rings(F.lit("Polygon"), rings)
    rows = [r for r in base.select("id", F.when(F.col("id") % 2 == 0, g.box_polygon(X, Y, X + Z, Y + Z)).when(F.col("id") % 7 == 0, g.point(X, Y)).otherwise(triangle).alias("geom")).collect()]
    return spark.createDataFrame(rows, schema=base.select("id", triangle.alias("geom")).schema)


def test_join_of_mixed_sizes_equals_brute_force(spark):
    a, b = mixed(spark, 150, 1), mixed(spark, 120, 11)
    want = brute(a, b, "id", "id")
    for options in ({}, {"hot_rows": 10}, {"cell_side": 0.01}, {"cell_side": 50.0}, {"cell_side": 0.3, "hot_rows": 5}):
        assert found(spatial_pairs(a, b, left_id="id", right_id="id", **options), "id", "id") == want, options


def test_outer_semi_and_anti_agree(spark):
    p, b = pts(spark, SF).select("event_id", "geom"), tri(spark, SF).select("p_partkey", "geom")
    ids = {"left_id": "event_id", "right_id": "p_partkey"}
    inner = spatial_join(p, b, **ids)
    semi, anti, left = (spatial_join(p, b, how, **ids) for how in ("left_semi", "left_anti", "left"))
    matched = inner.select("event_id").distinct().count()
    assert semi.count() == matched and anti.count() == p.count() - matched
    assert left.count() == inner.count() + anti.count()


def test_no_cartesian_or_nested_loop_in_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = box(spark, SF).select("p_partkey", "geom")
        plans = [
            spatial_pairs(pts(spark, SF).select("event_id", "geom"), b, left_id="event_id", right_id="p_partkey"),
            spatial_pairs(b, b, left_id="p_partkey", right_id="p_partkey", hot_rows=10),
        ]
        for df in plans:
            text = df._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in text and "NestedLoop" not in text
            assert "SortMergeJoin" in text or "ShuffledHashJoin" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_numbering_with_a_hot_group(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 != 0, F.lit("hot")).when(F.col("id") % 9 == 0, None).otherwise((F.col("id") % 5).cast("string")).alias("k"), (F.col("id") * 7919 % 5000).alias("o"))
    w = Window.partitionBy("k").orderBy("o")
    want = {(r.id, r.n) for r in rows.withColumn("n", F.row_number().over(w)).select("id", "n").collect()}
    assert {(r.id, r.n) for r in skew.number_rows(rows, "o", ["k"], limit=150).select("id", "n").collect()} == want
    # The largest range stays far below the hot group.
    ranged, split = skew.in_ranges(rows, ["k"], ["o"], 150)
    assert split and ranged.groupBy("k", "__range").count().agg(F.max("count")).collect()[0][0] < 5000 * 2 / 3 / 8


def test_numbering_with_equal_order_values_and_nulls(spark):
    """One order value for most rows of one group, nulls in order and key: numbers are gapless, and no range is large."""
    rows = spark.range(6000).select("id", F.when(F.col("id") % 4 > 0, F.lit(1)).alias("k"), F.when(F.col("id") % 3 > 0, F.lit("same")).when(F.col("id") % 2 == 0, "z").alias("o"))
    got = skew.number_rows(rows, "o", ["k"], limit=200)
    gaps = got.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("n").alias("d"), F.min("n").alias("a"), F.max("n").alias("b")).collect()
    assert all((g.n, g.n, 1) == (g.d, g.b, g.a) for g in gaps) and sum(g.n for g in gaps) == 6000
    wrong = got.withColumn("before", F.lag("o").over(Window.partitionBy("k").orderBy("n"))).where("before > o or (before is not null and o is null)")
    assert wrong.count() == 0
    ranged, _ = skew.in_ranges(rows, ["k"], ["o"], 200)
    assert ranged.groupBy("k", "__range").count().agg(F.max("count")).collect()[0][0] < 700
    tied = skew.number_rows(rows, "o", ["k"], ["id"], limit=200).select("id", "n")
    want = rows.select("id", F.row_number().over(Window.partitionBy("k").orderBy("o", "id")).cast("bigint").alias("n"))
    assert tied.exceptAll(want).count() == 0


def test_small_groups_are_one_window(spark):
    """100,000 groups: one exchange of the rows and no join, and the links of each group are its own."""
    from landstrata.operators import regions

    rows = spark.range(200_000).select("id", (F.col("id") % 100_000).alias("k"), F.col("id").cast("string").alias("name"))
    out = regions.link_neighbors(rows, "id", "name", ["k"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert out.where("cast(prev as bigint) <> (id + 100000) % 200000 or prev <> next").count() == 0
    expanding = profile.expanding_stats(rows, "id", "id", ["k"])._jdf.queryExecution().executedPlan().toString()
    assert expanding.count("Exchange") == 1 and "Join" not in expanding


def test_links_of_a_group_cut_into_ranges(spark):
    from landstrata.operators import regions

    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 9 > 0, "x").alias("k"), F.when(F.col("id") % 50 > 0, F.col("id").cast("string")).alias("name"))
    w = Window.partitionBy("k").orderBy("id")
    all_of = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.row_number().over(w)
    want = rows.select(
        "id", F.when(n == 1, F.last("name").over(all_of)).otherwise(F.lag("name").over(w)).alias("prev"),
        F.when(F.lead("id").over(w).isNull(), F.first("name").over(all_of)).otherwise(F.lead("name").over(w)).alias("next"),
    )
    got = regions.link_neighbors(rows, "id", "name", ["k"], limit=100).select("id", "prev", "next")
    assert got.exceptAll(want).count() == 0 and got.count() == 3000
    assert regions.link_neighbors(rows.select("id", "name"), "id", "name", limit=100).where("id = 0").first().prev == "2999"


def test_expanding_stats_over_one_series(spark):
    rows = spark.range(3000).select("id", (F.col("id") * 37 % 101 + 1e6).alias("v"))
    w = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    want = rows.withColumns({"m": F.avg("v").over(w), "s": F.stddev_samp("v").over(w)})
    got = profile.expanding_stats(rows, "id", "v", limit=200).join(want, "id")
    far = got.filter((F.abs(F.col("m") - F.col("mean_before")) > 1e-6) | (F.abs(F.col("s") - F.col("std_before")) > 1e-6) | (F.col("id") != F.col("n_before")))
    assert far.count() == 0
    assert got.filter("std_before is null").count() == 2


def test_group_values_reach_all_rows(spark):
    rows = spark.range(1000).withColumn("k", F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 7))
    values = rows.groupBy("k").agg(F.max("id").alias("top"))
    out = skew.attach_group_values(rows, values, ["k"], F.col("id"), 8)
    assert out.count() == 1000 and out.groupBy("k").agg(F.countDistinct("top").alias("n")).filter("n > 1").count() == 0


def test_nearest_cells_equal_all_pairs(spark):
    src = spark.range(300).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, 8).otherwise(9).alias("res"), (F.col("id") * 37 % 211 - 100).alias("q"), (F.col("id") * 53 % 307 - 150).alias("r"))
    tgt = spark.range(40).select(F.when(F.col("id") % 2 == 0, 8).otherwise(9).alias("res"), (F.col("id") * 91 % 977 - 400).alias("q"), (F.col("id") * 17 % 499 - 250).alias("r"))
    from landstrata.functions import hexgrid as h

    t = tgt.select(F.col("res").alias("tres"), F.col("q").alias("tq"), F.col("r").alias("tr"))
    top = F.greatest("res", "tres")
    pairs = src.crossJoin(t).withColumns({"a": h.recenter(F.col("q"), F.col("r"), F.col("res"), top), "b": h.recenter(F.col("tq"), F.col("tr"), F.col("tres"), top)})
    want = {tuple(r) for r in pairs.groupBy("res", "q", "r").agg(F.min(h.grid_distance(F.col("a.q"), F.col("a.r"), F.col("b.q"), F.col("b.r"))).alias("d")).collect()}
    assert {tuple(r) for r in cells.nearest_cell_distance(src, tgt, "d").collect()} == want
    assert cells.nearest_cell_distance(src, tgt.limit(0), "d").filter("d is not null").count() == 0


def test_flat_raster_is_left_unscaled(spark):
    from landstrata.operators import raster

    flat = spark.range(100).select((F.col("id") / 10).cast("bigint").alias("row"), (F.col("id") % 10).alias("col"), F.lit(5.0).alias("value"))
    assert flat.count() == 100
    shades = {round(r.shade, 9) for r in raster.shade(flat, tile=4).collect()}
    assert shades == {round(0.5**0.5, 9)}
    assert raster.contours(flat, 2.0, tile=4).count() == 0
    tiles = [sorted(tuple(r) for r in raster.gradients(flat.withColumn("value", F.col("row") * F.col("col") + 0.0), tile=t).collect()) for t in (3, 256)]
    assert tiles[0] == tiles[1]


def test_ranges_are_looked_up_once_a_row(spark):
    """Where the order tells rows apart, none is hashed, and no filter looks a range up again."""
    rows = spark.range(4000).select("id", (F.col("id") * 7919 % 4000).alias("o"), F.array(F.col("id")).alias("shape"))
    got = skew.number_rows(rows, "o", limit=200)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" not in plan and not any("Filter" in line and "lambda" in line for line in plan.splitlines())
    assert got.where("n <> o + 1").count() == 0
