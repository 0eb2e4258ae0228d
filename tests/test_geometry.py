import json
import math
import random
import struct

from pyspark.sql import functions as F

from landstrata.functions import geometry as g, hexgrid
from landstrata.functions.clip import clip, clip_rows
from landstrata.operators import regions


def geoms(spark, *pairs):
    rows = [(i, t, json.dumps(c)) for i, (t, c) in enumerate(pairs)]
    return spark.createDataFrame(rows, "id int, t string, c string").select("id", g.from_geojson("t", "c").alias("geom"))


def star(rng, n, cx=-123.5, cy=39.5, size=0.05):
    pts = []
    for i in range(n):
        a, d = 2 * math.pi * i / n, rng.uniform(size / 10, size)
        pts.append([cx + d * math.cos(a), cy + d * math.sin(a)])
    return pts + [pts[0]]


def inside(ring, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


SQUARE = ("Polygon", [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]])
HOLED = ("Polygon", [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [3, 1], [3, 3], [1, 3], [1, 1]]])
MULTI = ("MultiPolygon", [[[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 6], [5, 5]]]])


def test_geojson_round_trip_of_all_types(spark):
    shapes = [
        ("Point", [1.0, 2.0]), ("MultiPoint", [[1.0, 1.0], [2.0, 3.0]]), ("LineString", [[0.0, 0.0], [1.0, 1.0]]),
        ("MultiLineString", [[[0.0, 0.0], [1.0, 1.0]], [[2.0, 2.0], [3.0, 3.0]]]), HOLED, MULTI,
    ]
    out = geoms(spark, *shapes).select("id", g.to_geojson("geom").alias("j")).orderBy("id").collect()
    for row, (kind, coordinates) in zip(out, shapes):
        assert json.loads(row.j) == {"type": kind, "coordinates": json.loads(json.dumps(coordinates))}


def test_malformed_geometry_is_null(spark):
    bad = geoms(spark, ("Point", []), ("Polygon", "x"), ("LineString", [[0, 0]]), ("Circle", [1, 2]))
    assert bad.filter("geom IS NOT NULL").count() == 0


def test_measures(spark):
    rows = geoms(spark, HOLED, MULTI, ("LineString", [[0, 0], [0, 3], [4, 3]]), ("Point", [7, 8]), ("Polygon", [[[0, 0], [2, 0], [2, 0], [0, 0]]]))
    out = rows.select("id", g.area("geom").alias("a"), g.length("geom").alias("l"), g.centroid("geom").alias("c")).orderBy("id").collect()
    assert [r.a for r in out] == [12.0, 2.0, 0.0, 0.0, 0.0]
    assert out[2].l == 7.0
    assert (out[0].c.x, out[0].c.y) == (2.0, 2.0)
    assert (out[1].c.x, out[1].c.y) == (3.0, 3.0)
    assert abs(out[2].c.x - 8 / 7) < 1e-12
    assert (out[3].c.x, out[3].c.y) == (7.0, 8.0)
    assert (out[4].c.x, out[4].c.y) == (1.0, 0.0)  # no area: along its edges


def test_intersects_counts_boundaries_and_respects_holes(spark):
    a = geoms(spark, SQUARE, HOLED)
    others = [
        (("Point", [4, 4]), True, True), (("Point", [2, 2]), True, False), (("Point", [1, 2]), True, True),
        (("Point", [5, 5]), False, False), (("LineString", [[1.5, 1.5], [2.5, 2.5]]), True, False),
        (("LineString", [[-1, 2], [5, 2]]), True, True), (("LineString", [[4, 0], [8, 0]]), True, True),
        (("LineString", [[3.9, -1], [5, 0.05]]), False, False), (("Polygon", [[[2, 2], [9, 3], [9, 9], [2, 2]]]), True, True),
        (("Polygon", [[[1.5, 1.5], [2.5, 1.5], [2, 2.5], [1.5, 1.5]]]), True, False),
        (("Polygon", [[[-5, -5], [15, -5], [5, 25], [-5, -5]]]), True, True), (("MultiPoint", [[9, 9], [0, 0]]), True, True),
    ]
    b = geoms(spark, *[o[0] for o in others]).select(F.col("id").alias("k"), F.col("geom").alias("other"))
    for left, right in (("geom", "other"), ("other", "geom")):
        got = {(r.id, r.k): r.hit for r in a.crossJoin(b).select("id", "k", g.intersects(left, right).alias("hit")).collect()}
        for k, (_, square, holed) in enumerate(others):
            assert (got[0, k], got[1, k]) == (square, holed), (others[k], left)


def test_point_in_random_polygons(spark):
    rng = random.Random(5)
    rings = [star(rng, rng.randint(3, 12)) for _ in range(20)]
    points = [(-123.5 + rng.uniform(-0.05, 0.05), 39.5 + rng.uniform(-0.05, 0.05)) for _ in range(60)]
    polygons = geoms(spark, *[("Polygon", [r]) for r in rings])
    pts = geoms(spark, *[("Point", list(p)) for p in points]).select(F.col("id").alias("k"), F.col("geom").alias("p"))
    rows = polygons.crossJoin(pts).select("id", "k", g.intersects("p", "geom").alias("hit")).collect()
    assert all(r.hit == inside(rings[r.id], *points[r.k]) for r in rows)


def test_within_needs_the_whole_shape(spark):
    u_shape = ("Polygon", [[[0, 0], [6, 0], [6, 6], [4, 6], [4, 2], [2, 2], [2, 6], [0, 6], [0, 0]]])
    a = geoms(spark, ("LineString", [[1, 5], [5, 5]]), ("LineString", [[1, 1], [5, 1]]), ("LineString", [[0, 0], [6, 0]]), ("Point", [3, 5]))
    b = geoms(spark, u_shape).select(F.col("geom").alias("u"))
    out = a.crossJoin(b).select("id", g.within("geom", "u").alias("w")).orderBy("id").collect()
    assert [r.w for r in out] == [False, True, True, False]


def test_wkb_forms(spark):
    ring = [(0, 0), (1, 0), (1, 1), (0, 0)]
    flat = [v for p in ring for v in p]
    blobs = [
        struct.pack("<BIdd", 1, 1, 1.5, 2.5),
        struct.pack(">BIdd", 0, 1, 1.5, 2.5),
        struct.pack("<BIIdd", 1, 0x20000001, 4326, 1.5, 2.5),
        struct.pack("<BIddd", 1, 1001, 1.5, 2.5, 9.0),
        struct.pack("<BIII8d", 1, 3, 1, 4, *flat),
        struct.pack("<BII", 1, 6, 1) + struct.pack("<BIII8d", 1, 3, 1, 4, *flat),
        b"no",
    ]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "id int, b binary")
    out = rows.select("id", g.from_wkb(F.col("b")).alias("geom")).orderBy("id").collect()
    assert [r.geom.gtype if r.geom else None for r in out] == ["Point"] * 4 + ["Polygon", "MultiPolygon", None]
    assert all((r.geom.bbox.west, r.geom.bbox.south) == (1.5, 2.5) for r in out[:4])


def clip_ring(ring, box):
    """Half-plane cuts with plain Python, for comparison."""
    w, s, e, n = box
    for axis, bound, sign in ((0, w, 1), (0, e, -1), (1, s, 1), (1, n, -1)):
        out = []
        for p, q in zip(ring, ring[1:]):
            pin, qin = sign * (p[axis] - bound) >= 0, sign * (q[axis] - bound) >= 0
            if pin != qin:
                t = (bound - p[axis]) / (q[axis] - p[axis])
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            if qin:
                out.append(tuple(q))
        ring = out + out[:1]
    return ring


def ring_area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) / 2


def test_polygon_clip_areas(spark):
    rng = random.Random(11)
    rings = [star(rng, rng.randint(3, 10), 0.0, 0.0, 1.0) for _ in range(40)]
    box = (-0.3, -0.2, 0.5, 0.4)
    rows = geoms(spark, *[("Polygon", [r]) for r in rings]).withColumn("b", g.bbox(*[F.lit(v) for v in box]))
    out = rows.select("id", clip("geom", "b").alias("c")).select("id", g.area("c").alias("a")).collect()
    for r in out:
        assert abs((r.a or 0.0) - ring_area(clip_ring(rings[r.id], box))) < 1e-9


def test_line_clip_keeps_pieces_together(spark):
    rows = geoms(spark, ("LineString", [[-1, 0.5], [0.5, 0.5], [2, 0.5], [2, 0.7], [-1, 0.7]])).withColumn("b", g.bbox(*[F.lit(v) for v in (0, 0, 1, 1)]))
    out = rows.select(clip("geom", "b").alias("c")).select(g.to_geojson("c").alias("j")).collect()[0].j
    assert json.loads(out)["coordinates"] == [[[0, 0.5], [0.5, 0.5], [1, 0.5]], [[1, 0.7], [0, 0.7]]]


def test_squares_keep_points_and_get_equal_sides(spark):
    rows = geoms(spark, ("Polygon", [[[0, 0], [4, 0], [4, 1], [0, 1], [0, 0]]]), ("Point", [1, 1]), MULTI).withColumn("properties", F.expr("cast(map() as map<string,string>)"))
    out = regions.squarify(rows).orderBy("id").collect()
    b = out[0].geom.bbox
    assert (b.east - b.west, b.north - b.south) == (4.0, 4.0) and (b.west, b.south) == (0.0, -1.5)
    assert out[0].properties["_squarified"] == "true" and out[1].properties == {} and out[2].geom.gtype == "Polygon"


def test_parts_of_multi_polygon(spark):
    out = regions.polygon_parts(geoms(spark, MULTI, HOLED)).select("id", "part_id", "geom.gtype", F.size("geom.rings").alias("n")).orderBy("id", "part_id").collect()
    assert [tuple(r) for r in out] == [(0, 0, "Polygon", 1), (0, 1, "Polygon", 1), (1, 0, "Polygon", 2)]


def test_hexagons_tile_and_distance_is_symmetric(spark):
    c = spark.range(2000).select((F.rand(1) * 300000).alias("x"), (F.rand(2) * 300000).alias("y")).withColumn("c", hexgrid.cell_of_metres(F.col("x"), F.col("y"), F.lit(6)))
    q, r, res = F.col("c.q"), F.col("c.r"), F.lit(6)
    dx, dy = F.col("x") - hexgrid.center_x(q, r, res), F.col("y") - hexgrid.center_y(r, res)
    far = c.select(F.max(F.sqrt(dx * dx + dy * dy) / hexgrid.side(res)).alias("m")).collect()[0].m
    assert far <= 1.0 + 1e-9  # never farther than a corner
    back = c.withColumn("d", hexgrid.cell_of_metres(hexgrid.center_x(q, r, res), hexgrid.center_y(r, res), res))
    assert back.filter("c <> d").count() == 0
    two = [F.lit(v) for v in (3, -1, -2, 5)]
    row = spark.range(1).select(hexgrid.grid_distance(*two).alias("a"), hexgrid.grid_distance(*two[2:], *two[:2]).alias("b")).collect()[0]
    assert row.a == row.b == 6


def test_line_cover_is_connected(spark):
    lines = geoms(spark, ("LineString", [[-123, 39], [-122.9, 39.03], [-122.95, 39.1]]))
    cells = lines.select(hexgrid.line_cells("geom", 8).alias("c")).collect()[0].c
    steps = [max(abs(a.q - b.q), abs(a.r - b.r), abs(a.q + a.r - b.q - b.r)) for a, b in zip(cells, cells[1:])]
    assert len(cells) > 20 and set(steps) == {1} and len(set(cells)) == len(cells)


def test_cover_of_random_polygons(spark):
    rng = random.Random(3)
    rings = [star(rng, rng.randint(3, 9)) for _ in range(15)]
    rows = geoms(spark, *[("Polygon", [r]) for r in rings]).withColumn("m", hexgrid.metric_shape("geom"))
    out = rows.withColumn("res", hexgrid.cover_resolution("m", 9, 12)).withColumn("cells", hexgrid.cover_cells("m", "res")).collect()
    radius = 6378137.0

    def metres(p):
        return radius * math.radians(p[0]), radius * math.log(math.tan(math.pi / 4 + math.radians(p[1]) / 2))

    def brute(ring, res):
        s = hexgrid.SIDE0 / math.sqrt(7) ** res
        w = s * math.sqrt(3)
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        found = set()
        for r in range(math.floor(min(ys) / (1.5 * s)), math.ceil(max(ys) / (1.5 * s)) + 1):
            for q in range(math.floor(min(xs) / w - r / 2) - 1, math.ceil(max(xs) / w - r / 2) + 2):
                if inside(ring, w * (q + r / 2), 1.5 * s * r):
                    found.add((q, r))
        return found

    for row in out:
        ring = [metres(p) for p in rings[row.id]]
        res = next(k for k in range(9, -1, -1) if len(brute(ring, k)) <= 12)
        assert row.res == res and {(c.q, c.r) for c in row.cells} == brute(ring, res)


def test_tiny_polygon_has_no_cells(spark):
    from landstrata.operators.cells import cell_features, cover

    tiny = geoms(spark, ("Polygon", [[[0.0001, 0.0001], [0.0001001, 0.0001], [0.0001, 0.0001001], [0.0001, 0.0001]]])).withColumn("properties", F.expr("cast(map() as map<string,string>)"))
    row = cover(tiny).collect()[0]
    assert (row.res, row.cell_count, row.cells) == (11, 0, [])
    assert cell_features(tiny, "id").count() == 0


def test_lines_of_two_vertices_are_clipped_without_walking(spark):
    """Rows cut by arithmetic equal those cut by ``clip``: whole, crossing, touching, missing, flat and reversed lines."""
    rng = random.Random(5)
    lines = [[[rng.uniform(-1, 2), rng.uniform(-1, 2)], [rng.uniform(-1, 2), rng.uniform(-1, 2)]] for _ in range(200)]
    lines += [[[0.5, -1], [0.5, 2]], [[2, 0], [-1, 0]], [[1, 1], [2, 2]], [[0.2, 0.2], [0.2, 0.2]], [[0, 1], [1, 1]], [[-1, 2], [2, -1]], [[3, 3], [3, 3]]]
    more = [("LineString", [[-1, 0.5], [0.5, 0.5], [2, 0.5]]), ("Polygon", [[[-1, -1], [2, -1], [2, 0.5], [-1, -1]]]), ("Point", [0.5, 1])]
    rows = geoms(spark, *[("LineString", c) for c in lines], *more).withColumn("b", g.bbox(*[F.lit(float(v)) for v in (0, 0, 1, 1)]))
    want = {r.id: r.c for r in rows.select("id", clip("geom", "b").alias("c")).collect() if r.c is not None}
    out = clip_rows(rows, "geom", "b")
    assert {r.id: r.geom for r in out.collect()} == want and 50 < len(want) < 200
    measured = out.select(g.length("geom").alias("l"), "geom").collect()
    assert all(abs(r.l - math.dist(*[(p.x, p.y) for p in r.geom.rings[0].pts])) < 1e-12 for r in measured if r.geom.gtype == "LineString" and len(r.geom.rings[0].pts) == 2)
