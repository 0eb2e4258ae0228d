"""Exact joins by edges, contours as whole lines, line covers by segment, columnar WKB."""

import math
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from landstrata.functions import geometry as g
from landstrata.operators import cells, edge_join, raster
from landstrata.operators.spatial_join import spatial_pairs


def star(n, cx, cy, seed, r=1.0):
    """A polygon of n vertices around a centre."""
    rng = random.Random(seed)
    pts = [(cx + r * rng.uniform(0.5, 1) * math.cos(2 * math.pi * i / n), cy + r * rng.uniform(0.5, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return [[list(p) for p in [*pts, pts[0]]]]


def frame(spark, shapes):
    import json

    rows = [(i, json.dumps({"type": t, "coordinates": c})) for i, (t, c) in enumerate(shapes)]
    return spark.createDataFrame(rows, "id int, t string").select("id", g.parse_geojson("t").alias("geom"))


def mixed(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, kind = rng.randint(0, 12), rng.randint(0, 12), i % 6
        if kind == 0:
            out.append(("Polygon", star(rng.randint(3, 20), x, y, seed * 1000 + i, rng.choice([0.3, 1, 4]))))
        elif kind == 1:
            out.append(("LineString", [[x, y], [x + rng.randint(-3, 3), y + rng.randint(-3, 3)], [x + 1, y + 1]]))
        elif kind == 2:
            out.append(("Point", [x, y]))
        elif kind == 3:
            out.append(("Polygon", [[[x, y], [x + 4, y], [x + 4, y + 4], [x, y + 4], [x, y]], [[x + 1, y + 1], [x + 3, y + 1], [x + 3, y + 3], [x + 1, y + 3], [x + 1, y + 1]]]))
        elif kind == 4:
            out.append(("MultiPolygon", [star(4, x, y, seed + i, 1), star(5, x + 5, y, seed + i + 1, 1)]))
        else:
            out.append(("Polygon", [[[x, y], [x + 2, y], [x, y + 2], [x, y]]]))
    return out


def test_edges_give_the_pairs_of_the_plain_predicates(spark):
    a, b = frame(spark, mixed(1, 60)).cache(), frame(spark, mixed(2, 60)).cache()
    for predicate, find in (("intersects", edge_join.intersecting_ids), ("within", edge_join.ids_within)):
        plain = {(r.id, r.anno_id) for r in spatial_pairs(a, b, left_id="id", right_id="id", predicate=predicate).select("id", "anno_id").collect()}
        rows = find(a, b, "id", "id").collect()
        assert len(rows) == len({(r.l, r.r) for r in rows})
        assert {(r.l, r.r) for r in rows} == plain and len(plain) > 10
    joined = edge_join.exact_join(a, b, left_id="id", right_id="id", on=F.col("id") < 50)
    assert joined.columns == ["id", "geom", "anno_id", "anno_geom"] and joined.where("geom is null or id >= 50").count() == 0
    assert edge_join.intersecting_ids(a, b.limit(0), "id", "id").count() == 0


def test_triangles_by_corners_equal_the_plain_predicates(spark, monkeypatch):
    """Touching, equal, degenerate, both ways round, in a cell that is split, with more copies than a row holds."""
    monkeypatch.setattr(edge_join, "MEMBERS", 2)
    monkeypatch.setattr(edge_join, "HOT_TRIANGLES", 10)
    rng = random.Random(4)

    def triangles(n, size):
        out = []
        for _ in range(n):
            x, y = rng.randint(0, 5), rng.randint(0, 5)
            c = [[x + rng.randint(0, size), y + rng.randint(0, size)] for _ in range(3)]
            out += [("Polygon", [[*c, c[0]]])] * rng.choice([1, 1, 1, 5])
        return out

    a, b = frame(spark, triangles(60, 2)).cache(), frame(spark, triangles(60, 5)).cache()
    for predicate, find, walk in (("intersects", edge_join.intersecting_ids, "exists("), ("within", edge_join.ids_within, "forall(")):
        plain = {(r.id, r.anno_id) for r in spatial_pairs(a, b, left_id="id", right_id="id", predicate=predicate).select("id", "anno_id").collect()}
        rows = find(a, b, "id", "id").collect()
        assert len(rows) == len({(r.l, r.r) for r in rows})
        assert {(r.l, r.r) for r in rows} == plain and len(plain) > 100
        turn = F.expr("(geom.rings[0].pts[1].x - geom.rings[0].pts[0].x) * (geom.rings[0].pts[2].y - geom.rings[0].pts[0].y) <> (geom.rings[0].pts[1].y - geom.rings[0].pts[0].y) * (geom.rings[0].pts[2].x - geom.rings[0].pts[0].x)")
        only = find(a.where(turn), b.where(turn), "id", "id")
        assert walk not in only._jdf.queryExecution().optimizedPlan().toString()
        flat = {r.id for df in (a, b) for r in df.where(~turn).collect()}
        assert flat and only.count() > 50


def test_rings_of_many_vertices(spark, folder):
    def shape(x, r, n):
        """A wavy ring, written once."""
        angle = lambda i, k: i * (k * 2 * math.pi / n)
        wave = lambda i: F.lit(r) * (2 + F.cos(angle(i % n, 1001)))
        pts = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct((F.lit(x) + wave(i) * F.cos(angle(i % n, 1))).alias("x"), (wave(i) * F.sin(angle(i % n, 1))).alias("y")))
        path = f"{folder}/{x}-{r}-{n}"
        spark.range(1).select("id", g.from_rings(F.lit("Polygon"), F.array(F.struct(F.lit(False).alias("hole"), pts.alias("pts")))).alias("geom")).write.parquet(path)
        return spark.read.parquet(path)

    began = time.time()
    assert edge_join.intersecting_ids(shape(0.0, 1.0, 100_000), shape(1.5, 1.0, 100_000), "id", "id").count() == 1
    assert time.time() - began < 240
    small, large = shape(0.5, 1.0, 5000), shape(0.0, 10.0, 5000)
    assert edge_join.intersecting_ids(large, small, "id", "id").count() == 1  # wholly inside
    assert edge_join.ids_within(small, large, "id", "id").count() == 1


def test_rings_stay_out_of_the_cells(spark):
    a = frame(spark, mixed(3, 30))
    pairs = spatial_pairs(edge_join._boxes(a, "id", "geom", "l"), edge_join._boxes(a, "id", "geom", "r"), left_id="l", right_id="r", predicate="bbox")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "rings" not in line and "pts" not in line


def test_contours_are_whole_lines(spark):
    rng = random.Random(4)
    rows = [(r - 20, c - 33, math.sin(r / 5) * 20 + math.cos(c / 7) * 20 + rng.random()) for r in range(40) for c in range(70) if (r, c) != (9, 9)]
    pixels = spark.createDataFrame(rows, "row long, col long, value double").cache()
    segments = raster.contours(pixels, 5.0, tile=8).collect()
    # Components of the segments by plain search.
    at = {}
    for i, s in enumerate(segments):
        for p in ((s.x1, s.y1), (s.x2, s.y2)):
            at.setdefault((s.elevation, *p), []).append(i)
    group = {}
    for i in range(len(segments)):
        todo = [i] if i not in group else []
        while todo:
            j = todo.pop()
            if group.setdefault(j, i) != i or j != i and j in todo:
                continue
            s = segments[j]
            for p in ((s.x1, s.y1), (s.x2, s.y2)):
                todo += [k for k in at[(s.elevation, *p)] if k not in group]
    sizes = sorted([sum(1 for v in group.values() if v == x) for x in set(group.values())])
    results = []
    for tile, fanout in ((8, 2), (256, 8)):
        lines = raster.contour_lines(pixels, 5.0, tile=tile, fanout=fanout).collect()
        assert sorted(len(x.geom.rings[0].pts) - 1 for x in lines) == sizes
        drawn = sorted((x.elevation, *sorted([(p.x, p.y), (q.x, q.y)])) for x in lines for p, q in zip(x.geom.rings[0].pts, x.geom.rings[0].pts[1:]))
        assert drawn == sorted((s.elevation, *sorted([(s.x1, s.y1), (s.x2, s.y2)])) for s in segments)
        ends = [(x.elevation, p.x, p.y) for x in lines if not x.closed for p in (x.geom.rings[0].pts[0], x.geom.rings[0].pts[-1])]
        assert all(len(at[e]) == 1 for e in ends) and any(x.closed for x in lines)
        results.append(len(lines))
    assert len(set(results)) == 1
    assert raster.contour_lines(pixels.limit(0), 5.0).count() == 0
    layer = raster.contour_line_layer(pixels, 5.0, tile=8)
    assert layer.where("properties['elevation'] is null or geom.gtype <> 'LineString'").count() == 0


def test_line_cover_by_segment_equals_whole_paths(spark):
    rng = random.Random(6)
    shapes = [("LineString", [[rng.uniform(-1, 1), rng.uniform(-1, 1)] for _ in range(rng.randint(2, 9))]) for _ in range(40)] + [("MultiLineString", [[[0, 0], [1, 1]], [[1, 1], [0, 0]]]), ("Point", [0, 0])]
    df = frame(spark, shapes)
    want = {(r.id, r.c.q, r.c.r) for r in cells.each_cell(cells.cover(df, start=5, kind="linestring")).collect()}
    rows = cells.line_cover(df, ["id"], res=5).collect()
    assert len(rows) == len(want) and {(r.id, r.q, r.r) for r in rows} == want
    assert {(r.q, r.r) for r in cells.line_cover(df, [], res=5).collect()} == {w[1:] for w in want}


def test_a_line_of_many_vertices_is_walked_segment_by_segment(spark):
    n = 1_000_000
    pts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * (10.0 / n)).alias("x"), (F.sin(i * (60.0 / n)) * 2).alias("y")))
    one = spark.range(1).select("id", F.struct(F.lit("LineString").alias("gtype"), F.lit(False).alias("is_box"), g.bbox(F.lit(0.0), F.lit(-2.0), F.lit(10.0), F.lit(2.0)).alias("bbox"), F.array(F.struct(F.lit(False).alias("hole"), pts.alias("pts"))).alias("rings")).alias("geom"))
    covered = cells.line_cover(one, ["id"], res=7)
    assert 300 < covered.count() < 10_000


def test_wkb_by_columns(spark):
    rng = random.Random(8)
    flat = lambda pts: [v for p in pts for v in p]
    blobs, want = [], []
    for i in range(300):
        order, code = ("<", 1) if rng.random() < 0.7 else (">", 0)
        pts = [(rng.random(), rng.random()) for _ in range(rng.randint(0, 6))]
        kind = rng.choice(["line", "point", "polygon", "multi", "z", "bad", "null"])
        if kind == "line":
            blobs.append(struct.pack(f"{order}BII{2 * len(pts)}d", code, 2, len(pts), *flat(pts)))
            want.append(("LineString", [(False, pts)]))
        elif kind == "point":
            blobs.append(struct.pack(f"{order}BIdd", code, 1, 1.0, i))
            want.append(("Point", [(False, [(1.0, i)])]))
        elif kind == "polygon":
            blobs.append(struct.pack(f"{order}BII", code, 3, 2) + 2 * struct.pack(f"{order}I{2 * len(pts)}d", len(pts), *flat(pts)))
            want.append(("Polygon", [(False, pts), (True, pts)]))
        elif kind == "multi":
            blobs.append(struct.pack(f"{order}BII", code, 5, 1) + struct.pack(f"<BII{2 * len(pts)}d", 1, 2, len(pts), *flat(pts)))
            want.append(("MultiLineString", [(False, pts)]))
        elif kind == "z":
            blobs.append(struct.pack(f"{order}BII{3 * len(pts)}d", code, 1002, len(pts), *[v for p in pts for v in (*p, 9.0)]))
            want.append(("LineString", [(False, pts)]))
        elif kind == "bad":
            blobs.append(rng.choice([b"", b"x", struct.pack("<BII", 1, 2, 4_000_000_000), struct.pack("<BI", 1, 77), struct.pack("<BII", 1, 3, 5)]))
            want.append((None, None))
        else:
            blobs.append(None)
            want.append((None, None))
    import pyarrow as pa

    for array in (pa.array(blobs, pa.binary()), pa.array([b"pad", *blobs], pa.binary()).slice(1)):
        got = g._columns_of_wkb(array).to_pylist()
        assert [(r["gtype"], None if r["rings"] is None else [(x["hole"], [(p["x"], p["y"]) for p in x["pts"]]) for x in r["rings"]]) for r in got] == want
    assert g._columns_of_wkb(pa.array([], pa.binary())).to_pylist() == []
    big = struct.pack("<BII", 1, 2, 500_000) + struct.pack("<1000000d", *[float(i) for i in range(1_000_000)])
    began = time.time()
    out = g._columns_of_wkb(pa.array([big] * 4, pa.binary()))
    assert len(out) == 4 and time.time() - began < 2
    df = spark.createDataFrame([(bytearray(b) if b is not None else None,) for b in blobs], "b binary").select(g.from_wkb(F.col("b")).alias("geom"))
    assert [r.geom.gtype if r.geom else None for r in df.collect()] == [w[0] if w[1] else None for w in want]


@pytest.mark.parametrize("n", [0, 1])
def test_multi_edges_of_empty_sides(spark, n):
    a = frame(spark, [("Polygon", [[[0, 0], [4, 0], [0, 4], [0, 0]]])]).limit(n)
    assert edge_join.ids_within(a, a, "id", "id").count() == n


def test_boxes_are_asked_before_shapes_where_a_few_rows_meet_all(spark):
    lines = spark.range(2000).select(F.col("id"), g.line((F.col("id") % 50 / 7, F.col("id") % 31 / 5), (F.col("id") % 37 / 9, F.col("id") % 41 / 8)).alias("geom"))
    boxes = spark.range(4).select(F.col("id").alias("k"), g.box_polygon(F.col("id") + 0.01, F.lit(0.02), F.col("id") + 0.99, F.lit(2.03)).alias("geom"))
    pairs = spatial_pairs(lines, boxes, left_id="id", right_id="k", by_place=False)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    condition = plan.split("BroadcastNestedLoopJoin BuildRight, Inner, ", 1)[1].splitlines()[0]
    assert condition.index(".bbox.west <=") < condition.index("transform(")
    # Lines of two vertices are cut by arithmetic; with a third one on the way they are walked over.
    bent = lines.withColumn("geom", F.col("geom").withField("rings", F.transform("geom.rings", lambda p: p.withField("pts", F.concat(F.slice(p["pts"], 1, 1), p["pts"])))))
    walked = spatial_pairs(bent, boxes, left_id="id", right_id="k", by_place=False)
    assert sorted(map(tuple, pairs.select("id", "anno_k").collect())) == sorted(map(tuple, walked.select("id", "anno_k").collect()))
    assert pairs.count() > 100
