"""Spatial joins, layers from deltas, regions, geometry functions."""

from __future__ import annotations

from datetime import datetime
from uuid import uuid4

from pyspark.sql import functions as F

from checks.derived import box, check, delta, lin, pts, r, reg, table, tri
from landstrata.functions import crs, geometry as g
from landstrata.functions.clip import clip
from landstrata.functions.props import value_of
from landstrata.operators import annotate as an
from landstrata.operators import layers, profile, regions
from landstrata.operators.alter import add_links
from landstrata.operators.edge_join import ids_within, intersecting_ids
from landstrata.operators.spatial_join import spatial_join, spatial_pairs
from landstrata.plans import registry, sql as plan_sql
from landstrata.session import checkpoint_dir
from landstrata.sources import deltas
from landstrata.sources.store import LayerStore
from landstrata.sources.vector import clip_scan, world_filter
from landstrata.streaming import apply

IDS = {"left_id": "event_id", "right_id": "p_partkey"}
EXTENT = {"west": -124.0, "south": 39.0, "east": -123.0, "north": 40.0}


def prop(key: str):
    return value_of(F.col("properties"), key)


def count():
    return F.count(F.lit(1))


@check(
    "spatial_inner_join",
    "select p_type, event_type, count(*) as pairs, cast(sum(p_size) as bigint) as size_sum, round(sum(value), 2) as value_sum from pib group by 1, 2",
)
def spatial_inner_join(spark, sf):
    p = pts(spark, sf).select("event_id", "event_type", "value", "geom")
    b = box(spark, sf).select("p_partkey", "p_type", "p_size", "geom")
    pairs = spatial_pairs(p, b, **IDS)
    return pairs.groupBy(F.col("anno_p_type").alias("p_type"), "event_type").agg(
        count().alias("pairs"), F.sum("anno_p_size").alias("size_sum"), r(F.sum("value"), 2).alias("value_sum")
    )


@check(
    "spatial_left_join",
    "select event_id, p_partkey from pib union all select event_id, null from pts where event_id not in (select event_id from pib)",
)
def _(spark, sf):
    out = spatial_join(pts(spark, sf).select("event_id", "geom"), box(spark, sf).select("p_partkey", "geom"), "left", **IDS)
    return out.select("event_id", F.col("anno_p_partkey").alias("p_partkey"))


@check("spatial_anti_join", "select p_partkey from box where p_partkey not in (select p_partkey from pib)")
def spatial_anti_join(spark, sf):
    b = box(spark, sf).select("p_partkey", "geom")
    out = an.unannotated(b, pts(spark, sf), left_id="p_partkey", right_id="event_id")
    return out.select("p_partkey")


@check("spatial_semi_join", "select distinct event_id from pib")
def _(spark, sf):
    out = spatial_join(pts(spark, sf).select("event_id", "geom"), box(spark, sf).select("p_partkey", "geom"), "left_semi", **IDS)
    return out.select("event_id")


def _features(spark, sf):
    p = pts(spark, sf)
    props = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("note"), F.lit("old"))
    return p.select(F.col("event_id").alias("feature_id"), "geom", props.alias("properties"))


def _annotations(spark, sf):
    b = box(spark, sf)
    note = F.when(F.col("p_partkey") % 3 == 0, F.lit("")).when(F.col("p_partkey") % 3 == 1, F.col("p_type"))
    return b.select(
        F.col("p_partkey").alias("feature_id"), "geom",
        F.create_map(F.lit("note"), note, F.lit("brand"), F.col("p_brand")).alias("properties"),
    )


def _annotated(df):
    return df.select("feature_id", *[prop(k).alias(k) for k in ("kind", "note", "brand")])


@check(
    "annotate_last_wins",
    """with best as (select event_id, arg_max(p_brand, p_partkey) as brand, arg_max(p_type, p_partkey) filter (where p_partkey % 3 = 1) as note
        from pib group by 1)
    select event_id as feature_id, event_type as kind, coalesce(b.note, 'old') as note, b.brand as brand
    from pts left join best b using (event_id)""",
)
def annotate_last_wins(spark, sf):
    return _annotated(an.annotate(_features(spark, sf), _annotations(spark, sf)))


@check(
    "annotate_duplicates",
    """select event_id as feature_id, event_type as kind, case when p_partkey % 3 = 1 then p_type else 'old' end as note, p_brand as brand from pib
    union all select event_id, event_type, 'old', null from pts where event_id not in (select event_id from pib)""",
)
def _(spark, sf):
    return _annotated(an.annotate(_features(spark, sf), _annotations(spark, sf), multi="duplicate"))


@check(
    "annotate_chosen_properties",
    """with best as (select event_id, max(p_partkey) as p_partkey from pib group by 1)
    select event_id as feature_id, event_type as kind, 'old' as note, p_brand as brand
    from pts left join best using (event_id) left join part b using (p_partkey)""",
)
def _(spark, sf):
    return _annotated(an.annotate(_features(spark, sf), _annotations(spark, sf), updated=["brand"]))


@check(
    "annotate_by_property",
    """with a as (select s_nationkey, max(s_suppkey) as s_suppkey from supplier group by 1)
    select c_custkey as feature_id, s_name as supplier from customer left join a on c_nationkey = s_nationkey left join supplier using (s_suppkey)""",
)
def _(spark, sf):
    props = lambda *kv: F.create_map(*[x for k, v in kv for x in (F.lit(k), F.col(v).cast("string"))]).alias("properties")
    nowhere = g.point(F.lit(0.0), F.lit(0.0)).alias("geom")
    feats = table(spark, sf, "customer").select(F.col("c_custkey").alias("feature_id"), nowhere, props(("nation", "c_nationkey")))
    annos = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("feature_id"), nowhere, props(("home", "s_nationkey"), ("supplier", "s_name")))
    out = an.annotate(feats, annos, match="property", property_match={"nation": "home"})
    return out.select("feature_id", prop("supplier").alias("supplier"))


@check(
    "annotate_by_property_and_place",
    """with best as (select event_id, max(p_partkey) as p_partkey from pib where (p_size % 5) = (event_id % 5) group by 1)
    select event_id as feature_id, p_brand as brand from pts left join best using (event_id) left join part using (p_partkey)""",
)
def _(spark, sf):
    f = _features(spark, sf).withColumn("properties", F.create_map(F.lit("m"), (F.col("feature_id") % 5).cast("string")))
    b = box(spark, sf).select(
        F.col("p_partkey").alias("feature_id"), "geom",
        F.create_map(F.lit("k"), (F.col("p_size") % 5).cast("string"), F.lit("brand"), F.col("p_brand")).alias("properties"),
    )
    out = an.annotate(f, b, match="both", property_match={"m": "k"})
    return out.select("feature_id", prop("brand").alias("brand"))


@check(
    "nearest_match",
    """select event_id, p_partkey, dist from (select event_id, p_partkey, round(sqrt((x - (w + e) / 2) * (x - (w + e) / 2) + (y - (s + n) / 2) * (y - (s + n) / 2)), 6) as dist,
    row_number() over (partition by event_id order by sqrt((x - (w + e) / 2) * (x - (w + e) / 2) + (y - (s + n) / 2) * (y - (s + n) / 2)), p_partkey) as k
    from pts join box on x between w and e and y between s and n) where k = 1""",
)
def _(spark, sf):
    out = an.one_partner(pts(spark, sf).select("event_id", "geom"), box(spark, sf).select("p_partkey", "geom"), **IDS)
    return out.select("event_id", F.col("anno_p_partkey").alias("p_partkey"), r("dist").alias("dist"))


@check(
    "farthest_match",
    """select event_id, p_partkey from (select event_id, p_partkey,
    rank() over (partition by event_id order by sqrt((x - (w + e) / 2) * (x - (w + e) / 2) + (y - (s + n) / 2) * (y - (s + n) / 2)) desc) as k
    from pts join box on x between w and e and y between s and n) where k = 1""",
)
def _(spark, sf):
    out = an.one_partner(pts(spark, sf).select("event_id", "geom"), box(spark, sf).select("p_partkey", "geom"), pick="farthest", **IDS)
    return out.select("event_id", F.col("anno_p_partkey").alias("p_partkey"))


@check(
    "polygon_overlap_join",
    "select a.p_partkey as a, b.p_partkey as b from box a join box b on a.w <= b.e and b.w <= a.e and a.s <= b.n and b.s <= a.n where a.p_partkey < b.p_partkey",
)
def _(spark, sf):
    b = box(spark, sf).select("p_partkey", "geom")
    pairs = spatial_pairs(b, b, left_id="p_partkey", right_id="p_partkey", on=F.col("p_partkey") < F.col("anno_p_partkey"))
    return pairs.select(F.col("p_partkey").alias("a"), F.col("anno_p_partkey").alias("b"))


@check(
    "point_in_triangle_join",
    """select event_id, p_partkey from pts join box on x between w and e and y between s and n
    where (x - w) + (y - s) <= (e - w) - cast(1e-9 as double)""",
)
def _(spark, sf):
    pairs = spatial_pairs(pts(spark, sf).select("event_id", "x", "y", "geom"), tri(spark, sf).select("p_partkey", "w", "s", "e", "geom"), **IDS)
    # Points on the slanted edge are left to rounding and not compared.
    clear = (F.col("x") - F.col("anno_w")) + (F.col("y") - F.col("anno_s")) <= (F.col("anno_e") - F.col("anno_w")) - 1e-9
    return pairs.filter(clear).select("event_id", F.col("anno_p_partkey").alias("p_partkey"))


@check(
    "line_box_intersections",
    """with t as (select l_orderkey, l_linenumber, l_suppkey, l_partkey, k, ax, ay, bx - ax as dx, "by" - ay as dy, w, e, s, n
      from lin join reg on least(ax, bx) <= e and greatest(ax, bx) >= w and least(ay, "by") <= n and greatest(ay, "by") >= s),
    u as (select *, case when dx = 0 then 0 when dx > 0 then (w - ax) / dx else (e - ax) / dx end as ex, case when dx = 0 then 1 when dx > 0 then (e - ax) / dx else (w - ax) / dx end as lx,
      case when dy = 0 then 0 when dy > 0 then (s - ay) / dy else (n - ay) / dy end as ey, case when dy = 0 then 1 when dy > 0 then (n - ay) / dy else (s - ay) / dy end as ly from t)
    select k, count(*) as segments from u where least(1, lx, ly) - greatest(0, ex, ey) > cast(1e-9 as double) group by k""",
)
def _(spark, sf):
    lines = lin(spark, sf).withColumn("id", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    b = F.col("anno_geom.bbox")
    pairs = spatial_pairs(lines.select("id", "ax", "ay", "bx", "by", "geom"), reg(spark, sf).select("k", "geom"), left_id="id", right_id="k")
    # A touch of a corner or an end is left to rounding and not compared.
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    part = lambda d, lo, hi, a, zero: F.when(d == 0, F.lit(zero)).when(d > 0, F.try_divide(lo - a, d)).otherwise(F.try_divide(hi - a, d))
    enter = F.greatest(F.lit(0.0), part(dx, b["west"], b["east"], F.col("ax"), 0.0), part(dy, b["south"], b["north"], F.col("ay"), 0.0))
    leave = F.least(F.lit(1.0), part(dx, b["east"], b["west"], F.col("ax"), 1.0), part(dy, b["north"], b["south"], F.col("ay"), 1.0))
    return pairs.filter(leave - enter > 1e-9).groupBy(F.col("anno_k").alias("k")).agg(count().alias("segments"))


def _corners(spark, sf, factor: int, size: int, south_west: bool):
    """Right triangles on parts, all coordinates multiples of 2**-12 and so exact: at one corner (cx, cy), legs of p_size / ``size``."""
    p = table(spark, sf, "part")
    at = lambda m: (F.col("p_partkey") * m % 4096) / F.lit(4096.0)
    cx, cy, leg = at(4231 + factor), at(3011 + factor), F.col("p_size") / F.lit(float(size))
    far_x, far_y = (cx + leg, cy + leg) if south_west else (cx - leg, cy - leg)
    xy = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(xy(cx, cy), xy(far_x, cy), xy(cx, far_y), xy(cx, cy))
    box_of = g.bbox(F.least(cx, far_x), F.least(cy, far_y), F.greatest(cx, far_x), F.greatest(cy, far_y))
    geom = F.struct(F.lit("Polygon").alias("gtype"), F.lit(False).alias("is_box"), box_of.alias("bbox"), F.array(F.struct(F.lit(False).alias("hole"), ring.alias("pts"))).alias("rings"))
    return p.select("p_partkey", geom.alias("geom"))


def _corner_view(factor: int, size: int) -> str:
    return f"select p_partkey, cast(p_partkey * {4231 + factor} % 4096 as double) / 4096 as x, cast(p_partkey * {3011 + factor} % 4096 as double) / 4096 as y, cast(p_size as double) / {size} as leg from part"


@check(
    "polygon_pairs_general",
    f"""with a as ({_corner_view(0, 1024)}), b as ({_corner_view(7, 1024)})
    select a.p_partkey as a, b.p_partkey as b from a join b on a.x <= b.x and a.y <= b.y and greatest(a.x + a.y, b.x + b.y - b.leg) <= least(a.x + a.y + a.leg, b.x + b.y)""",
)
def _(spark, sf):
    """Triangles south-west of their long side against triangles north-east of theirs; what only touches counts."""
    a, b = _corners(spark, sf, 0, 1024, True), _corners(spark, sf, 7, 1024, False)
    return intersecting_ids(a, b, "p_partkey", "p_partkey").select(F.col("l").alias("a"), F.col("r").alias("b"))


@check(
    "within_triangles",
    f"""with a as ({_corner_view(0, 4096)}), b as ({_corner_view(7, 256)})
    select a.p_partkey as a, b.p_partkey as b from a join b on a.x >= b.x and a.y >= b.y and a.x + a.y + a.leg <= b.x + b.y + b.leg""",
)
def _(spark, sf):
    """Small triangles in large ones, those that touch the large one's sides from inside too."""
    a, b = _corners(spark, sf, 0, 4096, True), _corners(spark, sf, 7, 256, True)
    return ids_within(a, b, "p_partkey", "p_partkey").select(F.col("l").alias("a"), F.col("r").alias("b"))


@check(
    "boxes_within_regions",
    "select k, count(*) as boxes from box join reg on box.w >= reg.w and box.e <= reg.e and box.s >= reg.s and box.n <= reg.n group by k",
)
def _(spark, sf):
    pairs = spatial_pairs(
        box(spark, sf).select("p_partkey", "geom"), reg(spark, sf).select("k", "geom"), left_id="p_partkey", right_id="k", predicate="within"
    )
    return pairs.groupBy(F.col("anno_k").alias("k")).agg(count().alias("boxes"))


@check(
    "region_layer_extract",
    """select name as region, 'boxes' as layer, count(*) as features, round(sum((least(box.e, reg.e) - greatest(box.w, reg.w)) * (least(box.n, reg.n) - greatest(box.s, reg.s))), 6) as area
      from box join reg on box.w < reg.e and box.e > reg.w and box.s < reg.n and box.n > reg.s group by 1
    union all select name, 'points', count(*), 0 from pts join reg on x between w and e and y between s and n group by 1""",
)
def region_layer_extract(spark, sf):
    b = box(spark, sf).select(F.lit("boxes").alias("layer"), F.concat(F.lit("b"), F.col("p_partkey")).alias("feature_id"), "geom")
    p = pts(spark, sf).select(F.lit("points").alias("layer"), F.concat(F.lit("p"), F.col("event_id")).alias("feature_id"), "geom")
    cut = regions.region_extract(b.unionByName(p), reg(spark, sf))
    return cut.groupBy("region", "layer").agg(count().alias("features"), r(F.sum(g.area("geom")), 6).alias("area"))


@check(
    "region_line_extract",
    """with t as (select k, ax, ay, bx - ax as dx, "by" - ay as dy, w, e, s, n
      from lin join reg on least(ax, bx) <= e and greatest(ax, bx) >= w and least(ay, "by") <= n and greatest(ay, "by") >= s),
    u as (select *, case when dx = 0 then 0 when dx > 0 then (w - ax) / dx else (e - ax) / dx end as ex, case when dx = 0 then 1 when dx > 0 then (e - ax) / dx else (w - ax) / dx end as lx,
      case when dy = 0 then 0 when dy > 0 then (s - ay) / dy else (n - ay) / dy end as ey, case when dy = 0 then 1 when dy > 0 then (n - ay) / dy else (s - ay) / dy end as ly from t)
    select k, round(sum(greatest(0, least(1, lx, ly) - greatest(0, ex, ey)) * sqrt(dx * dx + dy * dy)), 4) as length from u group by k""",
)
def _(spark, sf):
    lines = lin(spark, sf).withColumn("id", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).select("id", "geom")
    cut = regions.region_extract(lines, reg(spark, sf).select(F.col("k").alias("name"), "geom"), feature_id="id")
    return cut.groupBy(F.col("region").alias("k")).agg(r(F.sum(g.length("geom")), 4).alias("length"))


@check(
    "clip_triangles",
    """select p_partkey, round((case when p_partkey % 2 = 0 then cast(0.375 as double) else cast(0.25 as double) end) * (e - w) * (n - s), 8) as area from box""",
)
def _(spark, sf):
    # The south-west triangle cut at the middle: by its west half, or by its south-west quarter.
    t = tri(spark, sf)
    mx, my = (F.col("w") + F.col("e")) / 2, (F.col("s") + F.col("n")) / 2
    top = F.when(F.col("p_partkey") % 2 == 0, F.col("n")).otherwise(my)
    cut = t.withColumn("b", g.bbox(F.col("w"), F.col("s"), mx, top)).withColumn("c", clip("geom", "b"))
    return cut.select("p_partkey", r(g.area("c"), 8).alias("area"))


@check("assign_regions", "select p_partkey, string_agg(name, ',' order by name) as regions from box left join reg on box.w <= reg.e and box.e >= reg.w and box.s <= reg.n and box.n >= reg.s group by 1")
def _(spark, sf):
    out = an.assign_regions(box(spark, sf).select("p_partkey", "geom"), reg(spark, sf), "p_partkey")
    names = F.when(F.size("regions") > 0, F.concat_ws(",", "regions"))
    return out.select("p_partkey", names.alias("regions"))


@check("points_per_region", "select name as region, event_type as layer, count(*) as n from pts join reg on x between w and e and y between s and n group by 1, 2")
def _(spark, sf):
    pairs = spatial_pairs(pts(spark, sf).select("event_id", "event_type", "geom"), reg(spark, sf).select("name", "geom"), left_id="event_id", right_id="name")
    return pairs.groupBy(F.col("anno_name").alias("region"), F.col("event_type").alias("layer")).agg(count().alias("n"))


@check("features_per_layer", "select event_type as layer, count(*) as n from events group by 1")
def _(spark, sf):
    return pts(spark, sf).groupBy(F.col("event_type").alias("layer")).agg(count().alias("n"))


@check(
    "visible_layers",
    """select region, layer, count(*) as n from (select name as region, k, event_type as layer from pts join reg on x between w and e and y between s and n)
    where case when k % 3 = 0 then layer in ('error', 'view') else layer in ('click', 'view', 'signup') end group by 1, 2""",
)
def _(spark, sf):
    rg = reg(spark, sf)
    pairs = spatial_pairs(pts(spark, sf).select("event_id", "event_type", "geom"), rg.select("name", "geom"), left_id="event_id", right_id="name")
    rows = pairs.select(F.col("anno_name").alias("region"), F.col("event_type").alias("layer"))
    own = rg.filter(F.col("k") % 3 == 0).select(F.col("name").alias("region"), F.explode(F.array(F.lit("error"), F.lit("view"))).alias("layer"))
    out = regions.visible_layers(rows, ["click", "view", "signup"], own)
    return out.groupBy("region", "layer").agg(count().alias("n"))


@check("bbox_strict_containment", "select p_partkey from box where w > cast(-123.8 as double) and e < cast(-123.2 as double) and s > cast(39.1 as double) and n < cast(39.7 as double)")
def _(spark, sf):
    return clip_scan(box(spark, sf), {"west": -123.8, "east": -123.2, "south": 39.1, "north": 39.7}).select("p_partkey")


@check("world_rows_in_bbox", "select p_partkey, p_type from box where w > cast(-123.8 as double) and e < cast(-123.2 as double) and s > cast(39.1 as double) and n < cast(39.7 as double) and p_type <> 'PROMO'")
def _(spark, sf):
    b = box(spark, sf)
    world = b.withColumn("bbox", F.struct(*[F.col(a).alias(c) for a, c in (("w", "xmin"), ("e", "xmax"), ("s", "ymin"), ("n", "ymax"))]))
    return world_filter(world, {"west": -123.8, "east": -123.2, "south": 39.1, "north": 39.7}, F.col("p_type") != "PROMO").select("p_partkey", "p_type")


@check("geometry_type_filter", "select kind, count(*) as n from (select 'Point' as kind from pts union all select 'Polygon' from box) group by kind")
def _(spark, sf):
    everything = pts(spark, sf).select("geom").unionByName(box(spark, sf).select("geom")).unionByName(lin(spark, sf).select("geom"))
    return registry.geometry_type(everything, "Point", "Polygon").groupBy(F.col("geom.gtype").alias("kind")).agg(count().alias("n"))


@check("features_with_geometry", "select event_id from events where event_id % 3 <> 0")
def _(spark, sf):
    p = pts(spark, sf)
    x = F.when(F.col("event_id") % 3 != 0, F.col("x"))
    return registry.with_geometry(p.withColumn("geom", g.point(x, F.col("y")))).select("event_id")


@check(
    "centroid_of_polygons",
    "select p_partkey, round(w + (e - w) / 3, 6) as x, round(s + (n - s) / 3, 6) as y from box",
)
def _(spark, sf):
    c = tri(spark, sf).withColumn("c", g.centroid("geom"))
    return c.select("p_partkey", r("c.x").alias("x"), r("c.y").alias("y"))


@check('centroid_of_lines', 'select l_returnflag, round(sum((ax + bx) / 2), 2) as x, round(sum((ay + "by") / 2), 2) as y from lin group by 1')
def _(spark, sf):
    c = lin(spark, sf).withColumn("c", g.centroid("geom"))
    return c.groupBy("l_returnflag").agg(r(F.sum("c.x"), 2).alias("x"), r(F.sum("c.y"), 2).alias("y"))


@check(
    "centroid_distance",
    'select l_returnflag, round(sum(sqrt((ax - bx) * (ax - bx) + (ay - "by") * (ay - "by"))), 4) as d from lin group by 1',
)
def _(spark, sf):
    ends = lin(spark, sf).select("l_returnflag", *[F.struct(F.col(f"{e}x").alias("x"), F.col(f"{e}y").alias("y")).alias(e) for e in "ab"])
    return ends.groupBy("l_returnflag").agg(r(F.sum(g.distance("a", "b")), 4).alias("d"))


@check(
    "envelope_expanded",
    "select p_partkey, round(w - cast(0.0002 as double), 6) as w, round(s - cast(0.0002 as double), 6) as s, round(e + cast(0.0002 as double), 6) as e, round(n + cast(0.0002 as double), 6) as n, cast(5 as bigint) as vertices from box",
)
def _(spark, sf):
    out = box(spark, sf).select("p_partkey", F.col("geom.bbox").alias("bb")).withColumn("g", g.envelope("bb", 0.0002))
    b = F.col("g.bbox")
    return out.select(
        "p_partkey", r(b["west"]).alias("w"), r(b["south"]).alias("s"), r(b["east"]).alias("e"), r(b["north"]).alias("n"),
        F.size(F.col("g.rings")[0]["pts"]).cast("bigint").alias("vertices"),
    )


@check(
    "bbox_corners_ring_center",
    """select p_partkey, round(w, 6) as x0, round(n, 6) as y0, round(e, 6) as x2, round(s, 6) as y2, cast(5 as bigint) as ring, round((w + e) / 2, 6) as cx, round((s + n) / 2, 6) as cy,
    round(w, 6) as back_w, round(n, 6) as back_n from box""",
)
def _(spark, sf):
    out = box(spark, sf).select("p_partkey", F.col("geom.bbox").alias("bb"))
    out = out.withColumns({"c": g.corners("bb"), "ring": g.closed_ring("bb"), "m": g.bbox_center("bb")}).withColumn("back", g.ring_bbox("ring"))
    c = F.col("c")
    return out.select(
        "p_partkey", r(c[0]["x"]).alias("x0"), r(c[0]["y"]).alias("y0"), r(c[2]["x"]).alias("x2"), r(c[2]["y"]).alias("y2"),
        F.size("ring").cast("bigint").alias("ring"), r("m.x").alias("cx"), r("m.y").alias("cy"), r("back.west").alias("back_w"), r("back.north").alias("back_n"),
    )


@check(
    "reproject_mercator",
    """select event_id, round(cast(6378137 as double) * radians(x), 3) as mx, round(cast(6378137 as double) * ln(tan(pi() / 4 + radians(y) / 2)), 3) as my, round(x, 6) as x, round(y, 6) as y from pts""",
)
def _(spark, sf):
    out = pts(spark, sf).withColumn("m", crs.reproject("geom", "EPSG:4269", "EPSG:3857"))
    out = out.withColumn("back", crs.reproject("m", "EPSG:3857", "EPSG:4326"))
    return out.select(
        "event_id", r("m.bbox.west", 3).alias("mx"), r("m.bbox.north", 3).alias("my"), r("back.bbox.east").alias("x"), r("back.bbox.south").alias("y")
    )


@check(
    "squarify_polygons",
    """select p_partkey, round(e - w, 6) as square_size, round((e - w) / 2, 6) as original_width, round(e - w, 6) as original_height,
    round(cx - (e - w) / 4 - (e - w) / 2, 6) as w, round(s, 6) as s from box""",
)
def _(spark, sf):
    b = box(spark, sf)
    half = b.withColumn("geom", g.box_polygon(F.col("w"), F.col("s"), F.col("cx"), F.col("n"))).withColumn("properties", F.expr("cast(map() as map<string,string>)"))
    out = regions.squarify(half)
    n = lambda k: r(prop(k).cast("double"))
    bb = F.col("geom.bbox")
    return out.select(
        "p_partkey", n("_square_size").alias("square_size"), n("_original_width").alias("original_width"), n("_original_height").alias("original_height"),
        r(bb["west"]).alias("w"), r(bb["south"]).alias("s"),
    )


@check(
    "fit_to_frame",
    "select p_partkey, round(cx - (n - s) * cast(1.5 as double) / 2, 6) as w, round(s, 6) as s, round(cx + (n - s) * cast(1.5 as double) / 2, 6) as e, round(n, 6) as n from box",
)
def _(spark, sf):
    out = box(spark, sf).select("p_partkey", F.col("geom.bbox").alias("bb")).withColumn("f", regions.fit_frame("bb", 300, 200))
    return out.select("p_partkey", r("f.west").alias("w"), r("f.south").alias("s"), r("f.east").alias("e"), r("f.north").alias("n"))


@check(
    "web_tile_counts",
    """select cast(floor(4096 * (0.5 + x / 360)) as bigint) as tx, cast(floor(4096 * (1 - ln(tan(radians(y)) + 1 / cos(radians(y))) / pi()) / 2) as bigint) as ty, count(*) as n from pts group by 1, 2""",
)
def _(spark, sf):
    out = pts(spark, sf).withColumn("t", crs.web_tile(F.col("x"), F.col("y"), 12))
    return out.groupBy(F.col("t.x").alias("tx"), F.col("t.y").alias("ty")).agg(count().alias("n"))


@check(
    "pixel_bin_density",
    """select px, py, count(*) as n from (select cast(trunc((x + 124) / 1 * 400) as bigint) as px, cast(trunc((40 - y) / 1 * 300) as bigint) as py from pts)
    where px - 8 >= 0 and py - 8 >= 0 and px - 8 + 16 <= 400 and py - 8 + 16 <= 300 group by 1, 2""",
)
def _(spark, sf):
    out = pts(spark, sf).withColumn("p", crs.pixel_bin(F.col("x"), F.col("y"), EXTENT, 400, 300, 16)).filter("p is not null")
    return out.groupBy(F.col("p.px").alias("px"), F.col("p.py").alias("py")).agg(count().alias("n"))


@check(
    "map_grid_counts",
    """with c as (select cast(floor((x + 124) / cast(0.125 as double)) as bigint) as gx, cast(floor((40 - y) / cast(0.125 as double)) as bigint) as gy from pts)
    select cast(gx + 1 as varchar) || '_' || chr(cast(65 + gy as integer)) as name, case when gy > 0 then cast(gx + 1 as varchar) || '_' || chr(cast(64 + gy as integer)) end as north_name,
    case when gx < 7 then cast(gx + 2 as varchar) || '_' || chr(cast(65 + gy as integer)) end as east_name, count(*) as n from c where gx between 0 and 7 and gy between 0 and 7 group by 1, 2, 3""",
)
def _(spark, sf):
    grid = regions.map_grid(spark, EXTENT, 8)
    named = pts(spark, sf).withColumn("name", regions.grid_cell(F.col("x"), F.col("y"), EXTENT, 8)).filter("name is not null")
    return named.groupBy("name").agg(count().alias("n")).join(grid, "name").select("name", "north_name", "east_name", "n")


@check("layer_extent", "select p_type, round(min(w), 6) as west, round(min(s), 6) as south, round(max(e), 6) as east, round(max(n), 6) as north from box group by 1")
def _(spark, sf):
    out = regions.extent(box(spark, sf), keys=["p_type"])
    return out.select("p_type", *[r(c).alias(c) for c in ("west", "south", "east", "north")])


@check(
    "overview_extent",
    """select round((w + e) / 2 - greatest(e - w, n - s) * cast(0.9 as double), 6) as west, round((s + n) / 2 - greatest(e - w, n - s) * cast(0.9 as double), 6) as south
    from (select min(x) as w, max(x) as e, min(y) as s, max(y) as n from pts)""",
)
def _(spark, sf):
    return regions.overview_extent(regions.extent(pts(spark, sf))).select(r("west").alias("west"), r("south").alias("south"))


@check(
    "circular_links",
    """select event_id, event_type, coalesce(lag(event_id) over o, max(event_id) over (partition by event_type)) as prev, coalesce(lead(event_id) over o, min(event_id) over (partition by event_type)) as next
    from events window o as (partition by event_type order by event_id)""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    return regions.link_neighbors(e, "event_id", "event_id", ["event_type"])


@check(
    "regions_from_polygons",
    """with c as (select p_partkey, lower(replace(p_name, ' ', '_')) as name, p_name as caption, 'Region ' || cast(p_partkey as varchar) as text, round(w, 6) as west, round(n, 6) as north from box where p_partkey >= 2)
    select *, coalesce(lag(name) over (order by p_partkey), last_value(name) over (order by p_partkey rows between unbounded preceding and unbounded following)) as prev,
    coalesce(lead(name) over (order by p_partkey), first_value(name) over (order by p_partkey rows between unbounded preceding and unbounded following)) as next from c""",
)
def _(spark, sf):
    f = box(spark, sf).withColumn("properties", F.create_map(F.lit("Description"), F.col("p_name")))
    out = regions.load_regions(f, "p_partkey", start_at=2)
    return out.select(
        "p_partkey", "name", "caption", "text", r("bbox.west").alias("west"), r("bbox.north").alias("north"),
        F.col("neighbors")["prev"].alias("prev"), F.col("neighbors")["next"].alias("next"),
    )


@check("region_slice", "select event_id from events where event_id >= 2 and event_id < 3 + 700")
def _(spark, sf):
    return regions.slice_rows(table(spark, sf, "events"), "event_id", start_at=2, limit=703).select("event_id")


@check("webmap_links", """select event_id, 'http://m/staging/outlets/webmap/?lat=' || cast(y as varchar) || '&lng=' || cast(x as varchar) || '&zoom=17' as url from pts""")
def _(spark, sf):
    p = pts(spark, sf).withColumn("properties", F.create_map(F.lit("k"), F.col("event_type")))
    return add_links(p, "http://m").select("event_id", prop("webmap_url").alias("url"))


_CHANGES = """with c as (select k, ts, lpad(cast(k as varchar), 12, '0') as file, x, y, cast(k as varchar) as name from delta where action = 'create'),
    a as (select k, ts, lpad(cast(k as varchar), 12, '0') as file, x, y, action, case when k % 2 = 0 then 'n' || cast(k as varchar) end as note, o_orderstatus as who from delta where action <> 'create'),
    m as (select c.k, a.k as ak, a.action, a.note, a.who, a.ts, a.file from c join a on c.x between a.x - cast(0.004 as double) and a.x + cast(0.004 as double)
      and c.y between a.y - cast(0.004 as double) and a.y + cast(0.004 as double) and (a.ts > c.ts or (a.ts = c.ts and a.file > c.file)))"""


_LAYER = f"""{_CHANGES},
    n as (select k, note from (select k, note, row_number() over (partition by k order by ts desc, file desc) as i from m where action = 'annotate' and note is not null) where i = 1),
    w as (select k, who from (select k, who, row_number() over (partition by k order by ts desc, file desc) as i from m where action = 'annotate') where i = 1)
    select name as feature_id, name, note, who as "by" from c left join n using (k) left join w using (k) where k not in (select k from m where action = 'delete')"""


@check(
    "layer_from_deltas",
    _LAYER,
)
def layer_from_deltas(spark, sf):
    out = layers.apply_deltas(None, delta(spark, sf))
    return out.select("feature_id", *[prop(k).alias(k) for k in ("name", "note", "by")])


def _store(spark):
    return LayerStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/check-store-{uuid4().hex}")


# The same layer as from all deltas at once, from batches that come in no order of time, compacted in between.
@check("replay_equals_refresh", _LAYER)
def _(spark, sf):
    store, d = _store(spark), delta(spark, sf)
    for i in (2, 0, 1):
        apply.apply_batch(store, d.filter(F.pmod(F.xxhash64("file"), F.lit(3)) == i), i, str(i), late="merge")
        if i == 0:
            store.compact("places")
    return store.read("places").select("feature_id", *[prop(k).alias(k) for k in ("name", "note", "by")])


@check("published_version", "select k, event_type as kind from pts join (select event_id as k from events) on event_id = k")
def _(spark, sf):
    """A version keeps the layer as it was when it was published."""
    store = _store(spark)
    p = pts(spark, sf).select(F.col("event_id").alias("k"), F.col("event_type").alias("kind"))
    store.write("points", p)
    store.publish("20250101_000000")
    store.write("points", p.filter("k % 2 = 0"))
    store.clear("points")
    store.publish("20250102_000000")
    return store.read_version("points", back=1)


@check("appended_log", "select feature_id, count(*) as n from (select cast(k as varchar) as feature_id from delta union all select cast(k as varchar) from delta where action = 'create') group by 1")
def _(spark, sf):
    """Two batches of a layer and one of another in a log; the first layer's come back whole."""
    log, d = f"{checkpoint_dir(spark).rstrip('/')}/check-log-{uuid4().hex}", delta(spark, sf)
    at = datetime(2025, 1, 1)
    deltas.append_to_log(d, log, "places", "create", at=at)
    deltas.append_to_log(d.filter("action = 'create'"), log, "places", "annotate", at=at)
    deltas.append_to_log(d, log, "elsewhere", "create", at=at)
    return deltas.read_log(spark, log, "places").groupBy("feature_id").agg(count().alias("n"))


@check("keys_of_a_layer", f"{_CHANGES} select 'name' as key union select 'by' from m where action = 'annotate' union select 'note' from m where action = 'annotate' and note is not null")
def _(spark, sf):
    """The property keys that commits keep: of features, and of annotations that meet one."""
    store, d = _store(spark), delta(spark, sf)
    apply.apply_batch(store, d.filter("action = 'create'"), 0, late="merge")
    apply.apply_batch(store, d.filter("action <> 'create'"), 1, late="merge")
    return spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in store.keys("places")])).alias("key"))


@check(
    "refresh_layer_with_links",
    f"""{_CHANGES} select name as feature_id, '/staging/outlets/webmap/?lat=' || cast(y as varchar) || '&lng=' || cast(x as varchar) || '&zoom=17' as url from c
    where k not in (select k from m where action = 'delete')""",
)
def _(spark, sf):
    return registry.refresh_layer(delta(spark, sf)).select("feature_id", prop("webmap_url").alias("url"))


@check("create_is_bag_union", "select cast(k as varchar) as feature_id, n from (select k, count(*) as n from (select k from delta where action = 'create' union all select k from delta where action = 'create') group by k)")
def _(spark, sf):
    d = delta(spark, sf).filter(F.col("action") == "create").select("feature_id", "geom", "properties", "ts", "file", "pos")
    return layers.bag_union(d, d).groupBy("feature_id").agg(count().alias("n"))


@check("overwrite_from_pending", f"{_CHANGES} select name as feature_id from c where k not in (select k from m where action = 'delete')")
def _(spark, sf):
    """A layer overwritten by all that is pending: creates, annotations and deletes in one queue."""
    return layers.apply_deltas(None, delta(spark, sf)).select("feature_id")


@check("delete_by_id", "select event_id from events where event_id not in (select o_orderkey from orders where o_orderstatus = 'F')")
def _(spark, sf):
    gone = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return layers.remove_features(table(spark, sf, "events"), gone, "event_id").select("event_id")


@check("sheet_upsert", "select c_custkey as id, c_name as name from customer where c_custkey not in (select s_suppkey from supplier) union all select s_suppkey, s_name from supplier")
def _(spark, sf):
    layer = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    sheet = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return layers.upsert(layer, sheet, feature_id="id")


@check("gathered_sources", "select source, count(*) as n from (select 'parts' as source from part union all select 'events' from events) group by 1")
def _(spark, sf):
    both = layers.gather({"parts": box(spark, sf).select("geom"), "events": pts(spark, sf).select("geom")})
    return both.groupBy("source").agg(count().alias("n"))


@check("deltas_in_time_order", "select cast(k as varchar) as feature_id, cast(row_number() over (order by ts, lpad(cast(k as varchar), 12, '0')) as bigint) as n from delta")
def _(spark, sf):
    return layers.in_time_order(delta(spark, sf)).select("feature_id", "n")


@check("version_choice", "select version from (select distinct strftime(o_orderdate, '%Y%m%d_%H%M%S') as version from orders) order by version desc limit 1 offset 1")
def _(spark, sf):
    versions = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyyMMdd_HHmmss").alias("version"))
    return layers.choose_version(versions, back=1)


@check(
    "sql_over_layers",
    """select p_type as class, count(*) as n from box where w > cast(-123.8 as double) and e < cast(-123.2 as double) and s > cast(39.1 as double) and n < cast(39.7 as double) group by 1""",
)
def _(spark, sf):
    f = box(spark, sf).select(F.col("p_partkey").alias("feature_id"), "geom", F.create_map(F.lit("class"), F.col("p_type")).alias("properties"))
    plan_sql.register_layer(f, "check_buildings", ["class"])
    query = "select class, count(*) as n from check_buildings where west > :west and east < :east and south > :south and north < :north group by class"
    return plan_sql.run_query(spark, query, plan_sql.bbox_args({"west": -123.8, "east": -123.2, "south": 39.1, "north": 39.7}))


@check(
    "sql_spatial_functions",
    """select event_type, count(*) as n, round(sum(sqrt((x - cast(-123.5 as double)) * (x - cast(-123.5 as double)) + (y - cast(39.5 as double)) * (y - cast(39.5 as double)))), 4) as d
    from pts where x between cast(-123.75 as double) and cast(-123.25 as double) and y between cast(39.25 as double) and cast(39.75 as double) group by 1""",
)
def _(spark, sf):
    plan_sql.register_functions(spark)
    pts(spark, sf).select("event_type", "geom").createOrReplaceTempView("check_points")
    return plan_sql.run_query(
        spark,
        """select event_type, count(*) as n, round(sum(st_pointdistance(st_centroid(geom), named_struct('x', -123.5D, 'y', 39.5D))), 4) as d
        from check_points where st_intersects(geom, st_makeenvelope(-123.75, 39.25, -123.25, 39.75)) group by event_type""",
    )


@check("count_by_keys", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2")
def _(spark, sf):
    return profile.count_by(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")
