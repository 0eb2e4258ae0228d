"""Property rewrites, filters on properties, texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.derived import attr, box, check, lin, pts, r, reg, table
from landstrata.functions import text
from landstrata.functions.props import map_merge, props_from_columns, value_of
from landstrata.operators import alter as al
from landstrata.operators import labels, layers, profile
from landstrata.operators.regions import validate_boxes
from landstrata.plans import registry
from landstrata.sources import documents, geojson, vector


def prop(key: str):
    return value_of(F.col("properties"), key)


@check("canonicalize_first_present", "select o_orderkey, case when a_there then a else d end as t from attr")
def _(spark, sf):
    out = al.alter(attr(spark, sf), {"canonicalize": [{"to": "t", "from": ["a", "d"]}]})
    return out.select("o_orderkey", prop("t").alias("t"))


@check(
    "canonicalize_concat",
    """select o_orderkey, b || ' - ' || case when a_there then coalesce(a, 'NA') else '' end || ' - ' || coalesce(d, 'NA') as t
    from attr""",
)
def _(spark, sf):
    out = al.alter(attr(spark, sf), {"canonicalize": [{"to": "t", "concat": " - ", "from": ["b", "a", "d"]}]})
    return out.select("o_orderkey", prop("t").alias("t"))


@check("canonicalize_remove_prefix", "select o_orderkey, replace(a, 'PRIVATE GATED ', '') as t from attr")
def _(spark, sf):
    rule = {"to": "t", "from": ["a"], "remove_prefix": ["UNN", "PRIVATE", "GATED"]}
    return al.alter(attr(spark, sf), {"canonicalize": [rule]}).select("o_orderkey", prop("t").alias("t"))


@check(
    "canonicalize_remove_property",
    "select o_orderkey, cast(1 + cast(a_there as int) + cast(c_there as int) as bigint) as keys_left from attr",
)
def _(spark, sf):
    out = al.alter(attr(spark, sf), {"canonicalize": [{"to": "REMOVE", "from": ["b", "missing"]}]})
    return out.select("o_orderkey", F.size("properties").cast("bigint").alias("keys_left"))


@check(
    "canonicalize_default",
    """select o_orderkey, coalesce(case when a_there then a else d end, 'none') as t, case when c_there then c else null end as u,
    c_there as u_there from attr""",
)
def _(spark, sf):
    rules = [{"to": "t", "from": ["a", "d"], "default": "none"}, {"to": "u", "from": "c"}]
    out = al.alter(attr(spark, sf), {"canonicalize": rules})
    return out.select(
        "o_orderkey", prop("t").alias("t"), prop("u").alias("u"), F.map_contains_key("properties", "u").alias("u_there")
    )


@check(
    "width_by_attribute",
    """select coalesce(case c when '1-URGENT' then '6' when '5-LOW' then '3' end, '1') as width, count(*) as n
    from attr group by 1""",
)
def _(spark, sf):
    conf = {"vector_width": {"attribute": "c", "map": {"1-URGENT": 6, "5-LOW": 3}, "default": 1}}
    out = al.alter(attr(spark, sf), conf)
    return out.groupBy(prop("vector_width").alias("width")).agg(F.count(F.lit(1)).alias("n"))


@check("width_constant", "select o_orderkey, '2' as width, b from attr")
def _(spark, sf):
    return al.set_width(attr(spark, sf)).select(
        "o_orderkey", prop("vector_width").alias("width"), prop("b").alias("b")
    )


@check("filter_require", "select o_orderkey, d from attr where d in ('F', 'O')")
def _(spark, sf):
    out = al.filter_properties(attr(spark, sf), [["require", "d", ["F", "O"]]])
    return out.select("o_orderkey", prop("d").alias("d"))


@check("filter_remove", "select o_orderkey, d from attr where d is null or d not in ('F', '')")
def _(spark, sf):
    out = al.filter_properties(attr(spark, sf), [["remove", "d", ["F", ""]], ["remove", "b", []]])
    return out.select("o_orderkey", prop("d").alias("d"))


@check("filter_endswith", "select o_orderkey, a from attr where a like '%5' or a like '%10'")
def _(spark, sf):
    out = al.filter_properties(attr(spark, sf), [["endswith", "a", ["5", "10"]]])
    return out.select("o_orderkey", prop("a").alias("a"))


@check(
    "filters_see_rewritten_values",
    """select o_orderkey, replace(a, 'PRIVATE GATED ', '') as t, case c when '1-URGENT' then '6' else '1' end as width from attr
    where replace(a, 'PRIVATE GATED ', '') like '%7' and coalesce(c, '') <> '5-LOW'""",
)
def _(spark, sf):
    conf = {
        "canonicalize": [{"to": "t", "from": ["a"], "remove_prefix": ["PRIVATE", "GATED"]}],
        "vector_width": {"attribute": "c", "map": {"1-URGENT": 6}, "default": 1},
        "filter": [["endswith", "t", ["7"]], ["remove", "c", ["5-LOW"]]],
    }
    out = al.alter(attr(spark, sf), conf)
    return out.select("o_orderkey", prop("t").alias("t"), prop("vector_width").alias("width"))


@check("drop_system_fields", "select k as id, 'x' as kept, cast(1 as bigint) as n from (select o_orderkey as k from orders)")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn(
        "properties",
        F.create_map(
            F.lit("fid"), F.col("o_orderkey").cast("string"), F.lit("cat"), F.lit("1"), F.lit("gml_id"), F.lit("g"),
            F.lit("ogc_fid"), F.lit(None).cast("string"), F.lit("name"), F.lit("x"),
        ),
    )
    out = al.drop_system_fields(o.withColumn("id", F.lit(0)))
    return out.select(F.col("o_orderkey").alias("id"), prop("name").alias("kept"), F.size("properties").cast("bigint").alias("n"))


@check("prefix_columns", "select p_partkey as anno_p_partkey, p_type as anno_p_type, p_size as anno_p_size from part")
def _(spark, sf):
    return al.prefix_columns(table(spark, sf, "part").select("p_partkey", "p_type", "p_size"), "anno_")


@check("exclude_columns", "select * exclude (p_name, p_retailprice) from part")
def _(spark, sf):
    return table(spark, sf, "part").drop("p_name", "p_retailprice")


@check(
    "struct_and_list_access",
    """select p_name as primary_name, p_brand as surface, count(*) as n from part where p_name like '%ring%' group by 1, 2""",
)
def _(spark, sf):
    p = table(spark, sf, "part").select(
        F.struct(F.col("p_name").alias("primary")).alias("names"), F.array(F.struct(F.col("p_brand").alias("value"))).alias("road_surface")
    )
    chosen = p.filter(F.col("names.primary").like("%ring%"))
    return profile.count_by(
        chosen, F.col("names.primary").alias("primary_name"), F.try_element_at("road_surface", F.lit(1))["value"].alias("surface")
    )


@check(
    "nested_path_lookup",
    """select event_id, json_extract_string(props, '$.k') as k, cast(null as varchar) as missing from events""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    deep = F.concat(F.lit('{"a":'), F.col("props"), F.lit("}"))
    return e.select("event_id", text.leaf(deep, ["a", "k"]).alias("k"), text.leaf(deep, ["a", "x", "k"]).alias("missing"))


@check(
    "canonical_name",
    r"""select p_partkey, regexp_replace(trim(lower(p_brand || '  ' || p_name || ' ')), '\s+', '_', 'g') as name from part""",
)
def _(spark, sf):
    raw = F.concat("p_brand", F.lit("  "), "p_name", F.lit(" "))
    return table(spark, sf, "part").select("p_partkey", text.canonical_name(raw).alias("name"))


@check(
    "degree_minutes",
    """select p_partkey, round(39 + cast(substr(lpad(cast(p_partkey % 1000 as varchar), 3, '0'), 1, 2) || '.' ||
    substr(lpad(cast(p_partkey % 1000 as varchar), 3, '0'), 3) as double) / 60, 6) as lat from part""",
)
def _(spark, sf):
    t = F.concat(F.lit("39."), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"))
    return table(spark, sf, "part").select("p_partkey", r(text.degree_minutes(t)).alias("lat"))


@check(
    "location_text",
    """select event_id, case when event_id % 7 in (5, 6) then null else round(case event_id % 7 when 1 then
      cast(39 as double) + cast(event_id % 60 as double) / 60 + 0 else y end, 6) end as lat,
    case when event_id % 7 in (5, 6) then null else round(case event_id % 7 when 1 then
      -(cast(123 as double) + cast(event_id % 60 as double) / 60 + cast(event_id % 59 as double) / 3600) else x end, 6) end as lng
    from pts""",
)
def _(spark, sf):
    k, x, y = F.col("event_id"), F.format_string("%.4f", "x"), F.format_string("%.4f", "y")
    whole = lambda c: c.cast("string")
    forms = (
        F.when(k % 7 == 0, F.concat(F.lit("https://www.google.com/maps/@"), y, F.lit(","), x, F.lit(",15z")))
        .when(
            k % 7 == 1,
            F.concat(
                F.lit("39°"), whole(k % 60), F.lit("′0″ N  123°"), whole(k % 60), F.lit("′"), whole(k % 59), F.lit("″ W")
            ),
        )
        .when(k % 7 == 2, F.concat(F.lit("https://maps.google.com/?q="), y, F.lit(","), x))
        .when(k % 7 == 3, F.concat(F.lit('{"latitude": '), y, F.lit(', "longitude": '), x, F.lit("}")))
        .when(k % 7 == 4, F.concat(F.lit(" "), y, F.lit(" , "), x))
        .when(k % 7 == 5, F.lit("https://maps.app.goo.gl/abc"))
        .otherwise(F.lit("no place"))
    )
    out = pts(spark, sf).select("event_id", text.location(forms).alias("l"))
    return out.select("event_id", r("l.lat").alias("lat"), r("l.lng").alias("lng"))


@check(
    "valid_coordinates",
    """select event_id, coalesce(value between -90 and 90 and x between -180 and 180, false) as ok from pts""",
)
def _(spark, sf):
    return pts(spark, sf).select("event_id", text.valid_coordinates(F.col("value"), F.col("x")).alias("ok"))


@check(
    "apply_option",
    """select o_orderkey, coalesce(case d when 'F' then '7' when 'O' then '3' end, null) as width, coalesce(d, '~') as d from attr""",
)
def _(spark, sf):
    options = [{"d": "F", "vector_width": 7}, {"d": "O", "vector_width": 3}]
    out = al.apply_option(attr(spark, sf), "d", options)
    return out.select("o_orderkey", prop("vector_width").alias("width"), F.coalesce(prop("d"), F.lit("~")).alias("d"))


@check(
    "declared_columns",
    """select o_orderkey, case when a_there then a else 'unnamed' end as a, 'dirt' as surface, '4' as width, b from attr""",
)
def _(spark, sf):
    declared = [
        {"name": "a", "default": "unnamed"},
        {"name": "surface", "options": [{"surface": "dirt", "width": 4}, {"surface": "paved", "width": 8}]},
    ]
    out = al.fill_declared(attr(spark, sf), declared)
    return out.select("o_orderkey", *[prop(k).alias(k) for k in ("a", "surface", "width", "b")])


@check(
    "synthetic_labels",
    """select o_orderkey, coalesce(nullif(d, ''), 'orders_' || cast(row_number() over (order by o_orderkey) as varchar)) as d from attr""",
)
def _(spark, sf):
    out = labels.fill_labels(attr(spark, sf), "d", "orders", "o_orderkey")
    return out.select("o_orderkey", prop("d").alias("d"))


@check(
    "positional_relabel",
    """select o_orderkey, case when c_there then c else 'camp_' || cast(row_number() over (order by o_orderkey) - 1 as varchar) end as c from attr""",
)
def _(spark, sf):
    out = labels.fill_labels(attr(spark, sf), "c", "camp", "o_orderkey", start=0, blank_only=False)
    return out.select("o_orderkey", prop("c").alias("c"))


@check(
    "validate_box_records",
    """with t as (select p_partkey, cast(p_size as double) as z, cx, cy, p_partkey % 8 as m from box),
    v as (select p_partkey, m, case when m = 1 then 95.0 else cy + z / 100 end as n, case when m = 2 then cy + z else cy end as s,
      case when m = 3 then -190.0 when m = 5 then cx + 30 else cx + z / 100 end as e, case when m = 4 then cx + z else cx end as w from t)
    select case when m = 6 then 'missing' when m = 7 then 'not a number' when s not between -90 and 90 or n not between -90 and 90 then 'latitude range'
      when w not between -180 and 180 or e not between -180 and 180 then 'longitude range' when s >= n then 'latitude order'
      when w >= e then 'longitude order' when e - w > 20 or n - s > 20 then 'too big' end as reject_reason, count(*) as n from v group by 1""",
)
def _(spark, sf):
    b = box(spark, sf)
    m, z = F.col("p_partkey") % 8, F.col("p_size").cast("double")
    cx, cy = F.col("cx"), F.col("cy")
    records = b.select(
        F.when(m == 6, None).when(m == 1, "95.0").otherwise((cy + z / 100).cast("string")).alias("north"),
        F.when(m == 2, cy + z).otherwise(cy).cast("string").alias("south"),
        F.when(m == 3, F.lit(-190.0)).when(m == 5, cx + 30).otherwise(cx + z / 100).cast("string").alias("east"),
        F.when(m == 7, F.lit("west")).otherwise(F.when(m == 4, cx + z).otherwise(cx).cast("string")).alias("west"),
    )
    return validate_boxes(records).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@check(
    "record_to_properties",
    """select s_suppkey, s_name as name, cast(s_nationkey as varchar) as nation, cast(3 as bigint) as n from supplier""",
)
def _(spark, sf):
    s = table(spark, sf, "supplier").withColumn("properties", props_from_columns(["s_suppkey", "s_name", "s_nationkey"]))
    return s.select(
        "s_suppkey", prop("s_name").alias("name"), prop("s_nationkey").alias("nation"), F.size("properties").cast("bigint").alias("n")
    )


@check("class_in_list", "select p_partkey, p_type from part where p_type in ('ECONOMY', 'PROMO')")
def _(spark, sf):
    return table(spark, sf, "part").filter(F.col("p_type").isin("ECONOMY", "PROMO")).select("p_partkey", "p_type")


@check("not_equal_drops_null", "select o_orderkey, d from attr where d <> 'F'")
def _(spark, sf):
    d = prop("d")
    return attr(spark, sf).filter(d != "F").select("o_orderkey", d.alias("d"))


@check("named_rows", "select name, k from reg where name in ('NATION_3', 'NATION_17')")
def _(spark, sf):
    return registry.named(reg(spark, sf), ["NATION_3", "NATION_17"]).select("name", "k")


@check(
    "symbol_flag",
    "select o_orderkey, coalesce(d = 'F', false) as filled, c = '1-URGENT' as urgent from attr",
)
def _(spark, sf):
    return attr(spark, sf).select(
        "o_orderkey",
        F.coalesce(prop("d") == "F", F.lit(False)).alias("filled"),
        (prop("c") == "1-URGENT").alias("urgent"),
    )


@check("label_present", "select o_orderkey, d from attr where d is not null and d <> ''")
def _(spark, sf):
    d = prop("d")
    return attr(spark, sf).filter(labels.has_label(d)).select("o_orderkey", d.alias("d"))


@check("sample_one_in_five", "select event_id from events where event_id % 5 = 0")
def _(spark, sf):
    return labels.sample_by_id(table(spark, sf, "events"), "event_id").select("event_id")


@check(
    "label_once_by_least_id",
    """select d, min(o_orderkey) as o_orderkey from attr where d is not null and d <> '' group by d""",
)
def _(spark, sf):
    df = attr(spark, sf).withColumn("d", prop("d"))
    return labels.one_per_value(df, "d", "o_orderkey").select("d", "o_orderkey")


@check(
    "label_blank_repeats",
    """select o_orderkey, case when d is null or d = '' then d when o_orderkey = min(o_orderkey) over (partition by d) then d end as d from attr""",
)
def _(spark, sf):
    df = attr(spark, sf).withColumn("d", prop("d"))
    return labels.blank_repeats(df, "d", "o_orderkey").select("o_orderkey", "d")


@check(
    "label_cap_per_layer",
    """select event_type, event_id from (select *, row_number() over (partition by event_type order by event_id) as n from events) where n <= 20""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id")
    return labels.cap(e, "event_id", 20, ["event_type"])


@check(
    "dedupe_by_key",
    "select source, min(doc_id) as doc_id from documents group by source",
)
def _(spark, sf):
    return layers.deduplicate(table(spark, sf, "documents"), "doc_id", ["source"]).select("source", "doc_id")


@check("dedupe_whole_record", "select text, lang, min(doc_id) as doc_id from documents group by text, lang")
def _(spark, sf):
    return layers.deduplicate(table(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id")


@check(
    "first_feature_fields_per_layer",
    """select source as layer, lang, cast(doc_id as varchar) as id, cast(null as varchar) as missing from (
    select *, row_number() over (partition by source order by doc_id) as n from documents) where n = 1""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("source").alias("layer"), F.col("doc_id").alias("pos"),
        F.to_json(F.struct(F.struct("lang", F.struct(F.col("doc_id").alias("id")).alias("deep")).alias("properties"))).alias("feature"),
    )
    fields = {"lang": ["properties", "lang"], "id": ["properties", "deep", "id"], "missing": ["properties", "cat"]}
    return profile.first_of_layers(d, fields)


@check(
    "document_metadata",
    r"""select 'doc' || cast(doc_id as varchar) || '.v1' as name, '.' || lang as file_type, 's3a://bucket/in/doc' || cast(doc_id as varchar) || '.v1.' || lang as image_path,
    cast(41.5 as double) as north, cast(-73.5 as double) as west from documents""",
)
def _(spark, sf):
    files = table(spark, sf, "documents").select(
        F.concat(F.lit("s3a://bucket/in/doc"), F.col("doc_id").cast("string"), F.lit(".v1."), F.col("lang")).alias("path")
    )
    out = documents.document_rows(files, {"north": 41.5, "south": 41.0, "east": -73.0, "west": -73.5})
    return out.select("name", "file_type", "image_path", F.col("corners.north").alias("north"), F.col("corners.west").alias("west"))


@check(
    "map_merge_over",
    """select o_orderkey, b, coalesce(nullif(d, ''), 'was') as d, cast(3 as bigint) + cast(a is not null as bigint) + cast(c_there as bigint) as n from attr""",
)
def _(spark, sf):
    from landstrata.functions.props import truthy_only

    base = F.create_map(F.lit("d"), F.lit("was"), F.lit("z"), F.lit("1"))
    out = attr(spark, sf).withColumn("properties", map_merge(base, truthy_only(F.col("properties"))))
    # Nulls and empty text never overwrite, so a null "a" adds no key.
    return out.select("o_orderkey", prop("b").alias("b"), prop("d").alias("d"), F.size("properties").cast("bigint").alias("n"))


@check(
    "sheet_import",
    """select cast(p_partkey as varchar) as id, p_name as name, 'Point' as kind, round(cx, 6) as x, round(cy, 6) as y from box""",
)
def _(spark, sf):
    rows = box(spark, sf).select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"),
        F.concat(F.lit('{"type":"Point","coordinates":['), F.col("cx").cast("string"), F.lit(","), F.col("cy").cast("string"), F.lit("]}")).alias("geometry"),
    )
    out = vector.sheet_features(rows)
    b = F.col("geom.bbox")
    return out.select(prop("id").alias("id"), prop("name").alias("name"), F.col("geom.gtype").alias("kind"), r(b["west"]).alias("x"), r(b["south"]).alias("y"))


@check(
    "sheet_export",
    """select coalesce(a, case when a_there then '' else '' end) as a, b, coalesce(c, '') as c, coalesce(d, '') as d,
    '{"type":"Point","coordinates":[' || cast(o_orderkey as varchar) || '.0,0.0]}' as geometry from attr""",
)
def _(spark, sf):
    from landstrata.functions.geometry import point
    from landstrata.sources.store import export_sheet

    return export_sheet(attr(spark, sf).withColumn("geom", point(F.col("o_orderkey"), F.lit(0.0))))


@check(
    "coordinate_list_scan",
    """select p_name as name, round(39 + cast(substr(m, 1, 2) || '.' || substr(m, 3) as double) / 60, 6) as lat,
    round(-(123 + cast(substr(m, 1, 2) || '.' || substr(m, 3) as double) / 60), 6) as lon
    from (select p_name, lpad(cast(p_partkey % 6000 as varchar), 4, '0') as m from part)""",
)
def _(spark, sf):
    m = F.lpad((F.col("p_partkey") % 6000).cast("string"), 4, "0")
    lines = table(spark, sf, "part").select(F.concat(F.lit("  39."), m, F.lit("\t123."), m, F.lit("\t"), "p_name").alias("value"))
    b = F.col("geom.bbox")
    return vector.coordinate_features(lines).select(prop("name").alias("name"), r(b["south"]).alias("lat"), r(b["west"]).alias("lon"))


@check(
    "map_node_scan",
    """select event_id, round(x, 6) as x, round(y, 6) as y from pts where event_type = 'click' and x between -123.8 and -123.2 and y between 39.1 and 39.6""",
)
def _(spark, sf):
    nodes = pts(spark, sf).select(
        F.col("event_id").alias("id"), F.col("x").alias("lon"), F.col("y").alias("lat"),
        F.create_map(
            F.when(F.col("event_type") == "click", F.lit("natural")).otherwise(F.lit("amenity")), F.lit("tree"),
            F.lit("ref"), F.col("event_id").cast("string"),
        ).alias("tags"),
    )
    out = vector.map_nodes(nodes, "natural", {"west": -123.8, "east": -123.2, "south": 39.1, "north": 39.6})
    b = F.col("geom.bbox")
    return out.select(prop("ref").cast("bigint").alias("event_id"), r(b["west"]).alias("x"), r(b["south"]).alias("y"))


@check(
    "geojson_collection_scan",
    """select cast(event_id as varchar) as id, event_type as kind, cast(value as varchar) as value, round(x, 6) as x, round(y, 6) as y from pts""",
)
def _(spark, sf):
    p = pts(spark, sf)
    feature = F.concat(
        F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":['), F.col("x").cast("string"), F.lit(","), F.col("y").cast("string"),
        F.lit(']},"properties":'), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value")), F.lit("}"),
    )
    text_ = F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit("]}"))
    parsed = p.select(F.from_json(text_, geojson.COLLECTION).alias("fc")).select("fc.*")
    b = F.col("geom.bbox")
    return geojson.features_of(parsed).select(
        prop("id").alias("id"), prop("kind").alias("kind"), prop("value").alias("value"), r(b["west"]).alias("x"), r(b["south"]).alias("y")
    )


@check(
    "upload_payload_scan",
    """select o_orderstatus as layer, case when o_orderkey % 2 = 0 then 'create' else 'annotate' end as action, count(*) as features,
    count(case when o_orderkey % 3 = 0 then 1 end) as zero_values from orders group by 1, 2""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    payload = F.concat(
        F.lit('{"layer":"'), F.col("o_orderstatus"), F.lit('","action":"'), F.when(k % 2 == 0, "create").otherwise("annotate"),
        F.lit('","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"v":'), (k % 3).cast("string"), F.lit(',"s":"0"}}]}'),
    )
    parsed = table(spark, sf, "orders").select(F.from_json(payload, geojson.COLLECTION).alias("p")).select("p.*")
    rows = geojson.features_of(parsed, ["layer", "action"])
    return rows.groupBy("layer", "action").agg(
        F.count(F.lit(1)).alias("features"), F.count(F.when(F.array_contains("falsy_keys", "v"), 1)).alias("zero_values")
    )


@check(
    "delta_file_names",
    """select o_orderpriority as asset, o_orderdate as ts, case when o_orderkey % 11 = 0 then 'delete' when o_orderkey % 5 = 0 then 'annotate' else 'create' end as action,
    count(*) as n from orders group by 1, 2, 3""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    act = F.when(k % 11 == 0, "delete").when(k % 5 == 0, "annotate").otherwise("create")
    name = F.concat(
        F.lit("in/roads/"), F.col("o_orderpriority"), F.lit("__"), F.date_format(F.col("o_orderdate"), "yyyyMMdd_HHmmss"), F.lit("__"), act, F.lit(".geojson")
    )
    out = layers.check_actions(table(spark, sf, "orders").select(layers.delta_name_parts(name).alias("p")).select("p.*"))
    return out.groupBy("asset", F.col("ts").cast("timestamp_ntz").alias("ts"), "action").agg(F.count(F.lit(1)).alias("n"))


@check(
    "latest_raster_batch",
    """select row_, col_, value from (select event_id // 500 as row_, event_id % 100 as col_, value, cast(ts as date) as d, event_type from events) t
    where d = (select max(cast(ts as date)) from events e where e.event_type = t.event_type)""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select(
        F.floor(F.col("event_id") / 500).alias("row_"), (F.col("event_id") % 100).alias("col_"), "value", "event_type", F.to_date("ts").alias("ts")
    )
    return layers.latest_batch(e, ["event_type"]).select("row_", "col_", "value")


@check("query_result_json", """select '{"p_partkey":' || cast(p_partkey as varchar) || ',"p_type":"' || p_type || '","none":null}' as value from part""")
def _(spark, sf):
    from landstrata.sources.store import result_text

    return result_text(table(spark, sf, "part").select("p_partkey", "p_type", F.lit(None).cast("string").alias("none")), "json")


@check(
    "geojson_features_out",
    """select '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[' || cast(ax as varchar) || ',' || cast(ay as varchar) || '],[' || cast(bx as varchar) || ',' || cast("by" as varchar) ||
    ']]},"properties":{"flag":"' || l_returnflag || '","none":null}}' as value from lin""",
)
def _(spark, sf):
    from landstrata.sources.store import feature_text

    props = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("none"), F.lit(None).cast("string"))
    return feature_text(lin(spark, sf).withColumn("properties", props))
