import pytest
from pyspark.sql import functions as F

from landstrata.functions import text
from landstrata.functions.props import value_of
from landstrata.operators import alter as al
from landstrata.operators import annotate as an
from landstrata.operators import labels, layers, regions
from landstrata.functions import geometry as g


def one(spark, props):
    entries = ", ".join(f"'{k}', {'cast(null as string)' if v is None else repr(v)}" for k, v in props.items())
    return spark.sql(f"select cast(map({entries}) as map<string,string>) as properties")


def altered(spark, props, conf):
    rows = al.alter(one(spark, props), conf).collect()
    return rows[0].properties if rows else None


def test_present_null_stops_the_search(spark):
    conf = {"canonicalize": [{"to": "name", "from": ["a", "b"]}]}
    assert altered(spark, {"a": None, "b": "x"}, conf) == {"a": None, "b": "x"}
    assert altered(spark, {"b": "x"}, conf) == {"b": "x", "name": "x"}


def test_no_value_keeps_the_old_target_and_default_replaces_it(spark):
    assert altered(spark, {"t": "old", "a": None}, {"canonicalize": [{"to": "t", "from": ["a"]}]}) == {"t": "old", "a": None}
    got = altered(spark, {"t": "old"}, {"canonicalize": [{"to": "t", "from": ["a"], "default": "d"}]})
    assert got == {"t": "d"}


def test_rename_then_remove(spark):
    conf = {"canonicalize": [{"to": "name", "from": ["old_name"]}, {"to": "REMOVE", "from": ["old_name"]}]}
    assert altered(spark, {"old_name": "n", "k": "1"}, conf) == {"k": "1", "name": "n"}


def test_concat_reads_missing_as_empty_and_null_as_na(spark):
    conf = {"canonicalize": [{"to": "t", "from": ["n", "name", "z"], "concat": " - "}]}
    assert altered(spark, {"n": "1", "name": "Test Point", "z": None}, conf)["t"] == "1 - Test Point - NA"
    assert altered(spark, {"n": "1"}, conf)["t"] == "1 -  - "


def test_prefixes_go_in_list_order(spark):
    conf = {"canonicalize": [{"to": "t", "from": ["a"], "remove_prefix": ["PRIVATE", "UNN", "GATED"]}]}
    assert altered(spark, {"a": "PRIVATE  GATED Elm"}, conf)["t"] == "Elm"
    assert altered(spark, {"a": "GATED PRIVATE Elm"}, conf)["t"] == "PRIVATE Elm"
    assert altered(spark, {"a": " PRIVATE Elm"}, conf)["t"] == " PRIVATE Elm"


def test_a_bare_source_is_one_key(spark):
    assert altered(spark, {"elevation": "5.0"}, {"canonicalize": [{"to": "name", "from": "elevation"}]})["name"] == "5.0"


def test_widths(spark):
    conf = {"vector_width": {"attribute": "type", "map": {"RD": 6}, "default": 1}}
    assert [altered(spark, p, conf)["vector_width"] for p in ({"type": "RD"}, {"type": "X"}, {"type": None}, {"k": "1"})] == ["6", "1", "1", "1"]


def test_filters_on_null_and_missing(spark):
    keep = lambda props, rule: altered(spark, props, {"filter": [rule]}) is not None
    for props in ({"k": "1"}, {"a": None}):
        assert not keep(props, ["require", "a", ["x"]])
        assert keep(props, ["remove", "a", ["x"]])
        assert not keep(props, ["endswith", "a", ["x"]])
    assert keep({"a": "x"}, ["remove", "a", []]) and not keep({"a": "x"}, ["require", "a", []])
    assert keep({"a": "5"}, ["require", "a", [5]])


def test_unknown_names_are_errors(spark):
    with pytest.raises(ValueError):
        al.alter(one(spark, {"a": "1"}), {"filter": [["equals", "a", ["1"]]]})
    with pytest.raises(ValueError):
        al.alter(one(spark, {"a": "1"}), {"equals": []})
    with pytest.raises(ValueError):
        an.annotate(one(spark, {"a": "1"}), one(spark, {"a": "1"}), match="close")


def test_location_forms(spark):
    cases = {
        "https://www.google.com/maps/@37.7749,-122.4194,15z": (37.7749, -122.4194),
        "https://maps.google.com/maps?q=37.7749,-122.4194": (37.7749, -122.4194),
        "40°14′18″ N  123°57′39″ W": (40 + 14 / 60 + 18 / 3600, -(123 + 57 / 60 + 39 / 3600)),
        '{"latitude": 1.5, "longitude": -2}': (1.5, -2.0),
        " 39.5 , -123.25 ": (39.5, -123.25),
        "https://goo.gl/maps/x": None,
        '{"latitude": 0, "longitude": 4}': None,
        "nowhere": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.location(F.col("t")).alias("l")).collect()
    for r in rows:
        want = cases[r.t] or (None, None)
        assert (r.l.lat, r.l.lng) == pytest.approx(want) if want[0] is not None else r.l.lat is None, r


def test_degree_minutes_and_names(spark):
    rows = spark.createDataFrame([("123.471",), ("39.385",), ("39.4",), ("x",)], "t string")
    got = [r.d for r in rows.select(text.degree_minutes(F.col("t")).alias("d")).collect()]
    assert got[:3] == pytest.approx([123 + 47.1 / 60, 39 + 38.5 / 60, 39 + 4 / 60]) and got[3] is None
    name = spark.createDataFrame([("  Two  Words\tHere ",)], "t string").select(text.canonical_name(F.col("t")).alias("n")).collect()[0].n
    assert name == "two_words_here"


def test_map_grid_rows_past_z_and_links_match(spark):
    box = {"west": 0.0, "east": 2.0, "south": 0.0, "north": 800.0}
    grid = regions.map_grid(spark, box, 2)
    assert grid.count() == 1600
    points = spark.range(1600).select((F.col("id") % 2 + 0.5).alias("x"), (F.floor(F.col("id") / 2) + 0.5).alias("y"))
    held = {r.n for r in points.select(regions.grid_cell(F.col("x"), F.col("y"), box, 2).alias("n")).collect()}
    assert held == {r.name for r in grid.collect()} and {"1_AA", "2_AZ", "1_BA", "1_ZZ", "2_AAA"} <= held
    names = {r.name: r for r in grid.collect()}
    assert names["1_A"].north_name is None and names["1_A"].east_name == "2_A" and names["2_Z"].south_name == "2_AA"
    assert all(names[r.south_name].north_name == r.name for r in names.values() if r.south_name)
    b = names["1_B"].geom.bbox
    assert (b.west, b.north, b.south) == (0.0, 799.0, 798.0)


def test_region_defaults_and_circle(spark):
    rows = spark.createDataFrame(
        [(i, {"Description": d} if d else {"text": "t"}) for i, d in enumerate(["Skip", "North Side", None, "South"])], "pos int, properties map<string,string>"
    ).withColumn("geom", g.box_polygon(F.col("pos"), F.col("pos"), F.col("pos") + 1, F.col("pos") + 1))
    out = regions.load_regions(rows, start_at=1, limit=4).orderBy("pos").collect()
    assert [(r.name, r.caption, r.text) for r in out] == [
        ("north_side", "North Side", "Region 1"), ("region_2", "Region 2", "t"), ("south", "South", "Region 3")
    ]
    assert [r.neighbors for r in out] == [
        {"prev": "south", "next": "region_2"}, {"prev": "north_side", "next": "south"}, {"prev": "region_2", "next": "north_side"}
    ]
    assert regions.load_regions(rows, start_at=1, limit=2).count() == 1  # the limit is an index
    assert regions.load_regions(rows, start_at=1, limit=2, limit_mode="count").count() == 2


def test_annotation_modes_and_falsy_values(spark):
    feats = spark.createDataFrame([("f", {"v": "1"}), ("lone", {"v": "9"})], "feature_id string, properties map<string,string>")
    feats = feats.withColumn("geom", g.point(F.when(F.col("feature_id") == "f", 0.0).otherwise(9.0), F.lit(0.0)))
    annos = spark.createDataFrame(
        [("a", {"v": "0", "n": "A"}, ["v"]), ("b", {"v": "", "n": "B"}, []), ("c", {"v": "0", "n": None}, [])],
        "feature_id string, properties map<string,string>, falsy array<string>",
    ).withColumn("geom", g.box_polygon(F.lit(-1.0), F.lit(-1.0), F.lit(1.0), F.lit(1.0)))
    dup = an.annotate(feats, annos, multi="duplicate", falsy_keys="falsy").collect()
    got = sorted((r.feature_id, r.properties.get("v"), r.properties.get("n")) for r in dup if r.feature_id == "f")
    # A numeric zero and empty text never overwrite; the text "0" does.
    assert sorted(got, key=str) == sorted([("f", "1", "A"), ("f", "1", "B"), ("f", "0", None)], key=str)
    last = {r.feature_id: r.properties for r in an.annotate(feats, annos).collect()}
    assert last == {"f": {"v": "0", "n": "B"}, "lone": {"v": "9"}}


def test_unknown_action_fails_when_read(spark):
    rows = spark.createDataFrame([("create",), ("merge",)], "action string")
    with pytest.raises(Exception, match="unknown delta action: merge"):
        layers.check_actions(rows).collect()


def test_delta_name_parts(spark):
    rows = spark.createDataFrame([("in/roads/my_asset__20250102_030405__annotate.geojson",), ("odd.geojson",)], "f string")
    a, b = rows.select(layers.delta_name_parts(F.col("f")).alias("p")).collect()
    assert (a.p.asset, str(a.p.ts), a.p.action) == ("my_asset", "2025-01-02 03:04:05", "annotate")
    assert b.p.ts is None and b.p.action is None


def test_rollback_version(spark):
    v = spark.createDataFrame([("staging",), ("20250101_000000",), ("20250301_000000",), ("20250201_000000",)], "version string")
    assert layers.choose_version(v).collect()[0].version == "20250301_000000"
    assert layers.choose_version(v, 1).collect()[0].version == "20250201_000000"


def test_label_repeats_with_seed_keep_one(spark):
    rows = spark.range(100).select(F.col("id").alias("feature_id"), F.when(F.col("id") < 60, "hot").when(F.col("id") < 70, "").otherwise(F.concat(F.lit("n"), "id")).alias("name"))
    for seed in (None, 7):
        out = labels.blank_repeats(rows, "name", seed=seed)
        assert out.filter("name = 'hot'").count() == 1 and out.filter("name is null").count() == 59 and out.filter("name = ''").count() == 10


def test_options_and_declared_columns(spark):
    out = al.apply_option(one(spark, {"type": "b"}), "type", [{"type": "a", "vector_width": 1}, {"type": "b", "vector_width": 9}])
    assert out.collect()[0].properties == {"type": "b", "vector_width": "9"}
    out = al.fill_declared(one(spark, {"x": "kept"}), [{"name": "x", "default": "d"}, {"name": "y", "default": 3}])
    assert out.collect()[0].properties == {"x": "kept", "y": "3"}
    assert value_of(F.col("properties"), "x") is not None


def test_null_groups_are_groups(spark):
    rows = spark.createDataFrame([(k, i, f"n{k}{i}", "x") for k in (None, "a") for i in range(3)], "k string, pos long, name string, label string")
    linked = {(r.k, r.pos): (r.prev, r.next) for r in regions.link_neighbors(rows, "pos", keys=["k"]).collect()}
    assert len(linked) == 6 and linked[None, 0] == ("nNone2", "nNone1") and linked["a", 2] == ("na1", "na0")
    kept = labels.blank_repeats(rows, "label", "name", ["k"]).where("label is not null").collect()
    assert sorted(r.name for r in kept) == ["nNone0", "na0"]
