import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from landstrata.functions import geometry as g
from landstrata.plans import registry, sql
from landstrata.sources import deltas, documents, geojson, store, vector
from landstrata.streaming import apply


def feature(gtype, coordinates, **props):
    return {"type": "Feature", "geometry": {"type": gtype, "coordinates": coordinates}, "properties": props}


def box(w, s, e, n, **props):
    return feature("Polygon", [[[w, s], [e, s], [e, n], [w, n], [w, s]]], **props)


def put(folder, name, *features, **extra):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        json.dump({"type": "FeatureCollection", "features": list(features), **extra}, f)


def state(df):
    return sorted((r.feature_id, tuple(sorted((k, str(v)) for k, v in r.properties.items())), r.file, r.pos) for r in df.collect())


@pytest.fixture
def inbox(folder):
    path = f"{folder}/inbox/roads"
    put(path, "a__20250101_000000__create.geojson", feature("Point", [0, 0], name="p0", value=0), feature("Point", [5, 5], name="p1"), feature("Point", [5, 5], name="p1"))
    put(path, "b__20250102_000000__annotate.geojson", box(-1, -1, 1, 1, color="red", name="", value=0))
    put(path, "c__20250103_000000__create.geojson", feature("Point", [0.5, 0.5], name="late"), feature("LineString", [[4, 4], [6, 6]], name="road"))
    put(path, "d__20250104_000000__annotate.geojson", box(-1, -1, 6, 6, color="blue", kind="x"), box(-1, -1, 1, 1, kind="y"))
    put(path, "e__20250105_000000__delete.geojson", feature("Point", [5, 5]))
    # The stream takes files by the time they arrived.
    for i, name in enumerate(sorted(os.listdir(path))):
        os.utime(f"{path}/{name}", (1735689600 + i * 60, 1735689600 + i * 60))
    return path


def test_stream_equals_replay_and_archives(spark, folder, inbox):
    layers = store.LayerStore(spark, f"{folder}/store")
    q = apply.start_refresh(spark, inbox, layers, f"{folder}/state", archive=f"{folder}/archive", files_per_trigger=1)
    assert q.awaitTermination(180) and q.exception() is None
    archived = [p for p, _, names in os.walk(f"{folder}/archive") if any(n.endswith(".geojson") for n in names)]
    assert archived
    whole = apply.replay(spark, layers, "roads", inbox, *archived)
    got = state(layers.read("roads"))
    assert got == state(whole)
    props = {dict(p)["name"]: dict(p) for _, p, _, _ in got}
    assert set(props) == {"p0", "late"}  # points and road at 5,5 are deleted by intersection
    assert props["p0"] == {"name": "p0", "value": "0", "color": "blue", "kind": "y"}
    assert props["late"] == {"name": "late", "color": "blue", "kind": "y"}
    # A batch that its own query repeats changes nothing; that of another query is another batch.
    batch = deltas.read_inbox(spark, archived[0], "roads").filter("action = 'create'").limit(1).withColumn("ts", F.lit("2031-01-01").cast("timestamp"))
    query = next(c["query"] for c in layers._commits("roads") if c["batch"] == 0)
    assert query and apply.apply_batch(layers, batch, 0, query) == {"roads": "skip"}
    assert apply.apply_batch(layers, batch, 0, "another") == {"roads": "append"}


def test_rows_of_the_log_have_names_of_their_own(spark, folder):
    from datetime import datetime

    from landstrata.operators.layers import apply_deltas

    at, log = datetime(2025, 1, 1), f"{folder}/log"
    rows = spark.createDataFrame([(f"f{i}", None) for i in range(3)], "feature_id string, pos long").withColumn("geom", g.point(F.lit(0.0) + F.substring("feature_id", 2, 1).cast("double"), F.lit(0.0)))
    rows = rows.withColumn("properties", F.create_map(F.lit("name"), F.col("feature_id")))
    for _ in range(2):
        deltas.append_to_log(rows, log, "x", "create", at=at, position="pos")
    gone = rows.filter("feature_id = 'f1'").withColumn("geom", g.point(F.lit(50.0), F.lit(50.0)))
    deltas.append_to_log(gone, log, "x", "delete", at=datetime(2025, 1, 2))
    deltas.append_to_log(gone, log, "x", "delete", at=datetime(2025, 1, 2))
    left = apply_deltas(None, deltas.read_log(spark, log, "x")).collect()
    assert sorted(r["feature_id"] for r in left) == ["f0", "f0", "f2", "f2"]


def test_broken_file_and_upload_without_time(spark, folder):
    put(f"{folder}/in/x", "upload.geojson", feature("Point", [0, 0]))
    rows = deltas.read_inbox(spark, f"{folder}/in/x").withColumn("action", F.lit("create"))
    assert [r["ts"] for r in deltas._parse(spark.read.schema(deltas.COLLECTION).option("multiLine", True).json(f"{folder}/in/x"), "x").collect()][0] is not None
    os.makedirs(f"{folder}/in/y")
    with open(f"{folder}/in/y/a__20250101_000000__create.geojson", "w") as f:
        f.write('{"type": "FeatureCollection", "features": [{"type": "Fea')
    with pytest.raises(Exception):
        deltas.read_inbox(spark, f"{folder}/in/y").collect()


def test_failed_publish_leaves_no_version(spark, folder):
    layers = store.LayerStore(spark, f"{folder}/store")
    layers.write("a", spark.createDataFrame([], "feature_id string"))
    with pytest.raises(ValueError, match="zz"):
        layers.publish("v1", ["a", "zz"])
    assert layers.versions() == []


@pytest.mark.parametrize("query", [
    "SELECT TRANSFORM (id) USING 'cat' AS x FROM range(2)", "select reflect('java.lang.System', 'nanoTime')", "select * from text.`/etc/hostname`",
    "with a as (select 1) delete from t", "select java_method /* x */ ('java.lang.System', 'nanoTime')", "with a as (select 1) insert into t select * from a", "drop table t", "select `reflect`('java.lang.System', 'nanoTime')",
    "select * from `org.apache.spark.sql.execution.datasources.text.TextFileFormat`.`/etc/hostname`", "select * from `org.apache.spark.sql.execution.datasources.v2.text.TextDataSourceV2`.`/etc/hostname`",
    "select 1 where exists (select * from csv.`/etc/hostname`)", "select (select max(value) from text.`/etc/hostname`)", "with t as (select * from TEXT.`/etc/hostname`) select * from t", "select * from (values (1)) a, lateral (select * from text.`/x`)",
    "explain insert into t select 1", "explain select * from text.`/x`", "describe query select * from text.`/x`", "describe text.`/x`", "execute immediate 'drop table t'", "select * from identifier('text.`/x`')",
    "set spark.sql.ansi.enabled=false", "cache table t", "refresh table t", "select * from read_anything('/x')", "select transform(id, name) using 'cat' from range(2)", "select upper(reflect('java.lang.System', 'nanoTime'))", "select id from range(2) order by java_method('a', 'b')",
])
def test_sql_that_is_no_query_is_refused(spark, query):
    with pytest.raises(ValueError):
        sql.run_query(spark, query)


def test_sql_literals_and_key_names(spark):
    assert sql.run_query(spark, "select 'insert into x' as a, \"delete from\" as b -- merge into t").first()["a"] == "insert into x"
    rows = spark.createDataFrame([("f", {"Name": "1", "name": "2", "geometry": "3"})], "feature_id string, properties map<string,string>").withColumn("geom", g.point(F.lit(0.0), F.lit(0.0)))
    sql.register_layer(rows, "keys_of_all_kinds")
    assert sql.run_query(spark, "select Name, property_name from keys_of_all_kinds").first()[:] == ("1", "2")
    assert store.export_sheet(rows).columns == ["Name", "property_geometry", "property_name", "geometry"]


def test_late_delta_asks_for_replay(spark, folder, inbox):
    layers = store.LayerStore(spark, f"{folder}/store")
    rows = deltas.read_inbox(spark, inbox, "roads")
    apply.apply_batch(layers, rows.filter("file like 'd%'"), 0)
    with pytest.raises(apply.LateDelta):
        apply.apply_batch(layers, rows.filter("file like 'a%'"), 1)
    apply.rebuild(spark, layers, "roads", inbox)
    assert state(layers.read("roads")) == state(apply.replay(spark, layers, "roads", inbox))


def test_late_upload_in_a_stream_equals_replay(spark, folder, inbox):
    """Files that arrive in another order than that of their times: the stream goes on and ends as the replay does."""
    order = "d b e a c".split()
    for name in os.listdir(inbox):
        at = 1735689600 + order.index(name[0]) * 60
        os.utime(f"{inbox}/{name}", (at, at))
    layers = store.LayerStore(spark, f"{folder}/store")
    q = apply.start_refresh(spark, inbox, layers, f"{folder}/state", files_per_trigger=1)
    assert q.awaitTermination(300) and q.exception() is None
    assert len(layers._commits("roads")) == 5
    want = state(apply.replay(spark, layers, "roads", inbox))
    assert want and state(layers.read("roads")) == want
    # Compacted, with a change that is older than what the marks hold.
    assert layers.compact("roads") and state(layers.read("roads")) == want
    put(inbox, "f__20250102_120000__annotate.geojson", box(-1, -1, 1, 1, color="green", shade="dark"))
    q = apply.start_refresh(spark, inbox, layers, f"{folder}/state")
    assert q.awaitTermination(300) and q.exception() is None
    after = state(layers.read("roads"))
    assert after == state(apply.replay(spark, layers, "roads", inbox)) != want
    assert [e["mode"] for e in layers._commits("roads")][-2:] == ["compact", "append"]


def test_rebuild_covers_files_that_come_again(spark, folder, inbox):
    layers = store.LayerStore(spark, f"{folder}/store")
    apply.rebuild(spark, layers, "roads", inbox)
    want = state(layers.read("roads"))
    q = apply.start_refresh(spark, inbox, layers, f"{folder}/state")
    assert q.awaitTermination(300) and q.exception() is None
    assert state(layers.read("roads")) == want == state(apply.replay(spark, layers, "roads", inbox))


def test_broken_files_are_listed_and_do_not_stop_the_stream(spark, folder):
    path = f"{folder}/in/roads"
    put(path, "a__20250101_000000__create.geojson", feature("Point", [0, 0], name="whole"))
    with open(f"{path}/b__20250102_000000__create.geojson", "w") as f:
        f.write('{"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 1]}, "properties": {"name": "half"}}, {"ty')
    with open(f"{path}/c__20250103_000000__create.geojson", "w") as f:
        f.write('{"type": "Topology"}')
    open(f"{path}/d__20250104_000000__create.geojson", "w").close()
    layers = store.LayerStore(spark, f"{folder}/store")
    for _ in range(2):  # a second start finds nothing new and does not fail either
        q = apply.start_refresh(spark, path, layers, f"{folder}/state", files_per_trigger=2)
        assert q.awaitTermination(300) and q.exception() is None
    assert [r.properties["name"] for r in layers.read("roads").collect()] == ["whole"]
    assert layers.layers() == ["roads"]
    listed = {r.file[0]: (r.reason, r.layer, r.path.endswith(r.file), r.arrived is not None) for r in layers.rejects().collect()}
    assert listed == {"b": ("not whole JSON", "roads", True, True), "c": ("no feature collection", "roads", True, True)}
    assert layers.rejects().count() == 2
    assert deltas.read_rejects(spark, path).count() == 2 and deltas.read_inbox(spark, path, broken="skip").count() == 1


def test_an_annotation_writes_as_much_as_it_meets(spark, folder):
    layers = store.LayerStore(spark, f"{folder}/store")
    many = spark.range(5000).select(
        F.lit("roads").alias("layer"), F.lit("2025-01-01").cast("timestamp").alias("ts"), F.lit("create").alias("action"), F.lit("a").alias("file"), F.col("id").alias("pos"),
        F.col("id").cast("string").alias("feature_id"), g.point((F.col("id") % 100).cast("double"), F.floor(F.col("id") / 100).cast("double")).alias("geom"), F.create_map(F.lit("n"), F.col("id").cast("string")).alias("properties"),
    )
    assert apply.apply_batch(layers, many, 0) == {"roads": "append"}
    one = spark.range(1).select(
        F.lit("roads").alias("layer"), F.lit("2025-01-02").cast("timestamp").alias("ts"), F.lit("annotate").alias("action"), F.lit("b").alias("file"), F.lit(0).cast("long").alias("pos"),
        F.lit("x").alias("feature_id"), g.box_polygon(F.lit(2.5), F.lit(6.5), F.lit(3.5), F.lit(7.5)).alias("geom"), F.create_map(F.lit("color"), F.lit("red")).alias("properties"),
    )
    assert apply.apply_batch(layers, one, 1) == {"roads": "changes"}
    assert layers._commits("roads")[-1]["rows"] == 2  # a mark and the annotation itself
    assert layers.keys("roads") == ["color", "n"]
    assert [(r.feature_id, r.properties) for r in layers.read("roads").filter("size(properties) > 1").collect()] == [("703", {"n": "703", "color": "red"})]
    # Past the threshold a batch compacts the layer, which reads the same.
    before = state(layers.read("roads"))
    gone = one.withColumns({"file": F.lit("c"), "ts": F.lit("2025-01-03").cast("timestamp"), "action": F.lit("delete")})
    assert apply.apply_batch(layers, gone, 2, segments=1) == {"roads": "changes"}
    now = layers.state("roads")
    assert layers._commits("roads")[-1]["mode"] == "compact" and not layers.segments(now, "marks") and len(layers.segments(now, "marked")) == 1
    assert state(layers.read("roads")) == [r for r in before if r[0] != "703"]


def test_versions_copy_nothing_and_writers_do_not_mix(spark, folder):
    from landstrata.sources import files

    layers, other = (store.LayerStore(spark, f"{folder}/store") for _ in range(2))
    rows = spark.range(10).select(F.col("id").cast("string").alias("feature_id"))
    layers.write("a", rows)
    held = {d for d, _, _ in os.walk(f"{folder}/store/layers")}
    layers.publish("v1")
    assert {d for d, _, _ in os.walk(f"{folder}/store/layers")} == held
    with pytest.raises(ValueError, match="already exists"):
        other.publish("v1")
    # Two writers that build on one state: the second is refused and starts again on the new one.
    base = layers.state("a")
    segment = other.add_segment("a", rows)
    layers.commit("a", base, "append", [layers.add_segment("a", rows)])
    with pytest.raises(store.CommitConflict):
        other.commit("a", base, "append", [segment])
    assert layers.read("a").count() == 20 and layers.read_version("a", "v1").count() == 10
    assert other.write("a", rows, "append") and layers.read("a").count() == 30
    # A segment without a commit, and the file of a writer that was lost half-way, change nothing.
    open(f"{folder}/store/commits/a/.000000000009.json.lost", "w").close()
    open(f"{folder}/store/versions/.v2.json.lost", "w").close()
    assert layers.state("a")["seq"] == 2 and layers.versions() == ["v1"]
    assert files.create(spark, f"{folder}/x/once", "1") and not files.create(spark, f"{folder}/x/once", "2")
    assert files.read_text(spark, f"{folder}/x/once") == "1"


def test_refresh_at_intervals(spark, folder):
    path = f"{folder}/in/roads"
    put(path, "a__20250101_000000__create.geojson", feature("Point", [0, 0], name="first"))
    layers = store.LayerStore(spark, f"{folder}/store")
    q = apply.start_refresh(spark, path, layers, f"{folder}/state", processing_time="1 second")
    try:
        q.processAllAvailable()
        put(path, "b__20250102_000000__create.geojson", feature("Point", [1, 1], name="second"))
        q.processAllAvailable()
        assert sorted(r.properties["name"] for r in layers.read("roads").collect()) == ["first", "second"]
    finally:
        q.stop()


def test_views_of_a_store_and_exports_read_no_layer_for_their_keys(spark, folder):
    layers = store.LayerStore(spark, f"{folder}/store")
    rows = spark.createDataFrame([("f", {"name": "a", "kind": None})], "feature_id string, properties map<string,string>").withColumn("geom", g.point(F.lit(1.0), F.lit(2.0)))
    layers.write("spots", rows)
    assert layers.keys("spots") == ["kind", "name"]
    assert sql.register_store(layers) == ["spots"]
    assert sql.run_query(spark, "select name, west from spots").collect() == [("a", 1.0)]
    out = store.export_sheet(layers.read("spots"), layers.keys("spots"))
    assert out.columns == ["kind", "name", "geometry"] and out.first()[:2] == ("", "a")


def test_results_as_files(spark, folder):
    rows = spark.createDataFrame([(1, "a,b"), (2, None)], "n int, s string")
    store.write_result(rows, f"{folder}/csv", header=True)
    store.write_result(rows, f"{folder}/json", "json")
    assert sorted(r.s or "" for r in spark.read.option("header", True).csv(f"{folder}/csv").collect()) == ["", "a,b"]
    assert sorted(r.n for r in spark.read.json(f"{folder}/json").collect()) == [1, 2]
    with pytest.raises(ValueError, match="unknown format"):
        store.write_result(rows, f"{folder}/xml", "xml")


def test_unknown_action_in_inbox(spark, folder):
    put(f"{folder}/in/x", "a__20250101_000000__merge.geojson", feature("Point", [0, 0]))
    with pytest.raises(Exception, match="unknown delta action"):
        deltas.read_inbox(spark, f"{folder}/in/x").collect()


def test_upload_payload_names_layer_and_action(spark, folder):
    put(f"{folder}/in/up", "upload.geojson", feature("Point", [0, 0], poi_type="spring"), layer="poi", action="create")
    row = deltas.read_inbox(spark, f"{folder}/in/up").collect()[0]
    assert (row.layer, row.action, row.properties) == ("poi", "create", {"poi_type": "spring"})


def test_log_round_trip_and_clear(spark, folder):
    put(f"{folder}/in", "x.geojson", feature("Point", [0, 0], name="a", value=1), feature("LineString", [[0, 0], [1, 1]], name="b", value=2))
    feats = geojson.read_collection(spark, f"{folder}/in/x.geojson")
    deltas.append_to_log(feats, f"{folder}/log", "poi", "create", "poi_in", datetime(2025, 1, 1), "pos")
    deltas.append_to_log(feats, f"{folder}/log", "other", "create", at=datetime(2025, 1, 2), position="pos")
    log = deltas.read_log(spark, f"{folder}/log", "poi")
    assert log.count() == 2
    s = store.LayerStore(spark, f"{folder}/s")
    s.write("poi", registry.refresh_layer(log, "http://m"))
    assert sorted(r.properties["webmap_url"] for r in s.read("poi").collect()) == [
        "http://m/staging/outlets/webmap/?lat=0.0&lng=0.0&zoom=17", "http://m/staging/outlets/webmap/?lat=0.5&lng=0.5&zoom=17"
    ]
    s.publish("20250101_000000")
    s.clear("poi")
    assert s.read("poi").count() == 0 and s.read("poi").columns == ["feature_id", "geom", "properties", "ts", "file", "pos"]
    s.publish("20250102_000000")
    with pytest.raises(ValueError, match="already exists"):
        s.publish("20250102_000000")
    assert s.versions() == ["20250101_000000", "20250102_000000"]
    assert s.read_version("poi").count() == 0 and s.read_version("poi", back=1).count() == 2
    with pytest.raises(ValueError):
        s.read_version("poi", back=2)


def test_world_scan_pushes_the_box_down(spark, folder):
    rows = spark.range(100).select(
        F.col("id"), F.struct((F.col("id") / 10).alias("xmin"), (F.col("id") / 10 + 0.05).alias("xmax"), F.lit(0.1).alias("ymin"), F.lit(0.2).alias("ymax")).alias("bbox"),
        F.struct(F.concat(F.lit("n"), F.col("id")).alias("primary")).alias("names"), (F.col("id") % 2).alias("type"),
    )
    rows.write.partitionBy("type").parquet(f"{folder}/world")
    area = {"west": 1.0, "east": 2.0, "south": 0.0, "north": 1.0}
    out = vector.world_features(spark, f"{folder}/world", area, "type = 1", "envelope", {"primary_name": "names.primary"})
    assert sorted(r.properties["primary_name"] for r in out.collect()) == ["n11", "n13", "n15", "n17", "n19"]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = vector.world_rows(spark, f"{folder}/world", area, "type = 1")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThan(bbox.xmin,1.0)" in plan and "isnotnull(type" in plan.split("PartitionFilters")[1]


def test_files_sheets_and_lists(spark, folder):
    put(f"{folder}/v", "v.geojson", feature("Point", [0, 0], name="in"), feature("Point", [50, 50], name="out"))
    area = {"west": -1.0, "east": 1.0, "south": -1.0, "north": 1.0}
    config = {"place": {"bbox": area}, "assets": {
        "file": {"config": {"fetch_type": "local_ogr", "geometry": "place", "path": f"{folder}/v/v.geojson", "filter": [["require", "name", ["in"]]]}},
        "everything": {"config": {"fetch_type": "local_ogr", "path": f"{folder}/v/v.geojson"}},
        "bad": {"config": {"fetch_type": "teleport"}},
    }}
    assert registry.materialize(spark, config, "file").count() == 1
    assert registry.materialize(spark, config, "everything").count() == 2
    with pytest.raises(ValueError):
        registry.materialize(spark, config, "bad")
    feats = geojson.read_collection(spark, f"{folder}/v/v.geojson")
    store.write_sheet(feats, f"{folder}/sheet")
    back = vector.read_sheet(spark, f"{folder}/sheet")
    assert back.filter("geom is null").count() == 0
    assert sorted(r.properties["name"] for r in back.collect()) == ["in", "out"]
    assert sorted(r.feature_id for r in back.collect()) == sorted(r.feature_id for r in feats.collect())
    store.write_features(feats, f"{folder}/nd")
    again = geojson.read_features(spark, f"{folder}/nd")
    assert again.filter("geom is not null").count() == 2
    with open(f"{folder}/list.txt", "w") as f:
        f.write("\n39.3342\t123.4594\t\n\t\t\n39.3681\t123.4689\tPower Lines overhead\n")
    rows = vector.read_coordinate_list(spark, f"{folder}/list.txt").collect()
    assert len(rows) == 2 and {r.properties.get("name") for r in rows} == {None, "Power Lines overhead"}
    assert all(r.geom.bbox.west < -123 for r in rows)


def test_documents(spark, folder):
    os.makedirs(f"{folder}/d/sub")
    for name in ("map.v1.pdf", "notes"):
        with open(f"{folder}/d/{name}", "w") as f:
            f.write("x")
    docs = documents.read_documents(spark, f"{folder}/d", {"north": 1, "south": 0, "east": 1, "west": 0})
    assert sorted((r.name, r.file_type) for r in docs.collect()) == [("map.v1", ".pdf"), ("notes", "")]
    store.write_sidecars(docs, f"{folder}/side")
    assert spark.read.json(f"{folder}/side").count() == 2


def test_queries_only(spark, folder):
    put(f"{folder}/q", "q.geojson", feature("Point", [0, 0], name="a", kind="x"))
    feats = geojson.read_collection(spark, f"{folder}/q/q.geojson")
    assert sql.register_layers({"pois": feats, "hills": feats}, {"hills": "raster"}) == ["pois"]
    assert sql.run_query(spark, "select name from pois where west < :east", sql.bbox_args({"west": -1, "east": 1, "south": -1, "north": 1})).collect()[0].name == "a"
    assert "name" in [r.column_name for r in sql.columns_of(spark, "pois").collect()]
    assert "pois" in [r.table_name for r in sql.tables(spark).collect()]
    for fine in ("with a(n) as (select name from pois) select n, count(*) from a group by n having count(*) > 0 order by 1 limit 3", "select * from pois p join range(2) r on r.id = 0 where exists (select 1 from pois)", "show tables", "describe pois", "explain select * from pois", "values (1)", "table pois", "select x from pois lateral view explode(array(1, 2)) e as x", "select sum(1) over w from default.nothing_there window w as (order by 1)"):
        if "nothing_there" in fine:
            sql.check_query(spark, fine)
        else:
            assert sql.run_query(spark, fine).collect()
    for bad in ("drop view pois", "create table t as select 1", f"insert overwrite directory '{folder}/x' using json select 1", f"with a as (select 1) insert into pois select * from a"):
        with pytest.raises(Exception):
            sql.run_query(spark, bad)
    assert spark.catalog.tableExists("pois")
    with pytest.raises(ValueError):
        store.result_text(feats, "xml")
