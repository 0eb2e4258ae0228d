"""Every named asset of the registry once, on small files."""

import json

import pytest
from pyspark.sql import functions as F

from landstrata.functions import geometry as g
from landstrata.plans import registry

AREA = {"west": -1.0, "east": 4.0, "south": -1.0, "north": 4.0}


def feature(gtype, coordinates, **props):
    return {"type": "Feature", "geometry": {"type": gtype, "coordinates": coordinates}, "properties": props}


SQUARE = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Inputs of all kinds, and a function that runs one asset."""
    at = str(tmp_path_factory.mktemp("assets"))
    with open(f"{at}/v.geojson", "w") as f:
        json.dump({"type": "FeatureCollection", "features": [feature("Polygon", SQUARE, name="square", kind="a"), feature("Point", [9, 9], name="far"), feature("LineString", [[0, 0], [1, 1]], name="way", elevation="3")]}, f)
    with open(f"{at}/list.txt", "w") as f:
        f.write("39.3342\t123.4594\tRock\n")
    pixels = spark.createDataFrame([(r, c, float(r + c)) for r in range(12) for c in range(12)], "row long, col long, value double")
    pixels.write.parquet(f"{at}/pixels")
    spark.createDataFrame([(1, 1.0, 1.0, {"natural": "spring"}), (2, 9.0, 1.0, {"natural": "spring"}), (3, 1.0, 1.0, {"x": "y"})], "id long, lon double, lat double, tags map<string,string>").write.parquet(f"{at}/nodes")
    spark.range(3).select(F.struct((F.col("id") * 3 + 0.0).alias("xmin"), (F.col("id") * 3 + 0.5).alias("xmax"), F.lit(0.0).alias("ymin"), F.lit(0.5).alias("ymax")).alias("bbox"), F.col("id").cast("string").alias("name")).write.parquet(f"{at}/world")
    with open(f"{at}/sheet.csv", "w") as f:
        f.write('name,geometry\nspot,"{""type"":""Point"",""coordinates"":[1,2]}"\n')

    def run(settings, inputs=None):
        return registry.materialize(spark, {"place": {"bbox": AREA}, "assets": {"it": {"config": settings}}}, "it", inputs)

    layer = run({"fetch_type": "local_ogr", "path": f"{at}/v.geojson"})
    return at, run, layer, pixels


def test_files(made):
    at, run, layer, _ = made
    assert layer.count() == 3
    assert run({"fetch_type": "local_ogr", "geometry": "place", "path": f"{at}/v.geojson", "filter": [["require", "name", ["square", "far"]]]}).count() == 1
    assert [r.properties["name"] for r in run({"fetch_type": "overture_duckdb", "path": f"{at}/world", "geometry_from": "envelope"}).orderBy("properties.name").collect()] == ["0", "1"]
    assert [r.properties for r in run({"fetch_type": "fetch_osm", "path": f"{at}/nodes", "add_labels": True}).collect()] == [{"label": "1", "natural": "spring"}]
    assert run({"fetch_type": "import_sheet", "path": f"{at}/sheet.csv"}).first().properties == {"name": "spot"}
    assert run({"fetch_type": "coordinate_list", "path": f"{at}/list.txt"}).first().properties == {"name": "Rock"}
    assert run({"fetch_type": "local_raster", "path": f"{at}/pixels"}).count() == 144
    small = run({"fetch_type": "fetch_url", "path": f"{at}/pixels", "resample_width": 5, "source": {"west": -1.0, "north": 4.0, "dx": 0.5, "dy": 0.5}})
    assert small.count() == 25
    assert {r.name for r in run({"fetch_type": "documents", "path": at + "/*.*"}).collect()} >= {"v", "list", "sheet"}


def test_a_long_file_is_split(made, monkeypatch):
    from landstrata.sources import vector

    at, run, layer, _ = made
    monkeypatch.setattr(vector, "SPLIT_BYTES", 10)
    split = run({"fetch_type": "local_ogr", "path": f"{at}/v.geojson"})
    assert sorted(r.feature_id for r in split.collect()) == sorted(r.feature_id for r in layer.collect())


def test_derived_layers(made):
    _, run, layer, pixels = made
    inputs = {"layer": layer, "dem": pixels, "regions": layer.where("properties['name'] = 'square'").select(F.col("properties")["name"].alias("name"), "geom")}
    assert run({"type": "derived_hillshade", "in_layer": "dem"}, inputs).count() == 144
    lines, segments = (run({"type": "contours", "in_layer": "dem", "interval": 5.0, **x}, inputs) for x in ({}, {"segments": True}))
    assert sorted(r.properties["elevation"] for r in lines.collect()) == ["10.0", "15.0", "20.0", "5.0"] and segments.count() > 20
    assert run({"type": "h3_cells", "in_layer": "layer", "starting_resolution": 6}, inputs).count() > 0
    assert run({"type": "gazetteer", "num_cols": 5}).count() == 25
    with_pos = {"layer": layer.where("geom.gtype = 'Polygon'").withColumn("pos", F.lit(0).cast("long"))}
    assert run({"type": "runbook", "in_layer": "layer"}, with_pos).first().caption == "Region 0"
    assert run({"type": "gsheet_export", "in_layer": "layer"}, inputs).columns == ["elevation", "kind", "name", "geometry"]
    cut = run({"type": "raster_extract", "in_layer": "dem", "regions": "regions", "source": {"west": -1.0, "north": 4.0, "dx": 0.5, "dy": 0.5}}, inputs)
    assert sorted((r.region_row, r.region_col, r.row, r.col) for r in cut.collect()) == [(i, j, i + 4, j + 2) for i in range(4) for j in range(4)]
    notes = layer.where("geom.gtype = 'LineString'").withColumn("properties", F.create_map(F.lit("color"), F.lit("red")))
    noted = run({"type": "annotate", "in_layer": "layer", "annotations": "notes"}, {**inputs, "notes": notes})
    assert {r.properties["name"] for r in noted.where("properties['color'] = 'red'").collect()} == {"square", "way"}
    assert [(r.geom.gtype, r.geom.bbox.west, r.geom.bbox.north) for r in run({"type": "centroid", "in_layer": "layer"}, inputs).where("properties['name'] = 'square'").collect()] == [("Point", 1.0, 1.0)]
    asked = run({"type": "sql", "query": "select name from places where west > :west and east < :east order by name"}, {"places": layer})
    assert [r.name for r in asked.collect()] == ["square", "way"]
    with pytest.raises(ValueError, match="only queries"):
        run({"type": "sql", "query": "drop view places"}, {"places": layer})


def test_builders(made):
    _, _, layer, _ = made
    kept = registry.refresh_layer(layer, "http://m", builder=lambda old, new: new.where("geom.gtype = 'Point'"))
    assert [r.properties["webmap_url"].startswith("http://m") for r in kept.collect()] == [True]
