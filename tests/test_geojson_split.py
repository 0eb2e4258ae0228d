"""Large collections read by many tasks: the same features as the whole-file reader gives."""

import json
import random

import pytest

from landstrata.sources import geojson, geojson_split


def rows(df):
    return sorted(((r.pos, r.feature_id, str(r.geom), tuple(sorted(r.properties.items())), tuple(r.falsy_keys), str(r.neighbors)) for r in df.collect()), key=repr)


def feature(i, rng):
    text = rng.choice(["plain", 'quote " and \\ slash', "braces }{ ][ in text", 'ends with \\"', "}", '"features": [', "ünï·cödé 日本", "line\nbreak", "\\\\", ""])
    props = {"name": f"f{i}", "text": text * rng.randint(0, 4), "n": rng.choice([0, 1.5, False, None]), "list": [{"features": [{"type": "Feature"}]}] if i % 7 == 0 else []}
    shape = {"type": "LineString", "coordinates": [[rng.random(), rng.random()] for _ in range(rng.randint(2, 40))]}
    return {"type": "Feature", "geometry": shape if i % 11 else None, "properties": props, **({"features": [{"a": {}}]} if i % 13 == 0 else {}), **({"neighbors": {"prev": "a}"}} if i % 5 == 0 else {})}


def collection(n, seed, **extra):
    rng = random.Random(seed)
    return {"type": "FeatureCollection", "name": 'features": [{', "links": [{"type": "Feature", "properties": {"name": "no"}}], "crs": {"features": [{}]}, **extra, "features": [feature(i, rng) for i in range(n)], "tail": [{"type": "Feature"}], "z": {"}": "{"}}


@pytest.fixture
def small_blocks(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_blocks_of_any_size_give_the_same_features(spark, folder, small_blocks):
    texts = {
        "compact": json.dumps(collection(150, 1), ensure_ascii=False), "pretty": json.dumps(collection(60, 2), indent=2), "ends": json.dumps(collection(40, 3)) + "\n  \n",
        "none": json.dumps(collection(0, 4)), "bare": '{"type": "Topology", "objects": {}}', "long": json.dumps(collection(3, 5, note="x}" * 20_000)),
    }
    for name, text in texts.items():
        with open(f"{folder}/{name}.geojson", "w") as f:
            f.write(text)
    want = {name: rows(geojson.read_collection(spark, f"{folder}/{name}.geojson")) for name in texts}
    assert len(want["compact"]) == 150 and len(want["pretty"]) == 60 and want["none"] == want["bare"] == []
    for size in (700, 20_000):
        small_blocks(size)
        for name in texts:
            assert rows(geojson_split.read_split_collection(spark, f"{folder}/{name}.geojson")) == want[name], (name, size)
    both = rows(geojson_split.read_split_collection(spark, f"{folder}/*.geojson"))
    assert both == sorted((r for v in want.values() for r in v), key=repr)


def test_a_file_is_read_by_many_tasks(spark, folder, small_blocks):
    with open(f"{folder}/a.geojson", "w") as f:
        json.dump(collection(2000, 6), f)
    small_blocks(100_000)
    scan = spark.read.option("lineSep", "}").text(f"{folder}/a.geojson")
    assert scan.rdd.getNumPartitions() > 10
    out = geojson_split.read_split_collection(spark, f"{folder}/a.geojson")
    assert out.count() == 2000 and out.agg({"pos": "max"}).first()[0] == 1999


@pytest.mark.parametrize("cut", [1, 2, 30, 2000])
def test_a_file_that_is_not_whole_fails(spark, folder, small_blocks, cut):
    text = json.dumps(collection(40, 7))
    with open(f"{folder}/a.geojson", "w") as f:
        f.write(text[:-cut])
    small_blocks(3000)
    with pytest.raises(Exception, match="not whole JSON"):
        geojson_split.read_split_collection(spark, f"{folder}/a.geojson").collect()
