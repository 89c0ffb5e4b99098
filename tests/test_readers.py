"""Payload readers on payload files the tests write (null coordinates, empty
arrays, missing optional columns, duplicates, short and empty pages,
leading-zero identifiers)."""

import gzip
import json
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.sources import readers as RD

PROPS = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_geojson_all_geometry_types(spark, tmp):
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"id": 1, "name": "pt"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"type": "Feature", "properties": {"id": 2}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}},
        {"type": "Feature", "properties": {"id": 3, "name": "poly"},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]]]}},
        {"type": "Feature", "properties": {"id": 4}, "geometry": {"type": "MultiPoint", "coordinates": [[0, 0], [3, 4]]}},
        {"type": "Feature", "properties": {"id": 5}, "geometry": {"type": "MultiPolygon",
                                                                  "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]],
                                                                                  [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}},
        {"type": "Feature", "properties": {"id": 6}, "geometry": None}]}
    _write(f"{tmp}/a.geojson", json.dumps(fc))
    df = RD.read_geojson(spark, f"{tmp}/a.geojson", PROPS)
    rows = {r.id: r for r in df.select("id", "name", F.col("geom.kind").alias("k"), F.size("geom.parts").alias("n"),
                                      F.col("geom.xmax").alias("xmax")).collect()}
    assert rows[1].k == "point" and rows[2].k == "line" and rows[3].k == "poly"
    assert rows[4].n == 2 and rows[5].n == 2 and rows[5].xmax == 6.0
    assert rows[2].name is None and rows[6].k is None


def test_pages_until_short(spark):
    pages = spark.createDataFrame([(0, 2000), (2000, 2000), (4000, 5), (6000, 2000), (8000, 0)],
                                  "offset long, n_features long")
    assert [r.offset for r in RD.pages_until_short(pages, 2000).orderBy("offset").collect()] == [0, 2000, 4000]
    pages2 = spark.createDataFrame([(0, 200), (200, 200), (400, 0)], "offset long, n_features long")
    assert [r.offset for r in RD.pages_until_short(pages2, 200).orderBy("offset").collect()] == [0, 200, 400]
    capped = RD.pages_until_short(spark.createDataFrame([(i * 200, 200) for i in range(20)], "offset long, n_features long"),
                                  200, max_pages=15)
    assert capped.count() == 15


def test_coords_and_column_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([],), (None,), ([3.0],)], "c array<double>")
    lon, lat = RD.coords(F.col("c"))
    got = [(r.a, r.b) for r in df.select(lon.alias("a"), lat.alias("b")).collect()]
    assert got == [(1.0, 2.0), (None, None), (None, None), (3.0, None)]
    lon2, _ = RD.coords(F.col("c"), min_len=2)
    assert [r.a for r in df.select(lon2.alias("a")).collect()] == [1.0, None, None, None]
    p = spark.createDataFrame([(["name", "latitude", "longitude"], [["a", "43.1", "-71.5"], ["b", "x", "-71.4"]])],
                              "fields array<string>, data array<array<string>>")
    rows = RD.explode_column_arrays(p.select(F.struct("fields", "data").alias("p")), "p", ["name", "latitude", "longitude", "pm2.5"])
    pts = RD.points_from(rows, "longitude", "latitude").collect()
    assert [(r.name, r.lat) for r in pts] == [("a", 43.1)]


def test_rdb_drops_comments_and_type_row(spark, tmp):
    _write(f"{tmp}/g.rdb", "# USGS\n#\nsite_no\tstation_nm\tdec_lat_va\tdec_long_va\n15s\t50s\t16s\t16s\n"
                           "01081000\tRiver A\t43.2\t-71.5\n\n01089500\tRiver B\t\t-71.6\n")
    df = RD.read_rdb(spark, f"{tmp}/g.rdb")
    rows = df.collect()
    assert [r.site_no for r in rows] == ["01081000", "01089500"]
    pts = RD.points_from(df, "dec_long_va", "dec_lat_va").collect()
    assert [r.site_no for r in pts] == ["01081000"]


def test_gz_csv_keeps_leading_zeros(spark, tmp):
    p = f"{tmp}/wac.csv.gz"
    with gzip.open(p, "wt") as f:
        f.write("w_geocode,C000\n330010001001000,12\n030010001001000,3\n")
    df = RD.read_csv(spark, p, "w_geocode STRING, C000 LONG", repartition=4)
    assert sorted(r.w_geocode for r in df.collect()) == ["030010001001000", "330010001001000"]


def test_manifest_and_categories(spark, tmp):
    _write(f"{tmp}/sources.json", json.dumps({"external_arcgis": [
        {"key": "usa_structures", "title": "Structures", "url": "https://x/0"},
        {"key": "padus", "title": "PAD-US", "url": "https://y/1", "note": "n"}]}))
    m = RD.read_manifest(spark, f"{tmp}/sources.json").collect()
    assert [(r.key, r.note) for r in m] == [("usa_structures", None), ("padus", "n")]
    docs = spark.createDataFrame([(json.dumps({"query": {"categorymembers": [{"title": "A B"}, {"title": "List of X"}]}}),)],
                                 "json string")
    assert [r.name for r in RD.category_titles(docs).collect()] == ["A B"]


def test_discover_dedupes_urls_and_names(spark):
    folders = spark.createDataFrame([("", json.dumps({"services": [{"name": "A", "type": "MapServer"},
                                                                   {"name": "R", "type": "ImageServer"}]})),
                                     ("F", json.dumps({"services": [{"name": "A", "type": "MapServer"}]}))],
                                    "folder string, json string")
    layers = spark.createDataFrame([("b/A/MapServer", json.dumps({"layers": [
        {"id": 0, "name": "Lots", "geometryType": "esriGeometryPolygon"},
        {"id": 1, "geometryType": "esriGeometryPoint"},
        {"id": 2, "name": "DEM", "geometryType": "esriGeometryRaster"}]}))], "service_url string, json string")
    got = {(r.url, r.name) for r in RD.discover("b", folders, layers).collect()}
    assert got == {("b/A/MapServer/0", "Lots"), ("b/A/MapServer/1", "1")}


def test_places_nested_parquet_pushdown(spark, tmp):
    rows = [({"primary": "a"}, {"primary": "cafe"}, 0.9, {"xmin": -71.5, "ymin": 43.2, "xmax": -71.4, "ymax": 43.3}, "POINT (-71.5 43.2)"),
            ({"primary": "b"}, {"primary": "shop"}, 0.5, {"xmin": -75.0, "ymin": 43.2, "xmax": -71.4, "ymax": 43.3}, "POINT (-75 43.2)")]
    schema = ("names struct<primary:string>, categories struct<primary:string>, confidence double, "
              "bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, geometry string")
    spark.createDataFrame(rows, schema).withColumn("theme", F.lit("places")).withColumn("type", F.lit("place")) \
        .write.partitionBy("theme", "type").parquet(f"{tmp}/places")
    df = RD.read_places(spark, f"{tmp}/places", -71.67, 43.15, -71.45, 43.31)
    assert [r.name for r in df.collect()] == ["a"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "bbox.xmin" in plan
