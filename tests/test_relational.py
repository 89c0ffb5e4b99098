"""Aggregation, window and set operators."""

from pyspark.sql import functions as F

from terrane.operators import relational as R
from terrane.operators import tiles as TL
from terrane.store import catalog as C


def test_distinct_concat_drops_nulls(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, None), (None, "z"), (2, None)], "k int, v string")
    got = {r.k: r.v for r in R.distinct_concat(df, "k", "v").collect()}
    assert got == {1: "a;b"}


def test_first_per_key_input_order_null_key(spark):
    df = spark.createDataFrame([(1, 2, "late"), (1, 1, "early"), (None, 5, "n1"), (None, 3, "n0")],
                               "k int, ord int, v string")
    got = {r.k: r.v for r in R.first_per_key(df, "k", ["ord"], ["v"]).collect()}
    assert got == {1: "early", None: "n0"}


def test_facility_rollup_optional_columns(spark):
    df = spark.createDataFrame([(7, "B", "Plant", 2), (7, "A", "Plant 2", 1), (8, None, "Only", 1)],
                               "registry_id int, pgm_sys_acrnm string, primary_name string, __ord int")
    got = {r.registry_id: (r.primary_name, r.pgm_sys_acrnm) for r in R.facility_rollup(df).collect()}
    assert got == {7: ("Plant 2", "A;B"), 8: ("Only", None)}


def test_pivot_wide(spark):
    long = spark.createDataFrame([("01", "pop", 10.0, 1), ("01", "inc", 5.0, 2), ("02", "pop", 7.0, 3)],
                                 "geoid string, variable string, estimate double, moe int")
    rows = {r.geoid: r.asDict() for r in R.pivot_wide(long, "geoid", "variable", ["pop", "inc"]).collect()}
    assert rows["01"]["popE"] == 10.0 and rows["01"]["incM"] == 2 and rows["02"]["incE"] is None


def test_global_ordinal_consecutive(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("a"), (F.col("id") % 3).alias("b")).repartition(7)
    out = R.global_ordinal(df, ["a", "b"]).orderBy("a", "b").collect()
    assert [r.ordinal for r in out] == list(range(1, 1001))


def test_top_k_with_hot_group(spark):
    df = spark.range(0, 5000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 7).alias("g"),
                                     F.col("id").alias("v"))
    out = TL.top_k_per_group(df, ["g"], ["v"], 3)
    got = {}
    for r in out.collect():
        got.setdefault(r.g, []).append(r.v)
    assert sorted(got[0]) == [0, 1, 2]
    assert all(len(v) == 3 for v in got.values())


def test_dominant_kind_and_themes(spark):
    df = spark.createDataFrame([(1, "poly", "x", None), (2, "line", "y", "z"), (3, "point", None, "w")],
                               "id int, kind string, shop string, office string")
    t = R.explode_themes(df, ["shop", "office"], ["id", "kind"])
    assert t.count() == 4  # feature 2 appears once per tag
    d = {(r.theme, r.id) for r in R.dominant_kind(t, "theme").collect()}
    assert d == {("shop", 1), ("office", 2)}


def test_preferred_rank_and_layer_diff(spark):
    df = spark.createDataFrame([("a/CityGeneral/x",), ("b/Public/y",), ("c/Other",)], "url string")
    got = [r.r for r in df.select(R.preferred_rank(F.col("url"), ["Public/", "CityGeneral/"]).alias("r")).collect()]
    assert got == [2, 1, None]
    before = spark.createDataFrame([("a",), ("b",)], "layer_id string")
    after = spark.createDataFrame([("b",), ("c",)], "layer_id string")
    assert {(r.layer_id, r.change) for r in R.layer_diff(before, after).collect()} == {("c", "added"), ("a", "removed")}


def test_upsert_keeps_validated_and_notes(spark):
    import datetime as dt
    old = spark.createDataFrame([("city", "parcels", "map+db", "old", "city", 5, True, "ok", dt.datetime(2026, 1, 1))],
                                C.CATALOG_SCHEMA)
    new = spark.createDataFrame([("city", "parcels", "map+db", "new", "city", 0), ("osm", "roads", "map+db", "osm", "bbox", 9)],
                                "schema_name string, table_name string, target string, source string, scope string, n_features long")
    rows = {r.table_name: r for r in C.upsert(old, new, dt.datetime(2026, 6, 8)).collect()}
    assert rows["parcels"].validated is True and rows["parcels"].notes == "ok" and rows["parcels"].n_features == 0
    assert rows["parcels"].source == "new" and rows["roads"].validated is False and rows["roads"].notes is None


def test_flatten_lists(spark):
    df = spark.createDataFrame([(1, [1.5, None], {"a": 1}), (2, [], None), (3, None, {}), (4, [0.0001], {"b": 2})],
                               "id int, xs array<double>, m map<string,int>")
    got = {r.id: (r.xs, r.m) for r in C.flatten_lists(df, geom=None).collect()}
    assert got == {1: ("1.5; NA", "a=1"), 2: (None, None), 3: (None, None), 4: ("0.0001", "b=2")}


def test_discover_layers_plan(spark):
    rows = [("u/Other/MapServer/0", "Parcels", "MapServer", 1),
            ("u/CityGeneral/MapServer/0", "Parcels", "MapServer", 2),
            ("u/Public/FeatureServer/0", "Parcels", "FeatureServer", 3),
            ("u/Public/FeatureServer/1", "Zoning (All)", "FeatureServer", 4),
            ("u/Public/FeatureServer/1", "Zoning (All)", "FeatureServer", 5),
            ("u/Public/ImageServer/0", "Imagery", "ImageServer", 6),
            ("u/CityGeneral/MapServer/9", "___", "MapServer", 7)]
    df = spark.createDataFrame(rows, "url string, name string, type string, ordinal int")
    out = {r.slug: (r.url, r.pref_rank) for r in R.discover_layers(df, ["Public/", "CityGeneral/"]).collect()}
    # not preferred -> dropped; best rank wins the shared slug; empty slug dropped
    assert out == {"parcels": ("u/Public/FeatureServer/0", 1), "zoning_all": ("u/Public/FeatureServer/1", 1)}
