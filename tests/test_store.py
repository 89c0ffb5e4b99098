"""Layer store, catalog, exports, feed."""

import json
import math
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.config import BBox
from terrane.functions import geom as G
from terrane.operators import spatial as S
from terrane.store import catalog as C
from terrane.store import export as EX
from terrane.streaming import feed as FD


def _layer(spark, n=3):
    return spark.range(n).select(F.col("id").alias("feature_id"), F.array(F.lit("a"), F.lit("b")).alias("tags"),
                                 G.point(F.col("id").cast("double"), F.lit(43.0)).alias("geom"))


def test_write_layer_table_and_empty(spark, tmp):
    st = C.Store(spark, f"{tmp}/store").init()
    assert st.write_layer(_layer(spark), "osm", "roads", "OSM", "bbox") == 3
    assert st.write_table(spark.range(2), "apis", "lodes", "LEHD", "state") == 2
    # no geometry column -> stored as a db table
    assert st.write_layer(spark.range(4), "city", "attrs") == 4
    cat = {(r.schema_name, r.table_name): r for r in st.catalog().collect()}
    assert cat[("osm", "roads")].target == "map+db" and cat[("osm", "roads")].n_features == 3
    assert cat[("city", "attrs")].target == "db"
    # tags were flattened to text, geometry kept
    row = st.read("osm", "roads").orderBy("feature_id").first()
    assert row.tags == "a; b" and row.geom.srid == 4326
    # an empty reload registers 0 and leaves the old files; reads come back empty
    st.write_layer(_layer(spark).limit(0), "osm", "roads", "OSM", "bbox")
    assert {(r.table_name, r.n_features) for r in st.catalog().collect()}.issuperset({("roads", 0)})
    assert st.read("osm", "roads").count() == 0


def test_catalog_upsert_keeps_validated(spark, tmp):
    st = C.Store(spark, f"{tmp}/s2").init()
    st.write_layer(_layer(spark), "osm", "roads")
    v = st._latest_version()
    cat = st.catalog().withColumn("validated", F.lit(True))
    cat.write.parquet(st._catalog_path(v + 1))
    st.write_layer(_layer(spark, 5), "osm", "roads")
    r = st.catalog().where("table_name = 'roads'").first()
    assert r.validated is True and r.n_features == 5


def test_reader_survives_a_write(spark, tmp):
    st = C.Store(spark, f"{tmp}/s5").init()
    st.write_layer(_layer(spark), "osm", "roads")
    opened = st.read("osm", "roads")
    st.write_layer(_layer(spark, 7), "osm", "roads")
    assert opened.count() == 3 and st.read("osm", "roads").count() == 7
    for n in (2, 4):
        st.write_layer(_layer(spark, n), "osm", "roads")
    assert len(st._versions(st.root("osm", "roads"))) == 2 and st.read("osm", "roads").count() == 4


def test_group_and_validated(spark, tmp):
    from terrane.config import REGION_BBOX
    from terrane.plans import validate as V
    st = C.Store(spark, f"{tmp}/s6").init()
    v = st._latest_version()
    inside = spark.range(3).select(F.col("id").alias("feature_id"), G.point(F.lit(-71.5), F.lit(43.2)).alias("geom"))
    with st.group():
        st.write_layer(inside, "osm", "roads")
        st.write_layer(_layer(spark), "osm", "far")
        st.write_layer(inside.limit(0), "external", "superfund")
    assert st._latest_version() == v + 1
    checks = V.layer_checks(inside, "osm.roads", REGION_BBOX).unionByName(
        V.layer_checks(_layer(spark), "osm.far", REGION_BBOX)).unionByName(
        V.layer_checks(inside.limit(0), "external.superfund", REGION_BBOX, expected=0))
    V.mark_validated(st, checks)
    got = {r.table_name: r.validated for r in st.catalog().collect()}
    assert got == {"roads": True, "far": False, "superfund": True}


def test_checks_from_the_write(spark, tmp):
    """The measures of a write are those of a scan of what it wrote; the flag
    follows from them, and a layer without rows keeps its files."""
    from terrane.config import REGION_BBOX as R
    from terrane.plans import validate as V
    st = C.Store(spark, f"{tmp}/s9").init()
    step = lambda low, high: F.lit(low) + (F.lit(high) - F.lit(low)) * F.col("id") / 10
    good = spark.range(10).select(F.col("id").alias("feature_id"), G.point(
        step(R.xmin, R.xmax), step(R.ymin, R.ymax)).alias("geom"), F.lit("a").alias("name"))
    mixed = good.withColumn("name", F.lit(None).cast("string")).unionByName(spark.range(1).select(
        F.lit(99).cast("long").alias("feature_id"), G.point(F.lit(0.0), F.lit(0.0)).alias("geom"),
        F.lit(None).cast("string").alias("name")))
    layers = {("osm", "good"): good, ("osm", "mixed"): mixed, ("osm", "none"): good.limit(0)}
    rules = {("osm", "good"): {"expected": 10, "min_cells": 8}, ("osm", "mixed"): {"min_cells": 20},
             ("osm", "none"): {"expected": 0}}
    got = V.load_checked(st, layers, R, rules).collect()
    for (schema, table), rule in rules.items():
        scan = V.layer_checks(layers[schema, table], f"{schema}.{table}", R, rule.get("expected"),
                              min_cells=rule.get("min_cells")).collect()
        assert {tuple(r)[:5] for r in got if r.layer == f"{schema}.{table}"} == {tuple(r) for r in scan}
    bad = {r.check: r.got for r in got if r.layer == "osm.mixed" and not r.ok}
    assert bad == {"inside_region": "10", "not_null_island": "1", "coverage": "8", "populated:name": "0"}
    assert {r.layer: r.validated for r in got} == {"osm.good": True, "osm.mixed": False, "osm.none": True}
    assert {r.table_name: r.n_features for r in st.catalog().collect()} == {"good": 10, "mixed": 11, "none": 0}


def test_a_write_that_died_blocks_nothing(spark, tmp):
    """Incomplete versions, of the catalog and of a layer, are replaced."""
    st = C.Store(spark, f"{tmp}/s7").init()
    st.write_layer(_layer(spark), "osm", "roads")
    for folder in (st._catalog_path(st._latest_version() + 1), f"{st.root('osm', 'roads')}/v000001"):
        spark.range(1).write.parquet(folder)
        path, fs = st._fs(folder + "/_SUCCESS")
        fs.delete(path, True)
    assert st.read("osm", "roads").count() == 3
    st.write_layer(_layer(spark, 5), "osm", "roads")
    st.set_validated(spark.createDataFrame([("osm", "roads", True)], "schema_name string, table_name string, validated boolean"))
    r = st.catalog().where("table_name = 'roads'").first()
    assert (r.n_features, r.validated) == (5, True) and st.read("osm", "roads").count() == 5
    half = C.Store(spark, f"{tmp}/s8")
    path, fs = half._fs(half._catalog_path(0))
    fs.mkdirs(path)                                    # the very first catalog write died
    assert half.init().write_layer(_layer(spark), "osm", "roads") == 3


def test_a_replayed_batch_does_what_is_missing(spark, tmp, monkeypatch):
    st = C.Store(spark, f"{tmp}/s9").init()
    put, calls = C.Store.put, []
    monkeypatch.setattr(C.Store, "put", lambda self, *a, **k: (calls.append(a[1:3]), put(self, *a, **k))[1])
    assert st.write_layer(_layer(spark), "apis", "live", batch="f#0") == 3
    before = (st._latest_version(), st._versions(st.root("apis", "live")), st.catalog().collect())
    assert st.write_layer(_layer(spark, 9), "apis", "live", batch="f#0") == 3        # replayed whole
    assert before == (st._latest_version(), st._versions(st.root("apis", "live")), st.catalog().collect())

    def dies(self, *a):
        raise RuntimeError("died")
    with monkeypatch.context() as m:                   # between the layer and the catalog
        m.setattr(C.Store, "_register", dies)
        try:
            st.write_layer(_layer(spark, 4), "apis", "live", batch="f#1")
        except RuntimeError:
            pass
    assert st.catalog().first().n_features == 3
    n = len(calls)
    assert st.write_layer(_layer(spark, 4), "apis", "live", batch="f#1") == 4 and len(calls) == n
    assert st.catalog().first().n_features == 4 and st.read("apis", "live").count() == 4
    path, fs = st._fs(st.root("apis", "live") + "/_batch")
    out = fs.create(path, True)
    out.writeBytes('{"batch": "f#1", ')                # a note cut short: written again
    out.close()
    assert st.write_layer(_layer(spark, 4), "apis", "live", batch="f#1") == 4 and len(calls) == n + 1
    assert st.write_layer(_layer(spark, 0), "apis", "live", batch="f#2") == 0 and st.read("apis", "live").count() == 0


def test_group_load_statuses(spark, tmp):
    """Entries side by side: loaded, empty, unreadable and unwritable; one
    catalog version for all."""
    from terrane.plans import loads as LD
    st = C.Store(spark, f"{tmp}/s10").init()
    v = st._latest_version()

    def unreadable():
        raise OSError("no such page")

    sources = [LD.Source("osm", "roads", lambda: _layer(spark)), LD.Source("osm", "none", lambda: _layer(spark, 0)),
               LD.Source("osm", "lost", unreadable, "t"),
               LD.Source("osm", "broken", lambda: _layer(spark).withColumn("x", F.raise_error(F.lit("bad")).cast("string"))),
               LD.Source("osm", "attrs", lambda: spark.range(4), table=True)]
    got = {r.layer: (r.n, r.error) for r in LD.run_sources(spark, st, sources).collect()}
    assert got == {"osm.roads": (3, None), "osm.none": (0, None), "osm.lost": (0, "read: OSError"),
                   "osm.broken": (0, next(e for _, e in got.values() if e and e.startswith("write"))), "osm.attrs": (4, None)}
    assert st._latest_version() == v + 1
    assert {r.table_name: (r.target, r.n_features) for r in st.catalog().collect()} == {
        "roads": ("map+db", 3), "none": ("map+db", 0), "lost": ("map+db", 0), "attrs": ("db", 4)}


def test_late_entry_is_cancelled(spark, tmp):
    import time

    from terrane.plans import loads as LD
    st = C.Store(spark, f"{tmp}/s11").init()

    def endless():
        wait = F.udf(lambda i: time.sleep(1) or i, "long")
        return _layer(spark, 400).withColumn("w", wait("feature_id"))
    got = LD.run_sources(spark, st, [LD.Source("osm", "huge", endless), LD.Source("osm", "roads", lambda: _layer(spark))],
                         cap_s=15, grace_s=30).collect()
    assert {r.layer: (r.n, r.error) for r in got} == {"osm.huge": (0, "timeout"), "osm.roads": (3, None)}
    assert {r.table_name for r in st.catalog().collect()} == {"roads"}


def test_city_load_skips_empty_layers(spark, tmp):
    from terrane.plans import loads as LD
    st = C.Store(spark, f"{tmp}/s12").init()
    services = spark.createDataFrame(
        [("u/Public/MapServer/0", "Parcels", "MapServer", 1), ("u/Public/MapServer/1", "Gone", "MapServer", 2),
         ("u/Other/MapServer/2", "Roads", "MapServer", 3), ("u/Public/MapServer/3", "Bad", "MapServer", 4)],
        "url string, name string, type string, ordinal int")
    pages = {"Parcels": lambda: _layer(spark), "Gone": lambda: _layer(spark, 0)}
    got = {r.layer: (r.n, r.error) for r in LD.load_city(spark, st, services, ["Public/"], lambda e: pages[e["name"]]()).collect()}
    assert got == {"city.parcels": (3, None), "city.gone": (0, "empty"), "city.bad": (0, "read: KeyError")}
    assert [r.table_name for r in st.catalog().collect()] == ["parcels"]


def test_feed_restart_keeps_its_checkpoint(spark, tmp):
    a = FD.feed_checkpoint(spark, f"{tmp}/land", "apis", "alerts")
    assert a == FD.feed_checkpoint(spark, f"{tmp}/land", "apis", "alerts")
    assert a != FD.feed_checkpoint(spark, f"{tmp}/other", "apis", "alerts")


def test_geojson_export_parses_back(spark, tmp):
    EX.write_geojson_seq(_layer(spark), f"{tmp}/g")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp}/g").collect()]
    assert {l["geometry"]["type"] for l in lines} == {"Point"}
    assert sorted(l["properties"]["feature_id"] for l in lines) == [0, 1, 2]


def test_feed_replaces_layer(spark, tmp):
    st = C.Store(spark, f"{tmp}/s3").init()
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("lon", T.DoubleType()),
                           T.StructField("lat", T.DoubleType())])
    land = f"{tmp}/land"
    spark.createDataFrame([(1, -71.5, 43.2), (2, -71.4, 43.3)], schema).write.json(land)
    FD.refresh_feed(spark, st, land, schema, lambda b: b.withColumn("geom", G.point("lon", "lat")),
                    ("apis", "alerts"), checkpoint=f"{tmp}/ck").awaitTermination()
    assert st.read("apis", "alerts").count() == 2
    spark.createDataFrame([(3, -71.5, 43.2)], schema).write.mode("append").json(land)
    FD.refresh_feed(spark, st, land, schema, lambda b: b.withColumn("geom", G.point("lon", "lat")),
                    ("apis", "alerts"), checkpoint=f"{tmp}/ck").awaitTermination()
    assert [r.id for r in st.read("apis", "alerts").collect()] == [3]


def _morton(x, y):
    at = [min(max(math.floor((v - lo) / (hi - lo) * 2 ** 31), 0), 2 ** 31 - 1)
          for v, lo, hi in ((x, -180.0, 180.0), (y, -90.0, 90.0))]
    return sum(((at[0] >> i) & 1) << (2 * i) | ((at[1] >> i) & 1) << (2 * i + 1) for i in range(31))


def test_morton_key(spark):
    from terrane.store.ordering import morton_key
    places = [(-180.0, -90.0), (180.0, 90.0), (0.0, 0.0), (-71.51, 43.2), (179.999, -89.9), (500.0, -500.0)]
    df = spark.createDataFrame([*places, (None, 1.0), (float("nan"), 1.0)], "x double, y double")
    got = [r.k for r in df.select(morton_key(F.col("x"), F.col("y")).alias("k")).collect()]
    assert got == [_morton(*p) for p in places] + [None, None]


def test_ordered_layer_is_read_in_part(spark, tmp_path):
    """A small bbox meets the envelope statistics of few files; rows without a
    place, a place of a third of all rows and equal rows are kept."""
    import pyarrow.parquet as pq
    rnd = random.Random(2)
    pts = [(i, -72 + rnd.random(), 43 + rnd.random(), {"a": "b"}) for i in range(4000)]
    pts += [(5000 + i, -71.25, 43.75, None) for i in range(2000)]
    pts += [(8000, None, 43.2, None), (8001, -71.5, 43.5, None), (8001, -71.5, 43.5, None)]
    df = (spark.createDataFrame(pts, "feature_id long, lon double, lat double, tags map<string, string>")
          .withColumn("geom", G.point("lon", "lat")).repartition(16))
    store = C.local_store(spark, str(tmp_path / "store"))
    box = (-71.62, 43.31, -71.55, 43.38)
    want = sorted(i for i, x, y, _ in pts if x is not None and box[0] <= x <= box[2] and box[1] <= y <= box[3])
    met = {}
    for name, settings in (("plain", {}), ("ordered", {"ordered": True, "files": 16})):
        assert store.write_layer(df, "s", name, **settings) == len(pts)
        lay = store.read("s", name)
        assert lay.count() == len(pts)
        got = S.bbox_filter(lay, BBox(*box)).select("feature_id").collect()
        assert sorted(r.feature_id for r in got) == want and want
        files = [f.removeprefix("file://").removeprefix("file:") for f in lay.inputFiles()]
        met[name] = [0, len(files)]
        for f in files:
            meta = pq.ParquetFile(f).metadata
            at = {meta.schema.column(c).path: c for c in range(meta.num_columns)}
            stats = {c: meta.row_group(0).column(at["geom." + c]).statistics for c in ("xmin", "xmax", "ymin", "ymax")}
            met[name][0] += (stats["xmin"].has_min_max and stats["xmin"].min <= box[2] and stats["xmax"].max >= box[0]
                             and stats["ymin"].min <= box[3] and stats["ymax"].max >= box[1])
        if name == "ordered":
            crowd = lay.where("feature_id between 5000 and 6999").select(F.input_file_name().alias("f")).distinct()
            assert crowd.count() > 3
    assert met["plain"][0] == met["plain"][1] == 16
    assert met["ordered"][0] <= 4 and met["ordered"][1] == 16
