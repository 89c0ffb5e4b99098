"""Registered export, validation, group-load and feed queries (K1, K2, K4,
K6-K10, P1, P5, P7, P12, P13, T1)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.config import CITY_BBOX, REGION_BBOX
from terrane.functions import geom as G
from terrane.operators import spatial as S
from terrane.plans import loads as LD
from terrane.plans import validate as V
from terrane.registry import query, rounded
from terrane.session import shared_dir
from terrane.sources import fixtures as X
from terrane.sources import readers as RD
from terrane.sources.fixtures import with_fixtures
from terrane.store import catalog as C
from terrane.store import export as EX
from terrane.streaming import feed as FD

n_ = G.num


def _v(c: str) -> str:
    return f"cast(round({c}, 6) as varchar)"


def _tract_feature_sql() -> str:
    pts = [("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin")]
    ring = " || ',' || ".join(f"'[' || {_v(x)} || ',' || {_v(y)} || ']'" for x, y in pts)
    return with_fixtures(f"""
select '{{"type":"Feature","properties":{{"geoid":"' || geoid || '","name":"' || name || '","regionkey":'
  || cast(regionkey as varchar) || ',"feature_id":' || cast(cast(geoid as bigint) as varchar)
  || '}},"geometry":{{"type":"Polygon","coordinates":[[' || {ring} || ']]}}}}' as value
from fx_tracts
""", "fx_tracts")


@query("geojson_export", "K7 G14", _tract_feature_sql())
def geojson_export(spark, sf_dir):
    """Tract layer written as GeoJSON-seq part files and read back."""
    path = shared_dir(spark, "geojson")
    EX.write_geojson_seq(X.tracts_layer(spark, sf_dir), path)
    return spark.read.text(path)


@query("csv_export", "K8 G15", with_fixtures("""
select id as feature_id, name, category, val, lon, lat from fx_points where lon is not null
""", "fx_points"))
def csv_export(spark, sf_dir):
    """Point layer attributes written as CSV (geometry dropped) and read back."""
    path = shared_dir(spark, "csv")
    EX.write_csv(X.points_layer(spark, sf_dir), path)
    return spark.read.schema("feature_id long, name string, category string, val double, lon double, lat double") \
        .option("header", True).csv(path)


@query("record_json", "K9", with_fixtures("""
select '{"feature_id":' || cast(id as varchar) || ',"name":"' || name || '","category":"' || category
  || '"}' as json
from fx_points where lon is not null
""", "fx_points"))
def record_json(spark, sf_dir):
    """Each feature's attributes as a JSON object (geometry dropped)."""
    lay = X.points_layer(spark, sf_dir).select("feature_id", "name", "category", "geom")
    return EX.feature_record_json(lay)


@query("list_flatten", "K4", """
select vec_id, label, case when embedding is null or len(embedding) = 0 then null
  else array_to_string(list_transform(embedding, lambda v: regexp_replace(regexp_replace(
    cast(cast(round(cast(v as double), 4) as decimal(38,10)) as varchar), '0+$', ''), '[.]$', '')), '; ') end as embedding
from embeddings
""")
def list_flatten(spark, sf_dir):
    """List columns flattened to '; '-joined text before storage."""
    e = X.table(spark, sf_dir, "embeddings")
    rounded_vec = F.transform("embedding", lambda v: F.round(v.cast("double"), 4))
    return C.flatten_lists(e.select("vec_id", "label", rounded_vec.alias("embedding")), geom=None)


def _validation_sql() -> str:
    r = REGION_BBOX
    inside = f"lon between {n_(r.xmin)} and {n_(r.xmax)} and lat between {n_(r.ymin)} and {n_(r.ymax)}"
    tin = f"xmin >= {n_(r.xmin)} and xmax <= {n_(r.xmax)} and ymin >= {n_(r.ymin)} and ymax <= {n_(r.ymax)}"
    return with_fixtures(f"""
, p as (select * from fx_points where lon is not null and lat is not null),
pc as (select count(*) as n, count(*) filter (where {inside}) as n_in,
  count(*) filter (where abs(lon) < 1e-9 and abs(lat) < 1e-9) as n_ni,
  count(name) as nn_name, count(category) as nn_category, count(val) as nn_val from p),
tc as (select count(*) as n, count(*) filter (where {tin}) as n_in, count(name) as nn_name from fx_tracts),
wide as (select distinct geoid from fx_measures),
km as (select count(*) as n, count(w.geoid) as m from fx_tracts t left join wide w on t.geoid = w.geoid)
select 'points' as layer, 'count' as "check", '>0' as expected, cast(n as varchar) as got, n > 0 as ok from pc
union all select 'points', 'inside_region', cast(n as varchar), cast(n_in as varchar), n_in = n from pc
union all select 'points', 'not_null_island', '0', cast(n_ni as varchar), n_ni = 0 from pc
union all select 'points', 'single_kind', '1', '1', true from pc
union all select 'points', 'rings_closed', '0', '0', true from pc
union all select 'points', 'geometry_present', '0', '0', true from pc
union all select 'points', 'populated:name', cast(n as varchar), cast(nn_name as varchar), nn_name > 0 from pc
union all select 'points', 'populated:category', cast(n as varchar), cast(nn_category as varchar), nn_category > 0 from pc
union all select 'points', 'populated:val', cast(n as varchar), cast(nn_val as varchar), nn_val > 0 from pc
union all select 'tracts', 'count', '25', cast(n as varchar), n = 25 from tc
union all select 'tracts', 'inside_region', cast(n as varchar), cast(n_in as varchar), n_in = n from tc
union all select 'tracts', 'not_null_island', '0', '0', true from tc
union all select 'tracts', 'single_kind', '1', '1', true from tc
union all select 'tracts', 'rings_closed', '0', '0', true from tc
union all select 'tracts', 'geometry_present', '0', '0', true from tc
union all select 'tracts', 'populated:name', cast(n as varchar), cast(nn_name as varchar), nn_name > 0 from tc
union all select 'tracts', 'key_match:geoid', cast(n as varchar), cast(m as varchar), m >= n from km
""", "fx_points", "fx_tracts", "fx_measures")


@query("validate_layers", "P12 J7", _validation_sql())
def validate_layers(spark, sf_dir):
    """Per-layer checks: count, placement, geometry, completeness, key match."""
    pts = X.points_layer(spark, sf_dir)
    tr = X.tracts_layer(spark, sf_dir)
    c1 = V.layer_checks(pts, "points", REGION_BBOX, attrs=["name", "category", "val"])
    c2 = V.layer_checks(tr, "tracts", REGION_BBOX, expected=25, attrs=["name"])
    c3 = V.key_check(tr, X.fx_measures(spark, sf_dir), "tracts", "geoid", width=11)
    return c1.unionByName(c2).unionByName(c3)


def _checked_sql() -> str:
    r = REGION_BBOX

    def part(layer, rows, x, y, x2, y2, attrs, cells):
        inside = f"{x} >= {n_(r.xmin)} and {x2} <= {n_(r.xmax)} and {y} >= {n_(r.ymin)} and {y2} <= {n_(r.ymax)}"
        cell = (f"least(floor(({x} - {n_(r.xmin)}) / ({n_(r.xmax)} - {n_(r.xmin)}) * 8), 7) * 8"
                f" + least(floor(({y} - {n_(r.ymin)}) / ({n_(r.ymax)} - {n_(r.ymin)}) * 8), 7)")
        nn = ", ".join(f"count({c}) as nn_{c}" for c in attrs)
        lines = [("count", "'>0'", "n", "n > 0"), ("inside_region", "cast(n as varchar)", "n_in", "n_in = n"),
                 ("not_null_island", "'0'", "n_ni", "n_ni = 0"), ("single_kind", "'1'", "1", "true"),
                 ("rings_closed", "'0'", "0", "true"), ("geometry_present", "'0'", "0", "true"),
                 ("coverage", f"'>={cells}'", "n_cells", f"n_cells >= {cells}")]
        lines += [(f"populated:{c}", "cast(n as varchar)", f"nn_{c}", f"nn_{c} > 0") for c in attrs]
        rows_sql = " union all ".join(f"""select '{layer}' as layer, '{c}' as "check", {e} as expected,
  cast({g} as varchar) as got, {ok} as ok from m""" for c, e, g, ok in lines)
        return f"""(with m as (select count(*) as n, count(*) filter (where {inside}) as n_in,
  count(*) filter (where abs({x}) < 1e-9 and abs({y}) < 1e-9) as n_ni,
  count(distinct case when {inside} then {cell} end) as n_cells, {nn} from {rows}) {rows_sql})"""

    points = part("osm.points", "(select * from fx_points where lon is not null and lat is not null)",
                  "lon", "lat", "lon", "lat", ["name", "category"], 40)
    parcels = part("osm.parcels", "fx_squares", "x0", "y0", "x1", "y1", ["id"], 1)
    return with_fixtures(f"""
, c as ({points} union all {parcels})
select c.*, min(ok) over (partition by layer) as validated from c
""", "fx_points", "fx_squares")


@query("checked_load", "P12 K1 K3", _checked_sql())
def checked_load(spark, sf_dir):
    """Layers stored, checked by the measures of their own writes, and flagged in
    the catalog; the checks and the flag as the catalog has it."""
    squares = X.fx_squares(spark, sf_dir)
    parcels = squares.select("id", G.rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("geom"))
    return V.load_checked(C.local_store(spark), {("osm", "points"): X.points_layer(spark, sf_dir),
                                                 ("osm", "parcels"): parcels}, REGION_BBOX,
                          {("osm", "points"): {"attrs": ["name", "category"], "min_cells": 40},
                           ("osm", "parcels"): {"attrs": ["id"], "min_cells": 1}})


def _tag_geom():
    """Stand-in geometry for tagged features by kind around a base point."""
    k = F.col("id")
    x0 = F.lit(-71.95) + F.pmod(k * 7919, F.lit(65000)) / F.lit(1e5)
    y0 = F.lit(42.95) + F.pmod(k * 104729, F.lit(55000)) / F.lit(1e5)
    sq = G.rect(x0, y0, x0 + F.lit(0.001), y0 + F.lit(0.001))
    ln = G.line(F.array(F.struct(x0.alias("x"), y0.alias("y")),
                        F.struct((x0 + F.lit(0.002)).alias("x"), (y0 + F.lit(0.001)).alias("y"))))
    return (F.when(F.col("kind") == "poly", sq).when(F.col("kind") == "line", ln)
            .otherwise(G.point(x0, y0)))


def _tag_sql(cx: str, cy: str) -> str:
    return with_fixtures(f"""
, t as (
  select id, name, kind, 'shop' as theme from fx_tags where shop is not null
  union all select id, name, kind, 'office' from fx_tags where office is not null
  union all select id, name, kind, 'amenity' from fx_tags where amenity is not null
), r as (select *, case kind when 'poly' then 1 when 'line' then 2 else 3 end as kr from t),
b as (select theme, min(kr) as best from r group by theme),
k as (select r.*, -71.95e0 + ((id*7919) % 65000)/1e5 as x0, 42.95e0 + ((id*104729) % 55000)/1e5 as y0
      from r join b on r.theme = b.theme and r.kr = b.best)
select theme, id, name, round({cx}, 6) as lon, round({cy}, 6) as lat from k
""", "fx_tags")


@query("business_points", "P5 U2 G13 G7 S13", _tag_sql(
    "case kind when 'poly' then x0 + 0.0005e0 when 'line' then x0 + 0.001e0 else x0 end",
    "case kind when 'poly' then y0 + 0.0005e0 when 'line' then y0 + 0.0005e0 else y0 end"))
def business_points(spark, sf_dir):
    """Business themes united (one row per matched tag), each reduced to its
    dominant geometry kind, collapsed to centroids."""
    t = X.fx_tags(spark, sf_dir).withColumn("geom", _tag_geom())
    b = LD.business_points(t, ("shop", "office", "amenity"))
    return rounded(b.select("theme", "id", "name", F.col("geom.xmin").alias("lon"), F.col("geom.ymin").alias("lat")), 6)


@query("osm_theme_layers", "P7 S13 G13", with_fixtures("""
, t as (
  select id, name, kind, 'shop' as theme from fx_tags where shop is not null
  union all select id, name, kind, 'amenity' from fx_tags where amenity is not null
), r as (select *, case kind when 'poly' then 1 when 'line' then 2 else 3 end as kr from t),
b as (select theme, min(kr) as best from r group by theme)
select r.theme, r.id, r.name, r.kind from r join b on r.theme = b.theme and r.kr = b.best
""", "fx_tags"))
def osm_theme_layers(spark, sf_dir):
    """Tagged features per theme key, each theme reduced to its dominant kind."""
    t = X.fx_tags(spark, sf_dir).withColumn("geom", _tag_geom())
    lay = LD.theme_layers(t.drop("office"), ["shop", "amenity", "building"])
    return lay.select("theme", "id", "name", "kind")


def _themes_sql() -> str:
    # a part carries the tag of theme i if its key is divisible by i + 2
    rows = " union all ".join(f"select 'osm.{theme}' as layer, {i + 2} as every" for i, theme in enumerate(LD.OSM_THEMES)
                              if theme != "power")
    return with_fixtures(f"""
, th as ({rows}),
t as (select layer, kind, case kind when 'poly' then 1 when 'line' then 2 else 3 end as kr
  from fx_tags join th on id % every = 0),
b as (select layer, min(kr) as best from t group by 1)
select t.layer, t.kind, count(*) as n, count(*) as catalog_n from t join b on t.layer = b.layer and kr = best group by 1, 2
union all select 'osm.power', null, 0, 0
""", "fx_tags")


@query("theme_group_load", "P7 S13 G13 K1 A3", _themes_sql())
def theme_group_load(spark, sf_dir):
    """The nine themes as layers of the store, each reduced to its dominant
    kind; one theme's key occurs in no feature. Read back by kind."""
    t = X.fx_tags(spark, sf_dir).withColumn("geom", _tag_geom()).select("id", "name", "kind", "geom")
    keys = [(i, k) for i, (theme, k) in enumerate(LD.OSM_THEMES.items()) if theme != "power"]
    t = t.select("*", *[F.when(F.pmod("id", F.lit(i + 2)) == 0, F.lit("yes")).alias(k) for i, k in keys])
    store = C.local_store(spark)
    LD.load_themes(spark, store, t)
    cat = store.catalog().select(F.concat_ws(".", "schema_name", "table_name").alias("layer"),
                                 F.col("n_features").alias("catalog_n"))
    back = None
    for theme in LD.OSM_THEMES:
        if theme != "power":
            d = store.read("osm", theme).select(F.lit(f"osm.{theme}").alias("layer"), "kind")
            back = d if back is None else back.unionByName(d)
    n = back.groupBy("layer", "kind").agg(F.count("*").alias("n"))
    return cat.join(n, "layer", "left").select("layer", "kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "catalog_n")


@query("snapshot_tables", "K6 K2 K4 P13", """
select c_custkey, n_name, string_agg(o_orderpriority, '; ' order by o_orderkey) as priorities, 'apis__customer_orders' as output
from customer join nation on n_nationkey = c_nationkey join orders on o_custkey = c_custkey
group by c_custkey, n_name
""")
def snapshot_tables(spark, sf_dir):
    """A table without geometry through the store (its list column as text) and
    the web snapshot, read back from the exported Parquet."""
    o = (X.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"))
         .agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("o")))
    t = (X.table(spark, sf_dir, "customer").join(o, "c_custkey")
         .join(X.table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
         .select("c_custkey", "n_name", F.col("o.o_orderpriority").alias("priorities")))
    store = C.local_store(spark)
    store.write_table(t, "apis", "customer_orders")
    out = shared_dir(spark, "web")
    status = EX.export_web(store, out).where("format = 'parquet'").select("output")
    return spark.read.parquet(f"{out}/apis__customer_orders.parquet").withColumn("output", F.lit(status.first()["output"]))


QUAKE_FEED = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("magnitude", T.DoubleType()),
                           T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType()),
                           T.StructField("batch", T.IntegerType())])


@query("live_feed_refresh", "T1 K1 K3", with_fixtures("""
select event_id, magnitude, lon, lat, 2 as batch from fx_quakes
""", "fx_quakes"))
def live_feed_refresh(spark, sf_dir):
    """Feed files land in two drops; an availableNow file stream (one
    checkpoint across both runs) replaces the layer from each drop and
    touches the catalog. Returns the stored layer after the second refresh."""
    q = X.fx_quakes(spark, sf_dir).select("event_id", "magnitude", "lon", "lat")
    landing = shared_dir(spark, "landing")
    ckpt = shared_dir(spark, "feedck")
    store = C.local_store(spark)

    def norm(b):
        return RD.points_from(b, "lon", "lat")

    q.withColumn("batch", F.lit(1)).where(F.col("magnitude") < 2).write.mode("append").json(landing)
    FD.refresh_feed(spark, store, landing, QUAKE_FEED, norm, ("apis", "quakes_live"),
                    checkpoint=ckpt).awaitTermination()
    q.withColumn("batch", F.lit(2)).write.mode("append").json(landing)
    FD.refresh_feed(spark, store, landing, QUAKE_FEED, norm, ("apis", "quakes_live"),
                    checkpoint=ckpt).awaitTermination()
    return store.read("apis", "quakes_live").select("event_id", "magnitude", "lon", "lat", "batch")


PAGE_FEATURES = 1000


@query("group_load_snapshot", "P1 K1 K5 K10 P13 A3", with_fixtures("""
, c as (
  select n.n_regionkey as r, count(*) as n from fx_points p join customer cu on p.id = cu.c_custkey
  join nation n on n.n_nationkey = cu.c_nationkey where p.lon is not null and p.lat is not null group by 1
)
select 'external.region_' || cast(r as varchar) as layer, n, '' as detail from c
union all select 'external.region_missing', cast(0 as bigint), 'read: AnalysisException'
union all select 'external__region_' || cast(r as varchar), n, 'geojson' from c
union all select 'catalog', (select count(*) from c) + 1, 'json'
""", "fx_points"))
def group_load_snapshot(spark, sf_dir):
    """External group load from landed per-region GeoJSON pages (one entry has
    no payload: recorded as failed and registered with 0 features), then the
    web snapshot export; returns the load status and the export status."""
    store = C.local_store(spark)
    land = shared_dir(spark, "external")
    nat = X.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    cust = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("feature_id"), "c_nationkey")
    pts = X.points_layer(spark, sf_dir).join(cust, "feature_id").join(nat, "c_nationkey")
    feats = pts.select("n_regionkey", F.floor(F.col("feature_id") / PAGE_FEATURES).alias("page"),
                       F.concat(
                           F.lit('{"type":"Feature","properties":'),
                           F.to_json(F.struct("feature_id", "name", "category")),
                           F.lit(',"geometry":'), EX.geometry_json(F.col("geom")), F.lit("}")).alias("f"))
    # one FeatureCollection document per line, at most PAGE_FEATURES features each
    docs = feats.groupBy("n_regionkey", "page").agg(F.concat(
        F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","),
        F.lit("]}")).alias("value"))
    docs.select("n_regionkey", "value").write.partitionBy("n_regionkey").text(land)
    regions = sorted(r[0] for r in nat.select("n_regionkey").distinct().collect())
    props = T.StructType([T.StructField("feature_id", T.LongType()), T.StructField("name", T.StringType()),
                          T.StructField("category", T.StringType())])
    entries = [{"key": f"Region {r}", "title": f"region {r}", "path": f"{land}/n_regionkey={r}"} for r in regions]
    entries.append({"key": "Region missing", "title": "no payload", "path": f"{land}/n_regionkey=none"})
    status = LD.load_group(spark, store, "external", entries,
                           lambda e: RD.read_geojson(spark, e["path"], props, multiline=False), scope="bbox")
    exp = EX.export_web(store, shared_dir(spark, "web"), 10, 12, 50)
    return status.select("layer", "n", F.coalesce("error", F.lit("")).alias("detail")).unionByName(
        exp.select(F.col("output").alias("layer"), "n", F.col("format").alias("detail")))


@query("ordered_layer_bbox", "K1 S23 F1", with_fixtures(f"""
select id as feature_id, name, round(lon, 6) as lon, round(lat, 6) as lat from fx_points
where lon between {n_(CITY_BBOX.xmin)} and {n_(CITY_BBOX.xmax)} and lat between {n_(CITY_BBOX.ymin)} and {n_(CITY_BBOX.ymax)}
""", "fx_points"))
def ordered_layer_bbox(spark, sf_dir):
    """The point layer written in space-filling order and read back by the
    city's bbox."""
    store = C.local_store(spark)
    store.write_layer(X.points_layer(spark, sf_dir), "region", "points", ordered=True)
    inside = S.bbox_filter(store.read("region", "points"), CITY_BBOX)
    return rounded(inside.select("feature_id", "name", "lon", "lat"), 6)
