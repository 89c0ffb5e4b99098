"""Registered payload-reader queries.

Each query first turns table rows into payloads of the shape a source
delivers (GeoJSON pages, column arrays, CSV / RDB text, nested Parquet,
manifest and discovery JSON) — stand-ins that only carry rows — and then runs
the library's reader and normaliser on them.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.config import CITY_BBOX
from terrane.functions import geom as G
from terrane.functions import text as TX
from terrane.operators import filters as FL
from terrane.operators import relational as R
from terrane.registry import query, rounded
from terrane.session import shared_dir
from terrane.sources import fixtures as X
from terrane.sources import readers as RD
from terrane.sources.fixtures import with_fixtures

n_ = G.num
PAGE = 2000

QUAKE_PROPS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("mag", T.DoubleType()),
                            T.StructField("place", T.StringType())])


def _quake_pages(spark, sf_dir):
    """Stand-in: quake features as GeoJSON FeatureCollection pages of 2,000
    (one text document per page, with its offset)."""
    q = X.fx_quakes(spark, sf_dir)
    feat = F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("event_id"), F.col("magnitude").alias("mag"), F.col("props").alias("place")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry")))
    q = q.select((F.floor(F.col("event_id") / PAGE) * PAGE).alias("offset"), "event_id", feat.alias("f"))
    pages = q.groupBy("offset").agg(F.sort_array(F.collect_list(F.struct("event_id", "f"))).alias("fs"),
                                    F.count("*").alias("n_features"))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['),
                    F.array_join(F.transform("fs", lambda s: s["f"]), ","), F.lit("]}"))
    return pages.select("offset", "n_features", text.alias("text"))


@query("geojson_pages", "S1 S3 U1 G1", with_fixtures("""
select cast(floor(event_id / 2000) * 2000 as bigint) as "offset", event_id, round(magnitude, 6) as mag,
  props as place, round(lon, 6) as lon, round(lat, 6) as lat, 'point' as kind
from fx_quakes
""", "fx_quakes"))
def geojson_pages(spark, sf_dir):
    """Paged GeoJSON feature layer: pages up to the first short page, features
    exploded, properties flattened, geometry converted."""
    pages = RD.pages_until_short(_quake_pages(spark, sf_dir), PAGE)
    f = RD.parse_geojson(pages, "text", QUAKE_PROPS, keep=["offset"])
    return rounded(f.select(F.col("offset").cast("long").alias("offset"), "event_id", "mag", "place",
                            F.col("geom.xmin").alias("lon"), F.col("geom.ymin").alias("lat"),
                            F.col("geom.kind").alias("kind")), 6)


INAT = T.StructType([T.StructField("results", T.ArrayType(T.StructType([
    T.StructField("taxon", T.StructType([T.StructField("name", T.StringType())])),
    T.StructField("observed_on", T.StringType()), T.StructField("uri", T.StringType()),
    T.StructField("geojson", T.StructType([T.StructField("coordinates", T.ArrayType(T.DoubleType()))]))])))])


@query("observation_pages", "S4 S6 F17 U1", """
select event_type as species, strftime(ts, '%Y-%m-%d') as observed_on,
  'obs/' || cast(event_id as varchar) as uri,
  case when event_id % 50 = 0 then null else round(-71.95e0 + ((user_id*7919) % 65000)/1e5, 6) end as lon,
  case when event_id % 50 = 0 then null else round(42.95e0 + ((user_id*104729) % 55000)/1e5, 6) end as lat
from events
""")
def observation_pages(spark, sf_dir):
    """Observation pages of 200, stopping at a short or missing page; nested taxon / coordinates projected, empty coordinates -> null."""
    e = X.fx_quakes(spark, sf_dir).join(X.table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    res = F.struct(F.struct(F.col("event_type").alias("name")).alias("taxon"),
                   F.date_format("ts", "yyyy-MM-dd").alias("observed_on"),
                   F.concat(F.lit("obs/"), F.col("event_id").cast("string")).alias("uri"),
                   F.struct(F.when(F.pmod("event_id", F.lit(50)) == 0, F.array().cast("array<double>"))
                            .otherwise(F.array("lon", "lat")).alias("coordinates")).alias("geojson"))
    pages = (e.select((F.floor(F.col("event_id") / 200) * 200).alias("offset"), "event_id", res.alias("r"))
             .groupBy("offset").agg(F.sort_array(F.collect_list(F.struct("event_id", "r"))).alias("rs"),
                                    F.count("*").alias("n_features")))
    pages = pages.select("offset", "n_features",
                         F.to_json(F.struct(F.transform("rs", lambda s: s["r"]).alias("results"))).alias("text"))
    kept = RD.pages_until_short(pages, 200)
    rows = kept.select(F.explode(F.from_json("text", INAT)["results"]).alias("r"))
    lon, lat = RD.coords(F.col("r.geojson.coordinates"))
    return rounded(rows.select(F.col("r.taxon.name").alias("species"), F.col("r.observed_on").alias("observed_on"),
                               F.col("r.uri").alias("uri"), lon.alias("lon"), lat.alias("lat")), 6)


@query("sensor_arrays", "S7 S6 F5 X12", with_fixtures("""
select name, round(lat, 6) as latitude, round(lon, 6) as longitude, round(val, 6) as pm25
from fx_points where lon is not null
""", "fx_points"))
def sensor_arrays(spark, sf_dir):
    """Column-array payloads (fields + data rows of text) -> typed sensor points."""
    p = X.fx_points(spark, sf_dir)
    row = F.array(F.col("name"), F.col("lat").cast("string"), F.col("lon").cast("string"),
                  F.col("val").cast("string"))
    payloads = (p.select(F.floor(F.col("id") / 1000).alias("chunk"), row.alias("row"))
                .groupBy("chunk").agg(F.collect_list("row").alias("data")))
    fields = F.array(*[F.lit(f) for f in ("name", "latitude", "longitude", "pm2.5")])
    payloads = payloads.select(F.struct(fields.alias("fields"), F.col("data")).alias("payload"))
    rows = RD.explode_column_arrays(payloads, "payload", ["name", "latitude", "longitude", "pm2.5"])
    pts = RD.points_from(rows, "longitude", "latitude")
    return rounded(pts.select("name", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
                              TX.safe_double(F.col("`pm2.5`")).alias("pm25")), 6)


@query("csv_detections", "S8 F5", with_fixtures("""
select id, round(lat, 6) as latitude, round(lon, 6) as longitude, round(val, 6) as brightness
from fx_points where lon is not null
""", "fx_points"))
def csv_detections(spark, sf_dir):
    """CSV detection lines (id,latitude,longitude,brightness) parsed with a
    schema; rows without coordinates dropped."""
    p = X.fx_points(spark, sf_dir)
    lines = p.select(F.concat_ws(",", F.col("id").cast("string"), F.col("lat").cast("string"),
                                 F.coalesce(F.col("lon").cast("string"), F.lit("")),
                                 F.col("val").cast("string")).alias("line"))
    rows = RD.parse_csv_lines(lines, "line", "id BIGINT, latitude DOUBLE, longitude DOUBLE, brightness DOUBLE")
    pts = RD.points_from(rows, "longitude", "latitude")
    return rounded(pts.select("id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "brightness"), 6)


@query("rdb_gages", "S10 F5 X12", with_fixtures("""
select lpad(cast(id as varchar), 8, '0') as site_no, name as station_nm,
  round(lat, 6) as lat, round(lon, 6) as lon
from fx_points where lon is not null
""", "fx_points"))
def rdb_gages(spark, sf_dir):
    """RDB files (comments, header, type row, tab-separated rows) landed in
    the shared folder, read back and typed."""
    p = X.fx_points(spark, sf_dir).withColumn("file_key", F.floor(F.col("id") / 500))
    data = p.select("file_key", F.lit(4).alias("ord"), F.col("id").alias("sub"), F.concat_ws(
        "\t", F.lpad(F.col("id").cast("string"), 8, "0"), F.col("name"), F.col("lat").cast("string"),
        F.coalesce(F.col("lon").cast("string"), F.lit(""))).alias("line"))
    keys = p.select("file_key").distinct()
    head = [(0, "# site file"), (1, "#"), (2, "site_no\tstation_nm\tdec_lat_va\tdec_long_va"),
            (3, "15s\t50s\t16s\t16s")]
    hdr = None
    for o, txt in head:
        h = keys.select("file_key", F.lit(o).alias("ord"), F.lit(0).cast("long").alias("sub"), F.lit(txt).alias("line"))
        hdr = h if hdr is None else hdr.unionByName(h)
    path = shared_dir(spark, "rdb")
    (hdr.unionByName(data).repartition("file_key").sortWithinPartitions("file_key", "ord", "sub")
     .select("file_key", "line").write.partitionBy("file_key").text(path))
    df = RD.read_rdb(spark, path, "site_no")
    pts = RD.points_from(df, "dec_long_va", "dec_lat_va")
    return rounded(pts.select("site_no", "station_nm", "lat", "lon"), 6)


@query("places_bbox", "S11 S12 F1", with_fixtures(f"""
select name, category, round(val, 6) as confidence, 'POINT (' || cast(round(lon, 6) as varchar) || ' ' || cast(round(lat, 6) as varchar) || ')' as wkt
from fx_points where lon is not null
  and lon between {n_(CITY_BBOX.xmin)} and {n_(CITY_BBOX.xmax)} and lat between {n_(CITY_BBOX.ymin)} and {n_(CITY_BBOX.ymax)}
""", "fx_points"))
def places_bbox(spark, sf_dir):
    """Nested, hive-partitioned places Parquet (landed in the shared folder),
    scanned with struct projection and a pushed-down bbox predicate; WKT
    geometry parsed and written back as WKT."""
    p = X.fx_points(spark, sf_dir).where(F.col("lon").isNotNull())
    nested = p.select(
        F.struct(F.col("name").alias("primary")).alias("names"),
        F.struct(F.col("category").alias("primary")).alias("categories"),
        F.col("val").alias("confidence"),
        F.struct(F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), F.col("lon").alias("xmax"),
                 F.col("lat").alias("ymax")).alias("bbox"),
        F.concat(F.lit("POINT ("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"),
                 F.lit(")")).alias("geometry"),
        F.lit("places").alias("theme"), F.lit("place").alias("type"))
    path = shared_dir(spark, "places")
    nested.write.partitionBy("theme", "type").parquet(path)
    b = CITY_BBOX
    df = RD.read_places(spark, path, b.xmin, b.ymin, b.xmax, b.ymax)
    g = df.withColumn("geom", G.geom_from_wkt(F.col("wkt")))
    return rounded(g.select("name", "category", "confidence", G.to_wkt("geom").alias("wkt")), 6)


@query("manifest_layers", "S21 X1", """
with e as (
  select lower(r_name) || ':' || n_name as key, 'Layer of ' || n_name as title,
    'https://host/' || r_name || '/MapServer/' || cast(n_nationkey as varchar) as url,
    case when n_nationkey % 4 = 0 then 'see notes' end as note
  from nation join region on n_regionkey = r_regionkey
)
select key, title, url, note, regexp_replace(lower(regexp_replace(key, '[^A-Za-z0-9]+', '_', 'g')), '^_|_$', '', 'g') as table_name
from e
""")
def manifest_layers(spark, sf_dir):
    """Manifest documents (one per region) -> entries -> table names by slug."""
    n = X.table(spark, sf_dir, "nation")
    r = X.table(spark, sf_dir, "region")
    e = n.join(r, n.n_regionkey == r.r_regionkey).select(
        "r_name", F.struct(F.concat(F.lower("r_name"), F.lit(":"), F.col("n_name")).alias("key"),
                           F.concat(F.lit("Layer of "), F.col("n_name")).alias("title"),
                           F.concat(F.lit("https://host/"), F.col("r_name"), F.lit("/MapServer/"),
                                    F.col("n_nationkey").cast("string")).alias("url"),
                           F.when(F.pmod("n_nationkey", F.lit(4)) == 0, F.lit("see notes")).alias("note")).alias("e"))
    docs = e.groupBy("r_name").agg(F.to_json(F.struct(F.collect_list("e").alias("external_arcgis"))).alias("json"))
    entries = RD.manifest_entries(docs.select(F.from_json("json", RD.MANIFEST).alias("m")))
    return entries.select("key", "title", "url", "note", TX.slug("key").alias("table_name"))


PREFERRED = ["AMERICA/", "EUROPE/", "ASIA/", "AFRICA/"]


@query("layer_discovery", "S22 U3 F16 W2 X1 F19", with_fixtures("""
, l as (
  select url as service_url, folder, 0 as li, 'Parcels' as name, 0 as id, 'esriGeometryPolygon' as gt from fx_discovery
  union all select url, folder, 1, null, 1, 'esriGeometryPoint' from fx_discovery
  union all select url, folder, 2, 'Imagery', 2, 'esriGeometryRaster' from fx_discovery
), s as (
  select d.url || '/' || d.type as service_url, d.folder, d.service, d.type from fx_discovery d
  where d.type in ('MapServer', 'FeatureServer')
), j as (
  select s.service_url || '/' || cast(l.id as varchar) as url, coalesce(l.name, cast(l.id as varchar)) as name,
    s.folder, s.service, l.li
  from s join l on s.service_url = l.service_url || '/' || (select type from fx_discovery d2 where d2.url = l.service_url)
  where l.gt in ('esriGeometryPoint', 'esriGeometryMultipoint', 'esriGeometryPolyline', 'esriGeometryPolygon')
), r as (
  select *, case when strpos(url, 'AMERICA/') > 0 then 1 when strpos(url, 'EUROPE/') > 0 then 2
    when strpos(url, 'ASIA/') > 0 then 3 when strpos(url, 'AFRICA/') > 0 then 4 end as pref_rank,
    regexp_replace(lower(regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g')), '^_|_$', '', 'g') as slug
  from j
)
select url, name, slug, pref_rank from r where pref_rank is not null and length(slug) > 0
qualify row_number() over (partition by slug order by pref_rank, folder, service, li) = 1
""", "fx_discovery"))
def layer_discovery(spark, sf_dir):
    """City-server discovery: folders -> services -> vector layers, de-duplicated
    by URL, preferred services ranked, table slugs de-duplicated keeping the
    best-ranked copy."""
    d = X.fx_discovery(spark, sf_dir)
    base = "https://host"
    svc = d.select("folder", F.struct(F.concat(F.col("folder"), F.lit("/"), F.col("service")).alias("name"),
                                      F.col("type")).alias("s"), F.col("service"))
    folder_docs = (svc.groupBy("folder").agg(F.sort_array(F.collect_list(F.struct("service", "s"))).alias("ss"))
                   .select("folder", F.to_json(F.struct(F.transform("ss", lambda x: x["s"]).alias("services"))).alias("json")))
    lay = F.array(
        F.struct(F.lit(0).alias("id"), F.lit("Parcels").alias("name"), F.lit("esriGeometryPolygon").alias("geometryType")),
        F.struct(F.lit(1).alias("id"), F.lit(None).cast("string").alias("name"), F.lit("esriGeometryPoint").alias("geometryType")),
        F.struct(F.lit(2).alias("id"), F.lit("Imagery").alias("name"), F.lit("esriGeometryRaster").alias("geometryType")))
    layer_docs = d.select(F.concat(F.col("url"), F.lit("/"), F.col("type")).alias("service_url"),
                          F.to_json(F.struct(lay.alias("layers"))).alias("json"))
    layers = RD.discover(base, folder_docs, layer_docs)
    ranked = layers.withColumn("pref_rank", R.preferred_rank(F.col("url"), PREFERRED)) \
        .where(F.col("pref_rank").isNotNull()).withColumn("slug", TX.slug(F.col("name"))) \
        .where(FL.non_empty("slug"))
    best = R.first_by_rank(ranked, "slug", [F.col("pref_rank"), F.col("ordinal")])
    return best.select("url", "name", "slug", "pref_rank")


@query("filter_columns_points", "S24 F13", with_fixtures("""
, p as (select id as feature_id, name, category, val, lon, lat from fx_points where lon is not null and lat is not null)
select 1 as ordinal, 'feature_id' as column_name, count(distinct feature_id) as n_values from p
union all select 2, 'name', count(distinct name) from p
union all select 3, 'category', count(distinct category) from p
union all select 4, 'val', count(distinct val) from p
union all select 5, 'lon', count(distinct lon) from p
union all select 6, 'lat', count(distinct lat) from p
""", "fx_points"))
def filter_columns_points(spark, sf_dir):
    """Columns the filter builder offers for the point layer (ordinal order),
    with the number of values to choose from in each."""
    layer = X.points_layer(spark, sf_dir)
    cols = FL.filter_columns(layer)
    pairs = layer.select(F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("ordinal"), F.lit(c).alias("column_name"),
                 F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(cols)])).alias("v"))
    return (pairs.select("v.*").distinct().groupBy("ordinal", "column_name")
            .agg(F.count("value").alias("n_values")))
