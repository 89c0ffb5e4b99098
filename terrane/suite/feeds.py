"""Registered feed / load queries (S5, S9, S15, S16, S19, S20, U4, X5, G2,
P3, P4, P15)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.config import CITY_BBOX, REGION_BBOX
from terrane.functions import geom as G
from terrane.functions import style as ST
from terrane.operators import filters as FL
from terrane.operators import relational as R
from terrane.operators import spatial as S
from terrane.plans import loads as LD
from terrane.registry import query, rounded
from terrane.session import shared_dir
from terrane.sources import fixtures as X
from terrane.sources import readers as RD
from terrane.sources.fixtures import with_fixtures
from terrane.store import catalog as C

n_ = G.num

PLACES = T.StructType([
    T.StructField("stateabbr", T.StringType()), T.StructField("countyname", T.StringType()),
    T.StructField("measure", T.StringType()), T.StructField("data_value", T.DoubleType()),
    T.StructField("geolocation", T.StructType([T.StructField("coordinates", T.ArrayType(T.DoubleType()))]))])


def _places_records(spark, sf_dir, path):
    """Stand-in: long health-measure records as JSON lines (one per customer)."""
    c = X.fx_points(spark, sf_dir).join(
        X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey"), "id")
    c = c.join(X.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    rec = c.select(F.when(F.pmod("c_nationkey", F.lit(2)) == 1, "NH").otherwise("MA").alias("stateabbr"),
                   F.col("n_name").alias("countyname"), F.col("category").alias("measure"),
                   F.col("val").alias("data_value"),
                   F.struct(F.when(F.col("lon").isNull(), F.array().cast("array<double>"))
                            .otherwise(F.array("lon", "lat")).alias("coordinates")).alias("geolocation"))
    rec.write.json(path)


@query("health_records", "S5 S16 S6 F4 F5 W5", with_fixtures("""
, c as (
  select p.*, cu.c_nationkey, n.n_name from fx_points p join customer cu on p.id = cu.c_custkey
  join nation n on n.n_nationkey = cu.c_nationkey
)
select n_name as countyname, category as measure, round(val, 6) as data_value, round(lon, 6) as lon, round(lat, 6) as lat
from c where c_nationkey % 2 = 1 and n_name in ('NATION_3', 'NATION_7') and lon is not null
""", "fx_points"))
def health_records(spark, sf_dir):
    """JSON records scanned with a schema, state + county equality filters,
    nested coordinates -> points."""
    path = shared_dir(spark, "records")
    _places_records(spark, sf_dir, path)
    r = RD.read_json_records(spark, path, PLACES)
    r = r.where((F.col("stateabbr") == "NH") & F.col("countyname").isin("NATION_3", "NATION_7"))
    lon, lat = RD.coords(F.col("geolocation.coordinates"))
    r = r.select("countyname", "measure", "data_value", lon.alias("lon"), lat.alias("lat")).drop("geolocation")
    pts = RD.points_from(r, "lon", "lat")
    return rounded(pts.select("countyname", "measure", "data_value", "lon", "lat"), 6)


@query("jobs_csv_gz", "S9", """
select lpad(cast(o_custkey as varchar), 15, '0') as w_geocode, count(*) as C000, cast(sum(floor(o_totalprice)) as bigint) as CE01
from orders group by o_custkey
""")
def jobs_csv_gz(spark, sf_dir):
    """Gzipped CSV with the geocode forced to text (leading zeros kept),
    repartitioned after the unsplittable read."""
    o = X.table(spark, sf_dir, "orders")
    agg = o.groupBy("o_custkey").agg(F.count("*").alias("C000"), F.sum(F.floor("o_totalprice")).cast("long").alias("CE01"))
    path = shared_dir(spark, "wac")
    (agg.select(F.lpad(F.col("o_custkey").cast("string"), 15, "0").alias("w_geocode"), "C000", "CE01")
     .write.option("header", True).option("compression", "gzip").csv(path))
    return RD.read_csv(spark, path, "w_geocode STRING, C000 LONG, CE01 LONG", repartition=8)


@query("tracts_wide_region", "S15 S14 F1 J5", with_fixtures(f"""
, wide as (select geoid, max(case when variable = 'BUILDING' then estimate end) as BUILDINGE from fx_measures group by geoid)
select t.geoid, round(w.BUILDINGE, 6) as BUILDINGE from fx_tracts t left join wide w on t.geoid = w.geoid
where t.xmin <= {n_(REGION_BBOX.xmax)} and t.xmax >= {n_(REGION_BBOX.xmin)}
  and t.ymin <= {n_(REGION_BBOX.ymax)} and t.ymax >= {n_(REGION_BBOX.ymin)}
""", "fx_tracts", "fx_measures"))
def tracts_wide_region(spark, sf_dir):
    """Wide tract polygons (one column per measure) clipped to the region bbox."""
    wide = R.pivot_wide(X.fx_measures(spark, sf_dir), "geoid", "variable", ["BUILDING"])
    t = R.attach(X.tracts_layer(spark, sf_dir), wide, "geoid", width=11,
                 agg={"BUILDINGE": F.first("BUILDINGE")})
    return rounded(S.bbox_filter(t, REGION_BBOX).select("geoid", "BUILDINGE"), 6)


ALERT_PROPS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("area", T.StringType())])


@query("alerts_state", "S19 S1 F4", """
select event_id, event_type as area from events where event_type = 'error'
""")
def alerts_state(spark, sf_dir):
    """Alert feed (GeoJSON pages) filtered to one area by equality."""
    q = X.fx_quakes(spark, sf_dir).join(X.table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    feat = F.to_json(F.struct(F.lit("Feature").alias("type"),
                              F.struct("event_id", F.col("event_type").alias("area")).alias("properties"),
                              F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry")))
    pages = (q.select(F.floor(F.col("event_id") / 2000).alias("page"), feat.alias("f")).groupBy("page")
             .agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","),
                           F.lit("]}")).alias("text")))
    f = RD.parse_geojson(pages, "text", ALERT_PROPS)
    return f.where(F.col("area") == "error").select("event_id", "area")


@query("sensors_bbox", "S20 S6 F1 W5 P15", with_fixtures(f"""
select id, round(lon, 6) as longitude, round(lat, 6) as latitude from fx_points
where lon between {n_(CITY_BBOX.xmin)} and {n_(CITY_BBOX.xmax)} and lat between {n_(CITY_BBOX.ymin)} and {n_(CITY_BBOX.ymax)}
""", "fx_points"))
def sensors_bbox(spark, sf_dir):
    """Monitor locations (nested coordinates struct) inside the city bbox."""
    p = X.fx_points(spark, sf_dir)
    docs = p.select("id", F.struct(F.col("lon").alias("longitude"), F.col("lat").alias("latitude")).alias("coordinates"))
    flat = docs.select("id", F.col("coordinates.longitude").alias("longitude"),
                       F.col("coordinates.latitude").alias("latitude"))
    inside = S.point_bbox_filter(flat, CITY_BBOX, "longitude", "latitude")
    return rounded(inside, 6)


@query("landmark_points", "X5 S12 G1 G2", with_fixtures("""
select id, round(lon, 6) as lon, round(lat, 6) as lat, 4326 as srid from fx_points
where lon is not null and id % 11 <> 0
""", "fx_points"))
def landmark_points(spark, sf_dir):
    """'Point(lon lat)' coordinate text parsed by regexp captures into typed
    points (non-matching text -> no point), stored in EPSG:4326."""
    p = X.fx_points(spark, sf_dir)
    txt = F.when(F.pmod("id", F.lit(11)) == 0, F.concat(F.lit("Pt("), F.col("name"), F.lit(")"))) \
        .otherwise(F.concat(F.lit("Point("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")")))
    g = p.select("id", G.point_from_wkt(txt).alias("geom")).where(F.col("geom").isNotNull())
    return rounded(g.select("id", F.col("geom.xmin").alias("lon"), F.col("geom.ymin").alias("lat"),
                            F.col("geom.srid").alias("srid")), 6)


@query("category_intersect", "U4 W6", """
select c_custkey, min(o_orderkey) as first_order
from customer join orders on o_custkey = c_custkey
where c_custkey in (select o_custkey from orders where o_totalprice > 300000)
group by c_custkey
""")
def category_intersect(spark, sf_dir):
    """Customers in the order of their first order, intersected with those that
    placed a large one, keeping that order."""
    o = X.table(spark, sf_dir, "orders")
    order = (X.table(spark, sf_dir, "customer").select("c_custkey")
             .join(o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first_order")),
                   "c_custkey"))
    large = o.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return R.intersect_ordered(order, large, "c_custkey", "first_order")


@query("api_group_load", "P3 K1 K2", with_fixtures("""
select 'apis.usgs_earthquakes' as layer, 'map+db' as target, count(*) as n, count(*) as catalog_n from fx_quakes
union all select 'apis.purpleair', 'map+db', count(*), count(*) from fx_points where lon is not null
union all select 'apis.nasa_firms', 'map+db', count(*), count(*) from fx_points where lon is not null
union all select 'apis.epa_frs_facilities', 'db', count(distinct l_orderkey), count(distinct l_orderkey) from lineitem
""", "fx_quakes", "fx_points"))
def api_group_load(spark, sf_dir):
    """API group load: each source's payload through its reader / normaliser
    into the store (point sources as layers, tabular ones as tables)."""
    from terrane.suite import sources as SRC
    from terrane.suite import tables as TB
    store = C.local_store(spark)
    layer = lambda name, make: LD.Source("apis", name, make)
    sources = [
        layer("usgs_earthquakes", lambda: SRC.geojson_pages(spark, sf_dir).withColumn("geom", G.point("lon", "lat"))),
        layer("purpleair", lambda: SRC.sensor_arrays(spark, sf_dir).withColumn("geom", G.point("longitude", "latitude"))),
        layer("nasa_firms", lambda: SRC.csv_detections(spark, sf_dir).withColumn("geom", G.point("longitude", "latitude"))),
        LD.Source("apis", "epa_frs_facilities", lambda: TB.facility_rollup(spark, sf_dir), table=True),
    ]
    out = LD.run_sources(spark, store, sources).select("layer", "n")
    cat = store.catalog().select(F.concat_ws(".", "schema_name", "table_name").alias("layer"), "target",
                                 F.col("n_features").alias("catalog_n"))
    return out.join(cat, "layer")


@query("manifest_group_load", "P1 S21 K1 A3", with_fixtures("""
select 'external.' || regexp_replace(lower(regexp_replace(lower(r_name) || ':' || n_name, '[^A-Za-z0-9]+', '_', 'g')),
    '^_|_$', '', 'g') as layer,
  'Layer of ' || n_name as source, count(p.id) as n
from nation join region on n_regionkey = r_regionkey
left join (customer join fx_points p on p.id = c_custkey and p.lon is not null and p.lat is not null)
  on c_nationkey = n_nationkey
group by 1, 2
""", "fx_points"))
def manifest_group_load(spark, sf_dir):
    """The rows of the manifests drive a group load: each entry's located
    customers as a layer of the store, read back from its catalog."""
    from terrane.suite import sources as SRC
    store = C.local_store(spark)
    cust = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("feature_id"), "c_nationkey")
    pts = X.points_layer(spark, sf_dir).join(cust, "feature_id")
    LD.load_group(spark, store, "external", SRC.manifest_layers(spark, sf_dir),
                  lambda e: pts.where(F.col("c_nationkey") == int(e["url"].rpartition("/")[2])))
    return store.catalog().select(F.concat_ws(".", "schema_name", "table_name").alias("layer"), "source",
                                  F.col("n_features").alias("n"))


@query("city_group_load", "P2 S22 U3 F16 W2 K1", with_fixtures("""
, d as (
  select *, case when strpos(url, 'AMERICA/') > 0 then 1 when strpos(url, 'EUROPE/') > 0 then 2
    when strpos(url, 'ASIA/') > 0 then 3 when strpos(url, 'AFRICA/') > 0 then 4 end as pref_rank
  from fx_discovery where type in ('MapServer', 'FeatureServer')
)
select 'city.' || regexp_replace(lower(regexp_replace(service, '[^A-Za-z0-9]+', '_', 'g')), '^_|_$', '', 'g') as layer,
  count(*) as n
from d join nation on n_name = service join customer on c_nationkey = n_nationkey
join fx_points p on p.id = c_custkey and p.lon is not null and p.lat is not null
where pref_rank is not null group by 1
""", "fx_discovery", "fx_points"))
def city_group_load(spark, sf_dir):
    """The rows of the discovery drive the city load: vector services in
    preferred folders, one layer per slug, empty ones without a catalog row."""
    from terrane.suite import sources as SRC
    store = C.local_store(spark)
    d = X.fx_discovery(spark, sf_dir)
    services = d.select(F.concat_ws("/", "url", "type", F.lit("0")).alias("url"), F.col("service").alias("name"),
                        "type", F.struct("folder", "service").alias("ordinal"))
    nation = X.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    cust = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("feature_id"), "c_nationkey")
    pts = X.points_layer(spark, sf_dir).join(cust, "feature_id").join(nation, "c_nationkey")
    status = LD.load_city(spark, store, services, SRC.PREFERRED, lambda e: pts.where(F.col("n_name") == e["name"]))
    cat = store.catalog().select(F.concat_ws(".", "schema_name", "table_name").alias("layer"),
                                 F.col("n_features").alias("n"))
    return status.where("error IS NULL").select("layer").join(cat, "layer")


def _schools_sql():
    from terrane.suite import tables as TB  # noqa: F401  (registers enrollment_totals)
    from terrane.registry import REGISTRY
    enr = REGISTRY["enrollment_totals"].sql
    b = CITY_BBOX
    return with_fixtures(f"""
, ids as (select geoid from fx_tracts where regionkey = 1)
select 'school_districts' as layer, count(*) as n from ids
union all select 'school_districts_region', count(*) from fx_tracts
  where xmin <= {n_(b.xmax)} and xmax >= {n_(b.xmin)} and ymin <= {n_(b.ymax)} and ymax >= {n_(b.ymin)}
union all select 'public_schools_districts', count(*) from fx_points
  where lon is not null and lpad(cast(id % 25 as varchar), 11, '0') in (select geoid from ids)
union all select 'enrollment_districts', (select count(*) from ({enr}))
""", "fx_tracts", "fx_points")


@query("schools_load", "P4 F8 J2 S25", _schools_sql())
def schools_load(spark, sf_dir):
    """Schools group: district polygons by id list and by region, school
    points by district id list, enrollment rows; written through the store."""
    from terrane.suite import tables as TB
    store = C.local_store(spark)
    tracts = X.tracts_layer(spark, sf_dir)
    own = tracts.where(F.col("regionkey") == 1).select("geoid")
    n1 = store.write_layer(tracts.join(own, "geoid", "left_semi"), "schools", "school_districts")
    n2 = store.write_layer(S.bbox_filter(tracts, CITY_BBOX), "schools", "school_districts_region")
    pts = X.points_layer(spark, sf_dir).withColumn("leaid", F.lpad((F.col("feature_id") % 25).cast("string"), 11, "0"))
    n3 = store.write_layer(pts.join(own.withColumnRenamed("geoid", "leaid"), "leaid", "left_semi"), "schools",
                           "public_schools_districts")
    n4 = store.write_table(TB.enrollment_totals(spark, sf_dir), "schools", "enrollment_districts")
    return spark.createDataFrame([("school_districts", n1), ("school_districts_region", n2),
                                  ("public_schools_districts", n3), ("enrollment_districts", n4)],
                                 "layer string, n long")


# ---------------------------------------------------------------------------
# queries over customer-derived parcels (their work grows with the tables)
# ---------------------------------------------------------------------------

from terrane.plans import measure as M  # noqa: E402
from terrane.suite.spatial import _seg_len_utm  # noqa: E402


def _parcels(spark, sf_dir):
    q = X.fx_squares(spark, sf_dir)
    a = q.select(F.col("id").alias("query_id"), F.lit("A").alias("shape_id"),
                 G.rect("x0", "y0", "x1", "y1").alias("geom"))
    b = q.select(F.col("id").alias("query_id"), F.lit("B").alias("shape_id"),
                 G.rect("x1", "y0", "x2", "y1").alias("geom"))
    return a, b


def _corners(pts):
    out = []
    for i, (x, y) in enumerate(pts):
        e, n = G.utm_sql(x, y)
        out.append(f"{e} as e{i}, {n} as n{i}")
    return ", ".join(out)


def _quad_area(a: str) -> str:
    return (f"abs((({a}e1 - {a}e0) * ({a}n2 - {a}n0) - ({a}e2 - {a}e0) * ({a}n1 - {a}n0)) + "
            f"(({a}e2 - {a}e0) * ({a}n3 - {a}n0) - ({a}e3 - {a}e0) * ({a}n2 - {a}n0))) / 2")


def _wkt_num(c):
    return f"cast(round({c}, 6) as varchar)"


@query("parcel_shapes", "G3 G4 G5 G7 G14", with_fixtures(f"""
, c as (select id, x0, y0, x1, y1, {_corners([("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")])} from fx_squares)
select id as feature_id, round({_quad_area('')}, 3) as area_m2,
  round(sqrt(power(e1 - e0, 2) + power(n1 - n0, 2)) + sqrt(power(e2 - e1, 2) + power(n2 - n1, 2))
      + sqrt(power(e3 - e2, 2) + power(n3 - n2, 2)) + sqrt(power(e0 - e3, 2) + power(n0 - n3, 2)), 3) as perim_m,
  round((x0 + x1) / 2, 6) as cx, round((y0 + y1) / 2, 6) as cy,
  'POLYGON ((' || {_wkt_num('x0')} || ' ' || {_wkt_num('y0')} || ', ' || {_wkt_num('x1')} || ' ' || {_wkt_num('y0')}
    || ', ' || {_wkt_num('x1')} || ' ' || {_wkt_num('y1')} || ', ' || {_wkt_num('x0')} || ' ' || {_wkt_num('y1')}
    || ', ' || {_wkt_num('x0')} || ' ' || {_wkt_num('y0')} || '))' as wkt
from c
""", "fx_points", "fx_squares"))
def parcel_shapes(spark, sf_dir):
    """Per parcel polygon: UTM area and perimeter, planar centroid, WKT."""
    a, _ = _parcels(spark, sf_dir)
    u = a.select(F.col("query_id").alias("feature_id"), "geom", G.to_utm("geom").alias("ugeom"))
    cx, cy = G.centroid_sql("geom")
    return u.select("feature_id", F.round(G.area("ugeom"), 3).alias("area_m2"),
                    F.round(G.length("ugeom"), 3).alias("perim_m"),
                    F.round(F.expr(cx), 6).alias("cx"), F.round(F.expr(cy), 6).alias("cy"),
                    G.to_wkt("geom").alias("wkt"))


@query("parcels_city", "J2 F1 G9", with_fixtures(f"""
select id as feature_id from fx_squares
where x0 <= {n_(CITY_BBOX.xmax)} and x1 >= {n_(CITY_BBOX.xmin)} and y0 <= {n_(CITY_BBOX.ymax)} and y1 >= {n_(CITY_BBOX.ymin)}
""", "fx_points", "fx_squares"))
def parcels_city(spark, sf_dir):
    """Parcel polygons intersecting the city polygon (spatial semi join)."""
    a, _ = _parcels(spark, sf_dir)
    city = spark.range(1).select(F.lit(1).alias("qid"),
                                 G.rect(CITY_BBOX.xmin, CITY_BBOX.ymin, CITY_BBOX.xmax, CITY_BBOX.ymax).alias("geom"))
    pairs = S.intersects_join(city, a.select(F.col("query_id").alias("feature_id"), "geom"), ["qid"], ["feature_id"])
    return pairs.select("feature_id").distinct()


def _measure_parcels_sql():
    pa = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
    pb = [("x1", "y0"), ("x2", "y0"), ("x2", "y1"), ("x1", "y1")]
    ca = ", ".join(f"{G.utm_sql(x, y)[0]} as ae{i}, {G.utm_sql(x, y)[1]} as an{i}" for i, (x, y) in enumerate(pa))
    cb = ", ".join(f"{G.utm_sql(x, y)[0]} as be{i}, {G.utm_sql(x, y)[1]} as bn{i}" for i, (x, y) in enumerate(pb))
    outer = [("x0", "y0", "x1", "y0"), ("x1", "y0", "x2", "y0"), ("x2", "y0", "x2", "y1"),
             ("x2", "y1", "x1", "y1"), ("x1", "y1", "x0", "y1"), ("x0", "y1", "x0", "y0")]
    perim = " + ".join(_seg_len_utm(*e) for e in outer)
    return with_fixtures(f"""
, c as (select id, x0, y0, x1, y1, x2, {ca}, {cb} from fx_squares),
m as (select id, {_quad_area('a')} + {_quad_area('b')} as area_m2, {perim} as perim_m from c)
select id as query_id, round(area_m2, 3) as area_m2, round(area_m2 / {n_(G.M2_PER_ACRE)}, 3) as area_acres,
  round(perim_m, 3) as perim_m, round(perim_m * {n_(G.FT_PER_M)}, 3) as perim_ft
from m
""", "fx_points", "fx_squares")


@query("draw_measure_parcels", "P8 A6 A7 G3 G4 G5 G6 X11", _measure_parcels_sql())
def draw_measure_parcels(spark, sf_dir):
    """Batch draw-to-measure: every drawing is two edge-adjacent squares;
    summed area and the perimeter of their union (shared edge dissolved)."""
    a, b = _parcels(spark, sf_dir)
    return rounded(M.measure_shapes(a.unionByName(b)), 3)


@query("type_intersect", "U4", """
with l as (select p_type, min(p_partkey) as first_partkey from part group by p_type),
r as (select distinct p_type from part where p_size > 40)
select l.p_type, l.first_partkey from l where l.p_type in (select p_type from r) order by first_partkey
""")
def type_intersect(spark, sf_dir):
    """Part types in order of first appearance, intersected with the types of
    large parts, keeping the first list's order."""
    p = X.table(spark, sf_dir, "part")
    left = p.groupBy("p_type").agg(F.min("p_partkey").alias("first_partkey"))
    right = p.where(F.col("p_size") > 40).select("p_type")
    return R.intersect_ordered(left, right, "p_type", "first_partkey")


@query("filter_columns_counts", "S24 F13 A3", with_fixtures("""
, p as (select * from fx_points where lon is not null and lat is not null)
select 1 as ordinal, 'feature_id' as column_name, count(id) as n_values from p
union all select 2, 'name', count(name) from p
union all select 3, 'category', count(category) from p
union all select 4, 'val', count(val) from p
union all select 5, 'lon', count(lon) from p
union all select 6, 'lat', count(lat) from p
""", "fx_points"))
def filter_columns_counts(spark, sf_dir):
    """Filterable columns of the point layer in ordinal order with the number
    of populated values of each (one aggregate pass)."""
    layer = X.points_layer(spark, sf_dir)
    cols = FL.filter_columns(layer)
    counts = layer.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("ordinal"), F.lit(c).alias("column_name"),
                              F.col(f"c{i}").alias("n_values")) for i, c in enumerate(cols)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


SUPPLIER_PREFERRED = ["NATION_1/", "NATION_2/", "NATION_3/", "NATION_5/", "NATION_8/"]


@query("discovery_suppliers", "S22 U3 F16 W2 X1 F19", """
with s as (
  select n.n_name as folder, floor(s_suppkey / 1000) as page, s_suppkey,
    n.n_name || '/' || s_name as service,
    case s_suppkey % 3 when 0 then 'MapServer' when 1 then 'FeatureServer' else 'ImageServer' end as type
  from supplier join nation n on s_nationkey = n.n_nationkey
), l as (
  select 0 as li, 0 as id, 'Parcels' as name, 'esriGeometryPolygon' as gt
  union all select 1, 1, null, 'esriGeometryPoint'
  union all select 2, 2, 'Imagery', 'esriGeometryRaster'
), j as (
  select 'https://host/' || s.service || '/' || s.type || '/' || cast(l.id as varchar) as url,
    coalesce(l.name, cast(l.id as varchar)) as name, s.folder, s.page, s.s_suppkey, l.li
  from s, l where s.type in ('MapServer', 'FeatureServer')
    and l.gt in ('esriGeometryPoint', 'esriGeometryMultipoint', 'esriGeometryPolyline', 'esriGeometryPolygon')
), r as (
  select *, case when strpos(url, 'NATION_1/') > 0 then 1 when strpos(url, 'NATION_2/') > 0 then 2
    when strpos(url, 'NATION_3/') > 0 then 3 when strpos(url, 'NATION_5/') > 0 then 4
    when strpos(url, 'NATION_8/') > 0 then 5 end as pref_rank,
    regexp_replace(lower(regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g')), '^_|_$', '', 'g') as slug
  from j
)
select url, name, slug, pref_rank from r where pref_rank is not null and length(slug) > 0
qualify row_number() over (partition by slug order by pref_rank, folder, page, s_suppkey, li) = 1
""")
def discovery_suppliers(spark, sf_dir):
    """Server discovery over one service per supplier: paged folder listings
    -> feature services -> vector layers, de-duplicated by URL, ranked by
    preferred folder, table slugs de-duplicated keeping the best copy."""
    from terrane.functions import text as TX
    sup = X.table(spark, sf_dir, "supplier")
    nat = X.table(spark, sf_dir, "nation")
    s = sup.join(nat, sup.s_nationkey == nat.n_nationkey).select(
        F.col("n_name").alias("folder"), F.floor(F.col("s_suppkey") / 1000).alias("page"), "s_suppkey",
        F.concat(F.col("n_name"), F.lit("/"), F.col("s_name")).alias("service"),
        F.when(F.pmod("s_suppkey", F.lit(3)) == 0, "MapServer").when(F.pmod("s_suppkey", F.lit(3)) == 1, "FeatureServer")
        .otherwise("ImageServer").alias("type"))
    listing = (s.groupBy("folder", "page")
               .agg(F.sort_array(F.collect_list(F.struct("s_suppkey", F.struct(F.col("service").alias("name"),
                                                                                  F.col("type")).alias("svc")))).alias("ss")))
    folder_docs = listing.select("folder", "page", F.to_json(F.struct(
        F.transform("ss", lambda x: x["svc"]).alias("services"))).alias("json"))
    lay = F.array(
        F.struct(F.lit(0).alias("id"), F.lit("Parcels").alias("name"), F.lit("esriGeometryPolygon").alias("geometryType")),
        F.struct(F.lit(1).alias("id"), F.lit(None).cast("string").alias("name"), F.lit("esriGeometryPoint").alias("geometryType")),
        F.struct(F.lit(2).alias("id"), F.lit("Imagery").alias("name"), F.lit("esriGeometryRaster").alias("geometryType")))
    layer_docs = s.select(F.concat(F.lit("https://host/"), F.col("service"), F.lit("/"), F.col("type")).alias("service_url"),
                          F.to_json(F.struct(lay.alias("layers"))).alias("json"))
    layers = RD.discover("https://host", folder_docs, layer_docs)
    ranked = (layers.withColumn("pref_rank", R.preferred_rank(F.col("url"), SUPPLIER_PREFERRED))
              .where(F.col("pref_rank").isNotNull()).withColumn("slug", TX.slug(F.col("name")))
              .where(FL.non_empty("slug")))
    return R.first_by_rank(ranked, "slug", [F.col("pref_rank"), F.col("ordinal")]).select("url", "name", "slug", "pref_rank")


@query("manifest_suppliers", "S21 X1", """
with e as (
  select lower(n_name) || ':' || s_name as key, 'Layer of ' || s_name as title,
    'https://host/' || n_name || '/MapServer/' || cast(s_suppkey as varchar) as url,
    case when s_suppkey % 4 = 0 then 'see notes' end as note
  from supplier join nation on s_nationkey = n_nationkey
)
select key, title, url, note, regexp_replace(lower(regexp_replace(key, '[^A-Za-z0-9]+', '_', 'g')), '^_|_$', '', 'g') as table_name
from e
""")
def manifest_suppliers(spark, sf_dir):
    """Manifest documents (per nation and page of 1,000 suppliers) -> entries
    -> table names by slug."""
    from terrane.functions import text as TX
    sup = X.table(spark, sf_dir, "supplier")
    nat = X.table(spark, sf_dir, "nation")
    e = sup.join(nat, sup.s_nationkey == nat.n_nationkey).select(
        "n_name", F.floor(F.col("s_suppkey") / 1000).alias("page"),
        F.struct(F.concat(F.lower("n_name"), F.lit(":"), F.col("s_name")).alias("key"),
                 F.concat(F.lit("Layer of "), F.col("s_name")).alias("title"),
                 F.concat(F.lit("https://host/"), F.col("n_name"), F.lit("/MapServer/"),
                          F.col("s_suppkey").cast("string")).alias("url"),
                 F.when(F.pmod("s_suppkey", F.lit(4)) == 0, F.lit("see notes")).alias("note")).alias("e"))
    docs = e.groupBy("n_name", "page").agg(F.to_json(F.struct(F.collect_list("e").alias("external_arcgis"))).alias("json"))
    entries = RD.manifest_entries(docs.select(F.from_json("json", RD.MANIFEST).alias("m")))
    return entries.select("key", "title", "url", "note", TX.slug("key").alias("table_name"))
