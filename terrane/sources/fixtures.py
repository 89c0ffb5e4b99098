"""Stand-in layers derived from the driver tables.

The driver tables carry no coordinates, so each stand-in maps table rows to
rows in the schema a job expects (a point layer, tract rectangles, line
vertices, long measures, ...). They only give rows in a schema: every job that
reads them is written for any data of that schema and takes nothing from how
the rows were made. ``SQL`` holds the same derivations for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import geom as G


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _lon(k) -> F.Column:
    return F.lit(-71.95) + F.pmod(k * 7919, F.lit(65000)) / F.lit(1e5)


def fx_points(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"),
        F.col("c_acctbal").alias("val"),
        F.when(F.pmod(k, F.lit(97)) == 0, F.lit(None).cast("double")).otherwise(_lon(k)).alias("lon"),
        (F.lit(42.95) + F.pmod(k * 104729, F.lit(55000)) / F.lit(1e5)).alias("lat"))


def fx_tracts(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(
        F.lpad(k.cast("string"), 11, "0").alias("geoid"), F.col("n_name").alias("name"),
        F.col("n_regionkey").alias("regionkey"),
        (F.lit(-71.95) + F.lit(0.13) * F.pmod(k, F.lit(5))).alias("xmin"),
        (F.lit(42.95) + F.lit(0.11) * F.floor(k / 5)).alias("ymin"),
        (F.lit(-71.95) + F.lit(0.13) * (F.pmod(k, F.lit(5)) + 1)).alias("xmax"),
        (F.lit(42.95) + F.lit(0.11) * (F.floor(k / 5) + 1)).alias("ymax"))


def fx_vertices(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("line_id"), "l_linenumber", "l_partkey", "l_suppkey",
        (F.lit(-71.95) + F.pmod(F.col("l_partkey") * 7919, F.lit(65000)) / F.lit(1e5)).alias("x"),
        (F.lit(42.95) + F.pmod(F.col("l_suppkey") * 104729 + F.col("l_linenumber") * 1301,
                               F.lit(55000)) / F.lit(1e5)).alias("y"))


def fx_measures(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return (c.groupBy("c_nationkey", "c_mktsegment")
            .agg(F.avg("c_acctbal").alias("estimate"), F.count("*").alias("moe"))
            .select(F.lpad(F.col("c_nationkey").cast("string"), 11, "0").alias("geoid"),
                    F.col("c_mktsegment").alias("variable"), "estimate", "moe"))


def fx_programs(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("registry_id"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("string"))
        .otherwise(F.concat("l_returnflag", "l_linestatus")).alias("pgm_sys_acrnm"))


def fx_quakes(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    u = F.col("user_id")
    return ev.select(
        "event_id", "ts", (F.col("value") / 100).alias("magnitude"),
        (F.lit(-71.95) + F.pmod(u * 7919, F.lit(65000)) / F.lit(1e5)).alias("lon"),
        (F.lit(42.95) + F.pmod(u * 104729, F.lit(55000)) / F.lit(1e5)).alias("lat"), "props")


def fx_tags(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("id"), F.col("p_name").alias("name"),
        F.when(F.pmod(k, F.lit(3)) == 0, "poly").when(F.pmod(k, F.lit(3)) == 1, "line")
        .otherwise("point").alias("kind"),
        F.when(F.pmod(k, F.lit(2)) == 0, F.col("p_type")).alias("shop"),
        F.when(F.pmod(k, F.lit(3)) == 0, F.col("p_brand")).alias("office"),
        F.when(F.pmod(k, F.lit(5)) == 0, F.col("p_type")).alias("amenity"))


def fx_discovery(spark, sf_dir) -> DataFrame:
    r = table(spark, sf_dir, "region")
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return (r.join(n, n.n_regionkey == r.r_regionkey).select(
        F.col("r_name").alias("folder"), F.col("n_name").alias("service"),
        F.when(F.pmod(k, F.lit(3)) == 0, "MapServer").when(F.pmod(k, F.lit(3)) == 1, "FeatureServer")
        .otherwise("ImageServer").alias("type"),
        F.concat(F.lit("https://host/"), F.col("r_name"), F.lit("/"), F.col("n_name")).alias("url")))


def fx_triples(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("Q"), F.col("doc_id").cast("string")).alias("subject"),
                    F.concat(F.lit("P"), F.col("source")).alias("predicate"),
                    F.col("lang").alias("value"))


def fx_squares(spark, sf_dir) -> DataFrame:
    """Two edge-adjacent squares per located customer (a drawing of two
    shapes, or a parcel and its neighbour): A = [x, x+s] x [y, y+s] and
    B = [x+s, x+2s] x [y, y+s], with s varying by customer."""
    p = fx_points(spark, sf_dir).where(F.col("lon").isNotNull())
    s = F.lit(0.002) + F.pmod(F.col("id"), F.lit(7)) * F.lit(0.0005)
    return p.select("id", F.col("lon").alias("x0"), F.col("lat").alias("y0"),
                    (F.col("lon") + s).alias("x1"), (F.col("lat") + s).alias("y1"),
                    (F.col("lon") + s + s).alias("x2"))


# ---- layers in the engine's layer schema (feature_id, attributes..., geom) ----

def points_layer(spark, sf_dir) -> DataFrame:
    """Point layer; rows without coordinates are dropped."""
    p = fx_points(spark, sf_dir).dropna(subset=["lon", "lat"])
    return p.select(F.col("id").alias("feature_id"), "name", "category", "val", "lon", "lat",
                    G.point("lon", "lat").alias("geom"))


def tracts_layer(spark, sf_dir) -> DataFrame:
    t = fx_tracts(spark, sf_dir)
    return t.select(F.col("geoid"), "name", "regionkey",
                    F.col("geoid").cast("long").alias("feature_id"),
                    G.rect("xmin", "ymin", "xmax", "ymax").alias("geom"))


def lines_layer(spark, sf_dir) -> DataFrame:
    """Line layer: vertices of one line ordered by (linenumber, partkey, suppkey).
    A line is one feature row, so its vertex list is the feature's own value."""
    v = fx_vertices(spark, sf_dir)
    # hash-partition the vertex rows by line first: the one shuffle the
    # aggregation needs anyway, and the gathering then runs in parallel even
    # when the scan has few splits
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    v = v.repartition(n, "line_id")
    verts = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "x", "y")))
    lines = v.groupBy("line_id").agg(verts.alias("vs"))
    path = F.transform("vs", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    return lines.select(F.col("line_id").alias("feature_id"), G.line(path).alias("geom"))


# ---- the same stand-ins as DuckDB SQL (used by the oracle) ----

SQL = {
    "fx_points": """select c_custkey as id, c_name as name, c_mktsegment as category, c_acctbal as val,
  case when c_custkey % 97 = 0 then null
       else -71.95e0 + ((c_custkey*7919) % 65000)/1e5 end as lon,
  42.95e0 + ((c_custkey*104729) % 55000)/1e5 as lat
from customer""",
    "fx_squares": """select id, lon as x0, lat as y0, lon + (0.002e0 + (id % 7) * 0.0005e0) as x1,
  lat + (0.002e0 + (id % 7) * 0.0005e0) as y1,
  lon + (0.002e0 + (id % 7) * 0.0005e0) + (0.002e0 + (id % 7) * 0.0005e0) as x2
from fx_points where lon is not null""",
    "fx_tracts": """select lpad(cast(n_nationkey as varchar(11)),11,'0') as geoid, n_name as name,
  n_regionkey as regionkey,
  -71.95e0 + 0.13e0*(n_nationkey % 5) as xmin,
  42.95e0 + 0.11e0*floor(n_nationkey/5) as ymin,
  -71.95e0 + 0.13e0*(n_nationkey % 5 + 1) as xmax,
  42.95e0 + 0.11e0*(floor(n_nationkey/5)+1) as ymax
from nation""",
    "fx_vertices": """select l_orderkey as line_id, l_linenumber, l_partkey, l_suppkey,
  -71.95e0 + ((l_partkey*7919) % 65000)/1e5 as x,
  42.95e0 + ((l_suppkey*104729 + l_linenumber*1301) % 55000)/1e5 as y
from lineitem""",
    "fx_measures": """select lpad(cast(c_nationkey as varchar(11)),11,'0') as geoid, c_mktsegment as variable,
  avg(c_acctbal) as estimate, count(*) as moe
from customer group by c_nationkey, c_mktsegment""",
    "fx_programs": """select l_orderkey as registry_id,
  case when l_linenumber=7 then null else concat(l_returnflag,l_linestatus) end as pgm_sys_acrnm
from lineitem""",
    "fx_quakes": """select event_id, ts, value/100 as magnitude,
  -71.95e0 + ((user_id*7919) % 65000)/1e5 as lon,
  42.95e0 + ((user_id*104729) % 55000)/1e5 as lat, props
from events""",
    "fx_tags": """select p_partkey as id, p_name as name,
  case p_partkey % 3 when 0 then 'poly' when 1 then 'line' else 'point' end as kind,
  case when p_partkey % 2 = 0 then p_type end as shop,
  case when p_partkey % 3 = 0 then p_brand end as office,
  case when p_partkey % 5 = 0 then p_type end as amenity
from part""",
    "fx_discovery": """select r.r_name as folder, n.n_name as service,
  case n.n_nationkey % 3 when 0 then 'MapServer' when 1 then 'FeatureServer' else 'ImageServer' end as type,
  concat('https://host/', r.r_name, '/', n.n_name) as url
from region r join nation n on n.n_regionkey = r.r_regionkey""",
    "fx_triples": """select concat('Q', cast(doc_id as varchar(20))) as subject,
  concat('P', source) as predicate, lang as value
from documents""",
}


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix an oracle query with the stand-in views it uses, as CTEs."""
    ctes = ",\n".join(f"{n} AS (\n{SQL[n]}\n)" for n in names)
    return f"WITH {ctes}\n{sql}" if names else sql
