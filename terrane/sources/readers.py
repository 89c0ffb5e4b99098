"""Payload readers S1-S12, S21-S28: landed payloads -> normalised DataFrames.

Every reader has an explicit schema (no inference). JSON payloads can be read
from files (``spark.read``) or parsed from a text column with the same schema
(``from_json``), so a payload that arrives as rows (a stream, a table of raw
responses) goes through the same normaliser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions import geom as G
from terrane.operators import filters as FL

# --------------------------------------------------------------------------- #
# GeoJSON (S1) and paged feature layers (S3)
# --------------------------------------------------------------------------- #

GEOMETRY_JSON = T.StructType([T.StructField("type", T.StringType()),
                              T.StructField("coordinates", T.StringType())])


def feature_collection_schema(props: T.StructType) -> T.StructType:
    return T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("features", T.ArrayType(T.StructType([
            T.StructField("type", T.StringType()),
            T.StructField("properties", props),
            T.StructField("geometry", GEOMETRY_JSON)])))])


def _xy(c: Column) -> Column:
    return F.struct(F.get(c, 0).alias("x"), F.get(c, 1).alias("y"))


def geom_from_geojson(gtype: Column, coords_json: Column) -> Column:
    """GeoJSON geometry (type + raw coordinates JSON) -> geometry struct."""
    a1 = F.from_json(coords_json, T.ArrayType(T.DoubleType()))
    a2 = F.from_json(coords_json, T.ArrayType(T.ArrayType(T.DoubleType())))
    a3 = F.from_json(coords_json, T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))
    a4 = F.from_json(coords_json, T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))))
    path = lambda arr: F.transform(arr, _xy)
    return (F.when(gtype == "Point", G.point(F.get(a1, 0), F.get(a1, 1)))
            .when(gtype == "MultiPoint", G.make_geom("point", F.transform(a2, lambda p: F.array(F.array(_xy(p))))))
            .when(gtype == "LineString", G.make_geom("line", F.array(F.array(path(a2)))))
            .when(gtype == "MultiLineString", G.make_geom("line", F.transform(a3, lambda ln: F.array(path(ln)))))
            .when(gtype == "Polygon", G.make_geom("poly", F.array(F.transform(a3, path))))
            .when(gtype == "MultiPolygon", G.make_geom("poly", F.transform(a4, lambda pg: F.transform(pg, path)))))


def features_from_collections(fc: DataFrame, col: str = "fc", keep: list[str] | None = None) -> DataFrame:
    """Explode parsed FeatureCollections: one row per feature, properties
    flattened, geometry converted."""
    keep = keep or []
    f = fc.select(*keep, F.explode(F.col(f"{col}.features")).alias("f"))
    return f.select(*keep, "f.properties.*",
                    geom_from_geojson(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("geom"))


def read_geojson(spark: SparkSession, path: str, props: T.StructType, multiline: bool = True) -> DataFrame:
    """GeoJSON FeatureCollection files -> one row per feature (one
    document per file, or one per line with ``multiline=False``)."""
    fc = spark.read.schema(feature_collection_schema(props)).option("multiLine", multiline).json(path)
    return features_from_collections(fc.select(F.struct(*fc.columns).alias("fc")))


def parse_geojson(pages: DataFrame, text: str, props: T.StructType, keep: list[str] | None = None) -> DataFrame:
    """S1 over payload text held in a column."""
    fc = pages.select(*(keep or []), F.from_json(F.col(text), feature_collection_schema(props)).alias("fc"))
    return features_from_collections(fc, "fc", keep)


def pages_until_short(pages: DataFrame, page_size: int, offset: str = "offset",
                      count: str = "n_features", max_pages: int | None = None,
                      first_offset: int = 0) -> DataFrame:
    """Keep pages in offset order up to and including the first page
    with fewer than ``page_size`` features (an empty page ends the scan, and
    is itself empty), and before the first offset that is missing. A page
    limit, ``max_pages``, is off by default. Both stops are minima over the
    pages' (offset, count), joined as one row."""
    meta = pages.select(F.col(offset).alias("__at"), F.col(count).alias("__n"))
    nexts = meta.select((F.col("__at") + page_size).alias("__at"))
    short = meta.where(F.col("__n") < page_size).agg(F.min("__at").alias("__short"))
    # a page whose predecessor is absent: the scan ended before it
    gap = (meta.where(F.col("__at") > first_offset).join(nexts, "__at", "left_anti")
           .agg(F.min("__at").alias("__gap")))
    stops = short.join(gap, F.lit(True))
    out = (pages.join(F.broadcast(stops), F.lit(True))       # one row
           .where((F.col("__short").isNull() | (F.col(offset) <= F.col("__short")))
                  & (F.col("__gap").isNull() | (F.col(offset) < F.col("__gap"))))
           .drop("__short", "__gap"))
    if max_pages is not None:
        out = out.where(F.col(offset) < first_offset + max_pages * page_size)
    return out


# --------------------------------------------------------------------------- #
# JSON records (S5), nested coordinates (S6), column arrays
# --------------------------------------------------------------------------- #

def read_json_records(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """JSON records (one per line, or one array per file)."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def coords(arr: Column, min_len: int = 1) -> tuple[Column, Column]:
    """(lon, lat) from a coordinate array; shorter than ``min_len`` -> null."""
    ok = F.coalesce(F.size(arr) >= min_len, F.lit(False))
    return F.when(ok, F.get(arr, 0)), F.when(ok & (F.size(arr) >= 2), F.get(arr, 1))


COLUMN_ARRAY = T.StructType([T.StructField("fields", T.ArrayType(T.StringType())),
                             T.StructField("data", T.ArrayType(T.ArrayType(T.StringType())))])


def explode_column_arrays(payloads: DataFrame, col: str, fields: list[str]) -> DataFrame:
    """``{fields: [...], data: [[...], ...]}`` -> one row per data row with
    a column per requested field (missing -> null, text)."""
    p = payloads.select(F.col(col).alias("p"))
    rows = p.select(F.col("p.fields").alias("fields"), F.explode("p.data").alias("row"))
    m = rows.select(F.map_from_arrays(F.slice("fields", 1, F.size("row")),
                                      F.slice("row", 1, F.size("fields"))).alias("m"))
    return m.select(*[F.element_at("m", F.lit(f)).alias(f) for f in fields])


# --------------------------------------------------------------------------- #
# CSV (S8, S9) and RDB
# --------------------------------------------------------------------------- #

def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, repartition: int | None = None,
             **opts) -> DataFrame:
    """CSV with a header and an explicit schema (identifiers typed as
    text keep leading zeros). Gzip is read transparently but is not
    splittable, so ``repartition`` spreads the rows after the read."""
    df = spark.read.schema(schema).option("header", True).options(**opts).csv(path)
    return df.repartition(repartition) if repartition else df


def parse_csv_lines(lines: DataFrame, col: str, schema: str) -> DataFrame:
    """S8 over CSV text lines held in a column (header lines removed)."""
    return lines.select(F.from_csv(F.col(col), schema).alias("r")).select("r.*")


RDB_TYPE_ROW = r"^[0-9]+[sndl]$"


def read_rdb(spark: SparkSession, path: str, first_col: str | None = None) -> DataFrame:
    """Tab-delimited RDB: '#' comment lines and blank lines dropped, the
    header names the columns, the type row after it ('5s', '15s', ...) is
    dropped; every column stays text."""
    df = (spark.read.option("sep", "\t").option("comment", "#").option("header", True)
          .option("inferSchema", False).csv(path))
    c = first_col or df.columns[0]
    return df.where(~F.col(f"`{c}`").rlike(RDB_TYPE_ROW) | F.col(f"`{c}`").isNull())


def points_from(df: DataFrame, lon: str, lat: str, drop_src: tuple[str, ...] = ()) -> DataFrame:
    """F5 + G1: numeric lon/lat (safe casts), rows lacking either dropped, a
    point geometry added."""
    out = df.withColumn("lon", F.col(f"`{lon}`").cast("string").try_cast("double")) \
        .withColumn("lat", F.col(f"`{lat}`").cast("string").try_cast("double"))
    out = out.dropna(subset=["lon", "lat"]).withColumn("geom", G.point("lon", "lat"))
    return out.drop(*drop_src) if drop_src else out


# --------------------------------------------------------------------------- #
# nested Parquet (S11), WKT
# --------------------------------------------------------------------------- #

def read_places(spark: SparkSession, path: str, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Hive-partitioned nested Parquet; only the struct fields used are
    read (nested column pruning) and the bbox predicate on bbox.xmin/ymin is
    pushed into the scan. Min corner only, both ends inclusive."""
    df = spark.read.parquet(path)
    df = df.where(F.col("bbox.xmin").between(xmin, xmax) & F.col("bbox.ymin").between(ymin, ymax))
    return df.select(F.col("names.primary").alias("name"), F.col("categories.primary").alias("category"),
                     "confidence", F.col("geometry").alias("wkt"))


# --------------------------------------------------------------------------- #
# manifest (S21), discovery (S22), categories (S26), pages
# --------------------------------------------------------------------------- #

MANIFEST = T.StructType([T.StructField("external_arcgis", T.ArrayType(T.StructType([
    T.StructField("key", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("note", T.StringType())])))])


def manifest_entries(manifests: DataFrame, col: str = "m") -> DataFrame:
    """One row per manifest entry (key, title, url, note)."""
    return manifests.select(F.explode(F.col(f"{col}.external_arcgis")).alias("e")).select("e.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return manifest_entries(df.select(F.struct("external_arcgis").alias("m")))


SERVICES = T.StructType([T.StructField("folders", T.ArrayType(T.StringType())),
                         T.StructField("services", T.ArrayType(T.StructType([
                             T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])))])
LAYERS = T.StructType([T.StructField("layers", T.ArrayType(T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()),
    T.StructField("geometryType", T.StringType())])))])

# Service types that serve features, and vector geometry types.
FEATURE_SERVICES = ("MapServer", "FeatureServer")
VECTOR_TYPES = ("esriGeometryPoint", "esriGeometryMultipoint", "esriGeometryPolyline", "esriGeometryPolygon")


def discover(base: str, folder_docs: DataFrame, layer_docs: DataFrame) -> DataFrame:
    """Folder documents (folder, [page,] json) and service-layer
    documents (service_url, json) -> vector layers (url, name, ordinal)
    de-duplicated by URL; a missing name falls back to the layer id.
    ``ordinal`` is discovery order (folder, page, service, layer)."""
    if "page" not in folder_docs.columns:
        folder_docs = folder_docs.withColumn("page", F.lit(0))
    svc = folder_docs.select("folder", "page", F.posexplode(F.from_json("json", SERVICES)["services"]).alias("si", "s"))
    svc = svc.where(F.col("s.type").isin(*FEATURE_SERVICES)).select(
        "folder", "page", "si", F.concat(F.lit(base + "/"), F.col("s.name"), F.lit("/"), F.col("s.type")).alias("service_url"))
    lay = layer_docs.select("service_url", F.posexplode(F.from_json("json", LAYERS)["layers"]).alias("li", "l"))
    lay = lay.where(F.col("l.geometryType").isin(*VECTOR_TYPES))
    j = svc.join(lay, "service_url")
    out = j.select(F.concat(F.col("service_url"), F.lit("/"), F.col("l.id").cast("string")).alias("url"),
                   F.coalesce(F.col("l.name"), F.col("l.id").cast("string")).alias("name"),
                   F.struct("folder", "page", "si", "li").alias("ordinal"))
    return out.groupBy("url").agg(F.min(F.struct("ordinal", "name")).alias("m")).select(
        "url", F.col("m.name").alias("name"), F.col("m.ordinal").alias("ordinal"))


CATEGORY_MEMBERS = T.StructType([T.StructField("query", T.StructType([T.StructField(
    "categorymembers", T.ArrayType(T.StructType([T.StructField("title", T.StringType())])))]))])


def category_titles(docs: DataFrame, col: str = "json") -> DataFrame:
    """S26 + F10: member titles, 'List of ...' pages excluded."""
    t = docs.select(F.explode(F.from_json(col, CATEGORY_MEMBERS)["query"]["categorymembers"]).alias("m"))
    t = t.select(F.col("m.title").alias("name"))
    return t.where(FL.exclude_prefix("name"))


def page_contents(pages: DataFrame, titles: DataFrame, title: str = "title", html: str = "html") -> DataFrame:
    """Pages for a list of titles (missing pages skipped), missing text
    -> ''."""
    p = pages.join(titles.select(title).distinct(), title, "left_semi")
    return p.select(title, F.coalesce(F.col(html), F.lit("")).alias("html"))
