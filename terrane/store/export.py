"""Exports K6-K10 and the web snapshot P13.

GeoJSON is written as one Feature per line (GeoJSON text sequences), so every
task writes its own part file and no layer passes through one task or the
driver. Coordinates are written with 6 decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators import tiles as TL

COORD_DIGITS = 6


def _xy(v: Column, digits: int) -> Column:
    return F.array(F.round(v["x"], digits), F.round(v["y"], digits))


def geometry_json(g: Column, digits: int = COORD_DIGITS) -> Column:
    """GeoJSON geometry object text for a geometry struct."""
    path = lambda r: F.transform(r, lambda v: _xy(v, digits))
    parts = g["parts"]
    single = F.size(parts) == 1
    pt = F.to_json(_xy(F.element_at(F.element_at(F.element_at(parts, 1), 1), 1), digits))
    mpt = F.to_json(F.transform(parts, lambda p: _xy(F.element_at(F.element_at(p, 1), 1), digits)))
    ln = F.to_json(path(F.element_at(F.element_at(parts, 1), 1)))
    mln = F.to_json(F.transform(parts, lambda p: path(F.element_at(p, 1))))
    pg = F.to_json(F.transform(F.element_at(parts, 1), path))
    mpg = F.to_json(F.transform(parts, lambda p: F.transform(p, path)))
    kind = g["kind"]
    gtype = (F.when(kind == "point", F.when(single, "Point").otherwise("MultiPoint"))
             .when(kind == "line", F.when(single, "LineString").otherwise("MultiLineString"))
             .otherwise(F.when(single, "Polygon").otherwise("MultiPolygon")))
    coords = (F.when(kind == "point", F.when(single, pt).otherwise(mpt))
              .when(kind == "line", F.when(single, ln).otherwise(mln))
              .otherwise(F.when(single, pg).otherwise(mpg)))
    return F.when(g.isNotNull(), F.concat(F.lit('{"type":"'), gtype, F.lit('","coordinates":'), coords, F.lit("}")))


def feature_json(df: DataFrame, geom: str = "geom", digits: int = COORD_DIGITS) -> DataFrame:
    """K7: one GeoJSON Feature text per row (attributes as properties)."""
    attrs = [c for c in df.columns if c != geom]
    props = F.to_json(F.struct(*[F.col(f"`{c}`") for c in attrs]))
    g = geometry_json(F.col(geom), digits)
    return df.select(F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'),
                              F.coalesce(g, F.lit("null")), F.lit("}")).alias("value"))


def write_geojson_seq(df: DataFrame, path: str, geom: str = "geom") -> None:
    """K7 sink: GeoJSON-seq part files; an empty layer writes nothing."""
    if df.limit(1).count() == 0:
        return
    feature_json(df, geom).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, geom: str = "geom") -> None:
    """K8: attributes only, header row, no row names."""
    df.drop(geom).write.mode("overwrite").option("header", True).csv(path)


def feature_record_json(df: DataFrame, geom: str = "geom") -> DataFrame:
    """K9: attributes of each feature as one JSON object (the inspector's
    download is this for the clicked feature)."""
    attrs = [c for c in df.columns if c != geom]
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in attrs])).alias("json"))


def catalog_json(catalog: DataFrame) -> DataFrame:
    """The catalog's (schema, table, target) rows as JSON objects."""
    return catalog.select(F.to_json(F.struct("schema_name", "table_name", "target")).alias("json"))


def export_web(store, out_dir: str, zmin: int = 10, zmax: int = 14, cap: int = 200) -> DataFrame:
    """Every 'db' table -> Parquet named schema__table (K6); every
    non-empty 'map+db' layer -> GeoJSON-seq (K7) plus, per tile, its counts and
    the features that thinning to ``cap`` keeps (K11, at each feature's envelope
    corner), with their attributes; the catalog -> JSON (K10). Returns one status row per output. The loop is
    over catalog rows (metadata), each export is its own distributed job."""
    spark = store.spark
    cat = store.catalog().select("schema_name", "table_name", "target", "n_features").collect()
    status = []
    for r in cat:
        name = f"{r.schema_name}__{r.table_name}"
        if not r.n_features:
            continue  # registered empty: nothing to export
        df = store.read(r.schema_name, r.table_name)
        if r.target == "db":
            df.write.mode("overwrite").parquet(f"{out_dir}/{name}.parquet")
            status.append((name, "parquet", int(r.n_features or 0)))
        else:
            write_geojson_seq(df, f"{out_dir}/layers/{name}.geojsonl")
            # a deterministic per-feature key (content hash) orders the cap
            key = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
            pts = df.select(F.col("geom.xmin").alias("lon"), F.col("geom.ymin").alias("lat"),
                            key.alias("feature_id"))
            kept, counts = TL.thin_tiles(pts, zmin, zmax, cap)
            features = df.withColumn("__key", key)
            (kept.select("z", "tx", "ty", F.col("feature_id").alias("__key")).distinct()
             .join(features, "__key").drop("__key").withColumn("layer", F.lit(name))
             .write.mode("overwrite").parquet(f"{out_dir}/tile_features/{name}"))
            counts.withColumn("layer", F.lit(name)).write.mode("overwrite").parquet(f"{out_dir}/tiles/{name}")
            status.append((name, "geojson", int(r.n_features)))
    catalog_json(store.catalog()).write.mode("overwrite").text(f"{out_dir}/catalog.json")
    status.append(("catalog", "json", len(cat)))
    return spark.createDataFrame(status, "output string, format string, n long")
