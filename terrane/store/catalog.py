"""The layer store and its catalog: K1 write layer, K2 write table, K3 keyed
upsert, K4 list flattening, K5 init, A3 row counts, A5 / A9 summaries.

Layers and tables are versioned Parquet directories
``<base>/<schema>/<table>/v<n>`` and so is the catalog, ``<base>/_catalog/v<n>``:
a write makes the next version, complete once Spark has put ``_SUCCESS`` there,
and a read takes the newest complete one. What is being read is never
overwritten, a failed write leaves the version before in force, and no rename
is needed. The version before is kept for readers that opened it; older ones
are removed. A group of loads updates the catalog once (``Store.group``).
"""

from __future__ import annotations

import datetime as dt
import json
import re
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions import style as ST
from terrane.store.ordering import space_ordered

CATALOG_SCHEMA = T.StructType([
    T.StructField("schema_name", T.StringType(), False),
    T.StructField("table_name", T.StringType(), False),
    T.StructField("target", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("scope", T.StringType()),
    T.StructField("n_features", T.LongType()),
    T.StructField("validated", T.BooleanType()),
    T.StructField("notes", T.StringType()),
    T.StructField("loaded_at", T.TimestampType()),
])
TARGETS = ("map+db", "db")
KEY = ["schema_name", "table_name"]


# --------------------------------------------------------------------------- #
# K3 / A5 / A9 as pure DataFrame functions
# --------------------------------------------------------------------------- #

def upsert(old: DataFrame, new: DataFrame, loaded_at: dt.datetime | None = None) -> DataFrame:
    """K3: insert-or-update ``new`` rows (schema_name, table_name, target,
    source, scope, n_features) into catalog ``old`` on the key. Updated rows
    take target/source/scope/n_features and the load time, and keep validated
    and notes; inserted rows get validated=false, notes=null. One full outer
    join on the key (both sides are one row per layer)."""
    ts = F.lit(loaded_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).cast("timestamp")
    o = old.alias("o")
    n = new.alias("n")
    j = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in KEY], "full_outer")
    has_new = F.col("n.schema_name").isNotNull()
    return j.select(
        *[F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in KEY],
        *[F.when(has_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
          for c in ("target", "source", "scope", "n_features")],
        F.coalesce(F.col("o.validated"), F.lit(False)).alias("validated"),
        F.col("o.notes").alias("notes"),
        F.when(has_new, ts).otherwise(F.col("o.loaded_at").cast("timestamp")).alias("loaded_at"))


def summary(catalog: DataFrame) -> DataFrame:
    """A5 (+ X8, W6, X18): per group: layers, features, formatted total, the
    group's display rank and label, and the number of distinct groups."""
    g = catalog.groupBy("schema_name").agg(F.count("*").alias("n_layers"),
                                           F.sum("n_features").cast("long").alias("n_features"))
    # one row per group, so the group count is a window over a table of at most
    # as many rows as there are groups
    g = g.withColumn("n_groups", F.count("*").over(Window.partitionBy()))
    return g.select(
        "schema_name", "n_layers", "n_features",
        F.format_number("n_features", 0).alias("n_features_text"),
        ST.category_rank("schema_name").alias("category_rank"),
        ST.category_label("schema_name").alias("category_label"), "n_groups")


def totals(catalog: DataFrame) -> DataFrame:
    """Layers and features per target tier."""
    return catalog.groupBy("target").agg(F.count("*").alias("n_layers"),
                                         F.sum("n_features").cast("long").alias("n_features"))


# --------------------------------------------------------------------------- #
# K4 list flattening
# --------------------------------------------------------------------------- #

def plain_text(x, dtype: T.DataType):
    """Element text: floating numbers in plain decimal notation (no exponent),
    trailing zeros dropped; everything else cast to string."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        d = x.cast("double").try_cast("decimal(38,10)").cast("string")
        plain = F.regexp_replace(F.regexp_replace(d, r"0+$", ""), r"\.$", "")
        return F.coalesce(plain, x.cast("string"))
    return x.cast("string")


def _flatten_expr(name: str, dtype: T.DataType):
    c = F.col(f"`{name}`")
    if isinstance(dtype, T.ArrayType):
        s = F.transform(c, lambda x: plain_text(x, dtype.elementType))
        return F.when(c.isNull() | (F.size(c) == 0) | F.forall(c, lambda x: x.isNull()), None) \
            .otherwise(F.array_join(s, "; ", "NA")).alias(name)
    if isinstance(dtype, T.MapType):
        s = F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"].cast("string"),
                                                               e["value"].cast("string")))
        return F.when(c.isNull() | (F.size(c) == 0), None).otherwise(F.array_join(s, "; ")).alias(name)
    if isinstance(dtype, T.StructType):
        vals = F.array(*[c[f.name].cast("string") for f in dtype.fields])
        return F.when(c.isNull() | F.forall(vals, lambda x: x.isNull()), None) \
            .otherwise(F.array_join(vals, "; ", "NA")).alias(name)
    return c


def flatten_lists(df: DataFrame, geom: str | None = "geom") -> DataFrame:
    """K4: every array / map / struct column except the geometry becomes text:
    null, empty or all-null -> null, else the elements joined by '; ' (a null
    element prints 'NA')."""
    return df.select(*[F.col(f"`{f.name}`") if f.name == geom else _flatten_expr(f.name, f.dataType)
                       for f in df.schema.fields])


# --------------------------------------------------------------------------- #
# the store
# --------------------------------------------------------------------------- #

class Store:
    """Parquet layer store with a versioned catalog under ``base``."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")
        self._pending: list[tuple] | None = None
        #: what the last write of each layer (schema, table) measured of itself
        self.observed: dict[tuple[str, str], dict] = {}

    # K5 ---------------------------------------------------------------------
    def init(self) -> "Store":
        """An empty catalog; idempotent. Namespaces are folders under the base,
        made with their first layer."""
        if self._latest_version() is None:
            self._write_catalog(self.spark.createDataFrame([], CATALOG_SCHEMA), 0)
        return self

    def _catalog_root(self) -> str:
        return f"{self.base}/_catalog"

    def _catalog_path(self, v: int) -> str:
        return f"{self._catalog_root()}/v{v:06d}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _latest_version(self, root: str | None = None) -> int | None:
        vs = self._versions(root or self._catalog_root())
        return vs[-1] if vs else None

    def _versions(self, root: str) -> list[int]:
        """Complete versions under ``root``, oldest first."""
        jvm = self.spark._jvm
        path, fs = self._fs(root)
        if not fs.exists(path):
            return []
        vs = []
        for st in fs.listStatus(path):
            name = st.getPath().getName()
            m = re.fullmatch(r"v(\d{6})", name)
            if m and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                vs.append(int(m.group(1)))
        return sorted(vs)

    def _forget(self, root: str, keep: int = 2) -> None:
        for v in self._versions(root)[:-keep]:
            path, fs = self._fs(f"{root}/v{v:06d}")
            fs.delete(path, True)

    def catalog(self) -> DataFrame:
        v = self._latest_version()
        if v is None:
            return self.spark.createDataFrame([], CATALOG_SCHEMA)
        return self.spark.read.schema(CATALOG_SCHEMA).parquet(self._catalog_path(v))

    def upsert_catalog(self, rows: DataFrame, loaded_at: dt.datetime | None = None) -> None:
        v = self._latest_version()
        new = upsert(self.catalog(), rows, loaded_at)
        self._write_catalog(new, (v if v is not None else -1) + 1)

    def _write_catalog(self, rows: DataFrame, version: int) -> None:
        # a version that a write which died left incomplete is replaced
        (rows.select(*[f.name for f in CATALOG_SCHEMA.fields])
         .write.mode("overwrite").parquet(self._catalog_path(version)))
        self._forget(self._catalog_root())

    def set_validated(self, flags: DataFrame) -> None:
        """K3: ``validated`` of the layers in ``flags`` (schema_name, table_name,
        validated)."""
        v = self._latest_version()
        new = (self.catalog().withColumnRenamed("validated", "__old").join(flags, KEY, "left")
               .withColumn("validated", F.coalesce("validated", "__old")))
        self._write_catalog(new, (v if v is not None else -1) + 1)

    @contextmanager
    def group(self):
        """Loads inside the block enter the catalog together, at its end."""
        self._pending = []
        try:
            yield self
            rows, self._pending = self._pending, None
            if rows:
                self._upsert_rows(list({r[:2]: r for r in rows}.values()))
        finally:
            self._pending = None

    def root(self, schema: str, table: str) -> str:
        return f"{self.base}/{schema}/{table}"

    def path(self, schema: str, table: str) -> str:
        """The newest complete version of a layer or table."""
        root = self.root(schema, table)
        v = self._latest_version(root)
        return root if v is None else f"{root}/v{v:06d}"

    def read(self, schema: str, table: str, where: str = "1=1") -> DataFrame:
        """A stored layer or table with an optional predicate; a layer the
        catalog lists with 0 features reads as empty even if old files remain."""
        df = self.spark.read.parquet(self.path(schema, table)).where(F.expr(where))
        n = (self.catalog().where((F.col("schema_name") == schema) & (F.col("table_name") == table))
             .select("n_features").limit(1).collect())
        if n and n[0][0] == 0:
            return df.limit(0)
        return df

    def _register(self, schema, table, target, source, scope, n) -> None:
        if target not in TARGETS:
            raise ValueError(f"unknown target {target!r}")
        row = (schema, table, target, source, scope, int(n))
        if self._pending is not None:
            self._pending.append(row)
        else:
            self._upsert_rows([row])

    def _upsert_rows(self, rows: list[tuple]) -> None:
        self.upsert_catalog(self.spark.createDataFrame(
            rows, "schema_name string, table_name string, target string, source string, scope string, n_features long"))

    def register(self, rows: list[tuple]) -> None:
        """Enter (schema, table, target, source, scope, n) rows in the catalog
        together."""
        with self.group():
            for r in rows:
                self._register(*r)

    # K2 ---------------------------------------------------------------------
    def write_table(self, df: DataFrame | None, schema: str, table: str,
                    source: str = "", scope: str = "") -> int:
        """Overwrite the table when it has rows; register it as 'db' either way.
        The row count comes from an observation of the write itself."""
        target, n = self.put(df, schema, table, None)
        self._register(schema, table, target, source, scope, n)
        return n

    # K1 ---------------------------------------------------------------------
    def write_layer(self, df: DataFrame | None, schema: str, table: str,
                    source: str = "", scope: str = "", geom: str = "geom", batch: str | None = None,
                    ordered: bool = False, files: int | None = None, metrics: list | None = None) -> int:
        """No geometry column -> stored as a 'db' table (K2). Otherwise, when it
        has rows: geometry is set to 4326, list columns flattened, the table
        overwritten; registered as 'map+db' with its count (0 when empty, in
        which case nothing is written).

        ``ordered``: the layer is written in space-filling order (``ordering``;
        ``files`` of them, if given), so that bbox reads skip most of it.

        ``metrics``: named aggregates over the rows, worked out by the write
        itself (no second scan) and left in ``observed``.

        ``batch`` names what is written: when the layer's last write has that
        name and reached the catalog, nothing is done; when it did not get that
        far, only what is missing is done."""
        mark = self._mark(schema, table) if batch is not None else None
        if mark and mark["batch"] == batch and mark["done"] == "catalog":
            return int(mark["n"])
        if mark and mark["batch"] == batch:
            target, n = mark["target"], int(mark["n"])
        else:
            if ordered and df is not None and geom in df.columns:
                df = space_ordered(df, geom, files)
            target, n = self.put(df, schema, table, geom, metrics)
            if batch is not None:
                self._set_mark(schema, table, batch=batch, target=target, n=n, done="layer")
        self._register(schema, table, target, source, scope, n)
        if batch is not None:
            self._set_mark(schema, table, batch=batch, target=target, n=n, done="catalog")
        return n

    def put(self, df: DataFrame | None, schema: str, table: str, geom: str | None = "geom",
            metrics: list | None = None) -> tuple[str, int]:
        """Write without entering the catalog: (target, rows)."""
        if geom is None or (df is not None and geom not in df.columns):
            return "db", 0 if df is None else self._write(flatten_lists(df, geom=None), schema, table)
        if df is None:
            return "map+db", 0
        out = df.withColumn(geom, F.struct(*[F.col(f"{geom}.{f}") for f in
                                             ("kind", "parts", "xmin", "ymin", "xmax", "ymax")],
                                           F.lit(4326).alias("srid")))
        return "map+db", self._write(flatten_lists(out, geom), schema, table, metrics)

    def _mark(self, schema: str, table: str) -> dict | None:
        """What the layer's last named write noted of itself; None without one,
        or when the note was cut short."""
        path, fs = self._fs(f"{self.root(schema, table)}/_batch")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def _set_mark(self, schema: str, table: str, **note) -> None:
        path, fs = self._fs(f"{self.root(schema, table)}/_batch")
        out = fs.create(path, True)
        out.writeBytes(json.dumps(note))
        out.close()

    def _write(self, df: DataFrame, schema: str, table: str, metrics: list | None = None) -> int:
        """The next version, with the row count observed during the write (A3).
        An empty result leaves the previous version as it was."""
        obs = Observation(f"rows_{schema}_{table}")
        observed = df.observe(obs, F.count(F.lit(1)).alias("n"), *(metrics or []))
        root = self.root(schema, table)
        last = self._latest_version(root)
        path = f"{root}/v{(last if last is not None else -1) + 1:06d}"
        observed.write.mode("overwrite").parquet(path)
        self.observed[schema, table] = got = obs.get
        n = int(got.get("n", 0))
        if n == 0:
            p, fs = self._fs(path)
            fs.delete(p, True)
        self._forget(root)
        return n


def local_store(spark: SparkSession, base: str | None = None) -> Store:
    from terrane.session import shared_dir
    return Store(spark, base or shared_dir(spark, "store")).init()


