"""Group loads P1-P7 over landed payloads.

A group load is a loop over metadata rows (manifest entries, discovered
layers, themes): each entry is an independent Spark job that reads its
payload, normalises it and writes it through the store (K1/K2). Entries run
side by side under job tags, for a limited time each; the catalog is upserted
once per group. The loop collects a small status table (layer, n, error); a
failing or late entry is recorded and the group continues.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import geom as G
from terrane.functions import text as TX
from terrane.operators import relational as R

#: Seconds that one entry of a group may take.
CAP_S = 240.0
STATUS_SCHEMA = "layer string, n long, error string"


def _slug(s: str) -> str:
    import re
    return re.sub(r"^_|_$", "", re.sub(r"[^A-Za-z0-9]+", "_", s).lower())


@dataclass
class Source:
    """An entry of a group load: what to read and where it goes. ``table``:
    stored without geometry (K2)."""

    schema: str
    name: str
    read: Callable[[], DataFrame | None]
    title: str = ""
    scope: str = "bbox"
    table: bool = False


class _Load(threading.Thread):
    """One entry as Spark jobs under a tag of their own."""

    def __init__(self, spark: SparkSession, store, source: Source, slots: threading.Semaphore):
        super().__init__(daemon=True)
        self.spark, self.store, self.source, self.slots = spark, store, source, slots
        self.tag = f"load-{uuid.uuid4().hex}"
        self.began: float | None = None
        self.late = False
        self.step, self.target, self.n, self.error = "read", None, 0, None

    def run(self) -> None:
        with self.slots:
            sc = self.spark.sparkContext
            sc.setLocalProperty("spark.scheduler.pool", "loads")
            sc.addJobTag(self.tag)
            self.began = time.monotonic()
            try:
                df = self.source.read()
                self.step = "write"
                self.target, self.n = self.store.put(df, self.source.schema, self.source.name,
                                                     None if self.source.table else "geom")
            except Exception as exc:  # noqa: BLE001 - recorded in the status table
                self.error = exc
            finally:
                sc.removeJobTag(self.tag)

    def cancel(self) -> None:
        self.late = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)


def run_sources(spark: SparkSession, store, sources: list[Source], cap_s: float = CAP_S, workers: int = 4,
                register_failures: bool = True, register_empty: bool = True, grace_s: float = 10.0) -> DataFrame:
    """Load entries side by side, ``workers`` at a time, each for ``cap_s``
    seconds at most: Spark jobs of an entry that takes longer are cancelled. The
    catalog is written once, when all have ended. An entry that could not be read
    registers 0 features unless ``register_failures`` is off, one whose write
    failed or that was cancelled registers nothing. Returns the status table, in
    the order of the entries."""
    slots = threading.Semaphore(workers)
    loads = [inheritable(_Load, spark, store, s, slots) for s in sources]
    for x in loads:
        x.start()
    for x in loads:
        gone = None
        while x.is_alive() and (gone is None or time.monotonic() - gone < grace_s):
            x.join(0.1)
            for y in loads:          # the cap holds for all that run, not for the one waited for
                if y.is_alive() and y.began is not None and time.monotonic() - y.began > cap_s:
                    y.cancel()
            gone = gone or (time.monotonic() if x.late else None)
    status, rows = [], []
    for x, s in zip(loads, sources):
        layer, n, error = f"{s.schema}.{s.name}", int(x.n), None
        if x.late and (x.is_alive() or x.error is not None):
            n, error = 0, "timeout"
        elif x.error is not None:
            n, error = 0, f"{x.step}: {type(x.error).__name__}"
            if x.step == "read" and register_failures:
                rows.append((s.schema, s.name, "db" if s.table else "map+db", s.title, s.scope, 0))
        elif n == 0 and not register_empty:
            error = "empty"
        else:
            rows.append((s.schema, s.name, x.target, s.title, s.scope, n))
        status.append((layer, n, error))
    if rows:
        store.register(rows)
    return spark.createDataFrame(status, STATUS_SCHEMA)


def inheritable(kind, spark: SparkSession, *args):
    """A thread that has the calling thread's Spark properties."""
    t = kind(spark, *args)
    t.run = inheritable_thread_target(spark)(t.run)
    return t


def load_group(spark: SparkSession, store, schema: str, entries: list[dict] | DataFrame,
               reader: Callable[[dict], DataFrame | None], scope: str = "bbox",
               register_failures: bool = True, cap_s: float = CAP_S, workers: int = 4) -> DataFrame:
    """For each entry {key, title, ...} (a list, or manifest rows): read ->
    layer ``schema.slug(key)``. A failed read still registers 0 features (the
    reference's external loader); an error inside the write registers
    nothing. Returns the status table."""
    if isinstance(entries, DataFrame):
        entries = [r.asDict() for r in entries.orderBy("key").collect()]   # metadata rows
    sources = [Source(schema, _slug(e["key"]), partial(reader, e), e.get("title") or "", scope) for e in entries]
    return run_sources(spark, store, sources, cap_s, workers, register_failures)


def load_city(spark: SparkSession, store, services: DataFrame, preferred: list[str],
              reader: Callable[[dict], DataFrame | None], cap_s: float = CAP_S, workers: int = 4) -> DataFrame:
    """Discovered layers -> preferred filter + rank -> slug -> dedupe
    (before any load) -> load each; empty and failed layers are skipped without
    a catalog row."""
    plan = R.discover_layers(services, preferred).select("url", "name", "slug").orderBy("slug").collect()
    sources = [Source("city", r.slug, partial(reader, {"url": r.url, "name": r.name}), "city server", "city")
               for r in plan]
    return run_sources(spark, store, sources, cap_s, workers, register_failures=False, register_empty=False)


# --------------------------------------------------------------------------- #
# Tagged features
# --------------------------------------------------------------------------- #

# OSM themes (table -> tag key) and the business tag keys.
OSM_THEMES = {"roads": "highway", "buildings": "building", "waterways": "waterway", "landuse": "landuse",
              "amenities": "amenity", "leisure": "leisure", "railways": "railway", "power": "power",
              "shops": "shop"}
BUSINESS_KEYS = ("shop", "office", "craft", "amenity", "tourism", "healthcare")


def theme_layers(features: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """P7 / S13 + G13: per tag key, the features carrying it reduced to the
    theme's dominant geometry kind, keeping (name, geometry); a missing name
    column becomes null."""
    present = [k for k in keys if k in features.columns]
    base = features if "name" in features.columns else features.withColumn("name", F.lit(None).cast("string"))
    t = R.explode_themes(base, present, [id_col, "name", "kind", "geom"])
    return R.dominant_kind(t, "theme")


def load_themes(spark: SparkSession, store, features: DataFrame, themes: dict[str, str] | None = None,
                schema: str = "osm", source: str = "OpenStreetMap", id_col: str = "id",
                cap_s: float = CAP_S, workers: int = 4) -> DataFrame:
    """Each theme's features (name, geometry of its dominant kind) as a
    layer ``schema.theme``; a theme whose key the features lack registers 0.
    Returns the status table."""
    def read(key: str) -> DataFrame | None:
        if key not in features.columns:
            return None
        return theme_layers(features, [key], id_col).select(id_col, "name", "kind", "geom")
    sources = [Source(schema, theme, partial(read, key), source) for theme, key in (themes or OSM_THEMES).items()]
    return run_sources(spark, store, sources, cap_s, workers)


def business_points(features: DataFrame, keys: tuple[str, ...] = BUSINESS_KEYS,
                    id_col: str = "id") -> DataFrame:
    """P5: union of the business themes (a feature with two tags appears
    twice), each reduced to its dominant kind, collapsed to planar centroids."""
    t = theme_layers(features, list(keys), id_col)
    cx, cy = G.centroid_sql("geom")
    return t.select("theme", id_col, "name", G.point(F.expr(cx), F.expr(cy)).alias("geom"))


def slug_table_names(entries: DataFrame, key: str = "key") -> DataFrame:
    """P1 naming: manifest key -> table name."""
    return entries.withColumn("table_name", TX.slug(F.col(key)))
