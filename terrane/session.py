"""Spark session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

# Session settings that matter at scale as much as locally: AQE re-plans joins and
# coalesces shuffle partitions at runtime and splits skewed join partitions; the
# broadcast threshold stays at Spark's default (10 MB) so only small sides go out.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.nestedSchemaPruning.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # collect_list/min(struct) aggregates keep hashing for more keys before
    # falling back to sort-based aggregation
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
}


def get_session(master: str | None = None, app: str = "terrane",
                shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Return the active session, or build one with the engine defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster names its shared folder in ``spark.checkpoint.dir``; use it.

    Only when it is unset (local runs, tests) do we choose one ourselves.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all "
                               "executors share; a driver-local folder can't be read by executors")
        d = tempfile.mkdtemp(prefix="terrane-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    ship_package(spark)
    return d


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per session, so that
    functions that run there find it whatever folder the driver started in."""
    sc = spark.sparkContext
    if getattr(sc, "_terrane_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="terrane-package-")
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "terrane"), "zip",
                                     os.path.dirname(root), os.path.basename(root)))
    sc._terrane_shipped = True


def shared_dir(spark: SparkSession, name: str | None = None) -> str:
    """A fresh sub-folder of the shared checkpoint folder; on a cluster the
    session names that folder, and without it this raises."""
    base = ensure_checkpoint_dir(spark)
    sub = f"{name or 'scratch'}-{uuid.uuid4().hex[:12]}"
    if "://" in base:
        return base.rstrip("/") + "/" + sub
    path = os.path.join(base, sub)
    return path


class Scratch:
    """Folders that were made inside a ``scratch`` block."""

    def __init__(self, outer: "Scratch | None"):
        self.outer, self.paths = outer, []


_SCRATCH: ContextVar[Scratch | None] = ContextVar("terrane_scratch", default=None)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder this library made, in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that ``materialize`` writes inside the block are removed at its
    end, except those written with ``keep`` (they belong to the block around
    it, if there is one). What leaves the block may read kept tables only."""
    own = Scratch(_SCRATCH.get())
    token = _SCRATCH.set(own)
    try:
        yield own
    finally:
        _SCRATCH.reset(token)
        for path in own.paths:
            remove_folder(spark, path)


def materialize(df, name: str = "stage", keep: bool = False):
    """Cut lineage by writing ``df`` as a Parquet table in the shared folder
    and reading it back: the plan runs once, and a recomputation after an
    executor loss reads the table instead of re-running upstream stages.
    ``keep``: the table outlives the ``scratch`` block it is written in."""
    path = shared_dir(df.sparkSession, name)
    own = _SCRATCH.get()
    if keep and own is not None:
        own = own.outer
    if own is not None:
        own.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
