"""T1 live-feed refresh with Structured Streaming.

Feed payloads (alerts, air quality, fire detections, sensors) land as files
in a directory. A file stream picks up new files; each micro-batch is
normalised and fully replaces its layer through the store (K1), which also
touches the catalog (K3). Full-replace semantics per batch need no watermark
or state. The batch's number names the write, so a batch that is replayed
after a failure does only what is missing. ``availableNow`` processes what has landed and stops (a scheduled
refresh); ``processingTime`` keeps polling. The checkpoint lives under the
session's shared checkpoint folder so a restarted query resumes exactly.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from terrane.session import ensure_checkpoint_dir


def feed_checkpoint(spark: SparkSession, landing: str, schema: str, table: str) -> str:
    """The feed's own folder under the shared checkpoint folder: the same for
    each start, so that a restart goes on where the last run ended."""
    name = f"feed-{schema}-{table}-{zlib.crc32(landing.encode()):08x}"
    return ensure_checkpoint_dir(spark).rstrip("/") + "/" + name


def refresh_feed(spark: SparkSession, store, landing: str, schema: T.StructType,
                 normalise: Callable[[DataFrame], DataFrame], layer: tuple[str, str],
                 source: str = "feed", scope: str = "live", fmt: str = "json",
                 available_now: bool = True, interval: str = "30 seconds",
                 checkpoint: str | None = None):
    """Start the refresh stream; returns the StreamingQuery."""
    stream = spark.readStream.schema(schema).format(fmt).load(landing)
    s, t = layer
    place = checkpoint or feed_checkpoint(spark, landing, s, t)

    def replace(batch: DataFrame, epoch: int) -> None:
        # a batch that is run again after a failure writes nothing twice
        store.write_layer(normalise(batch), s, t, source, scope, batch=f"{place}#{epoch}")

    w = stream.writeStream.foreachBatch(replace).option("checkpointLocation", place)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()
