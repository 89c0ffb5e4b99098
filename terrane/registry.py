"""Registry of named queries: each is a Spark job over the driver tables (or
what Spark derives from them), with an optional DuckDB oracle SQL text and the
SURVEY inventory ids it exercises."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}


def query(name: str, ids: str = "", sql: str | None = None):
    def wrap(fn):
        REGISTRY[name] = Entry(name, fn, sql, tuple(i for i in ids.split() if i))
        return fn
    return wrap


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (oracle parity at ``digits`` decimals)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def load_all() -> dict[str, Entry]:
    # importing the suite modules registers their queries
    from terrane.suite import spatial, tables, text, sources, knowledge, exports, feeds  # noqa: F401
    return REGISTRY
