"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.session import materialize

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Rows of an Arrow batch: batches hold whole texts, and a worker holds a few
#: batches at a time.
BATCH_ROWS = 1_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small in this session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fanout(spark: SparkSession) -> int:
    """Partitions to deal intermediate rows into: the session's own setting,
    which an operator of the cluster sizes to the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Type of the number of a row (``numbered``).
NUMBER = "struct<file: bigint, at: bigint>"


def numbered(rows: DataFrame, *columns, name: str = "numbered") -> DataFrame:
    """``columns`` of ``rows`` and ``number``, which tells rows apart and is the
    same each time the result is read. Rows that come straight from stored
    files are numbered by file and place in it; others are stored first (and
    kept, see ``scratch``)."""
    plan = rows._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    if plan.nodeName().startswith(("Relation", "LogicalRelation")) and "_metadata" not in rows.columns:
        try:
            return rows.select(*columns, F.struct(F.xxhash64("_metadata.file_path").alias("file"),
                                                  F.col("_metadata.row_index").alias("at")).alias("number"))
        except AnalysisException:             # files without places of rows
            pass
    return materialize(rows.select(*columns, F.struct(
        F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at")).alias("number")), name, keep=True)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def texts_of(column: pa.Array) -> list[str]:
    """The strings of an Arrow column, null as the empty string."""
    return ["" if t is None else t for t in column.to_pylist()]


def utf8_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column without decoding it; null as b""."""
    return column.cast(pa.large_binary()).fill_null(b"").to_pylist()


def gather_slices(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + lens[i]] for every i, concatenated."""
    total = int(lens.sum())
    if total == 0:
        return flat[:0]
    ends = np.cumsum(lens)
    at = np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)
    return flat[at]


def runs_by_size(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to ``limit`` at most (one
    oversized entry makes a range of its own)."""
    out, begin, total = [], 0, 0
    for i, s in enumerate(sizes):
        if i > begin and total + s > limit:
            out.append((begin, i))
            begin, total = i, 0
        total += s
    if begin < len(sizes):
        out.append((begin, len(sizes)))
    return out


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser, element-wise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))
