"""Exact deduplication with a persistent digest index.

The index is a Spark table in the shared folder, bucketed and sorted by
digest: one row per distinct text with the id of the document that stays. A
new batch is reduced to one row per digest, sort-merge anti-joined with the
index (the index is read in its buckets, without a shuffle), and what is new
is appended.

Texts are compared after each run of ASCII white space has become one space,
by the SHA-256 of their UTF-8.

Edge cases: null texts are empty texts and equal to each other; of repeated
rows with one id, one stays; rows without an id come after all others; an
empty table gives no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import NUMBER, fanout, numbered, text_or_empty
from terrane.session import materialize, remove_folder, scratch, shared_dir

_SPACE_RUN = r"[\x20\x09-\x0D]+"


def text_digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(text), _SPACE_RUN, " "), 256))


class DigestIndex:
    """digest -> keeper (doc_id, number of its row) at ``path``, in ``buckets`` buckets.

    An existing folder is taken up again under a new table name (the table is
    only this session's name for the folder); give the same ``buckets`` and the
    same type of ``number``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, number: str = "long"):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{uuid.uuid4().hex[:12]}"
        spark.sql(f"CREATE TABLE {self.name} (digest binary, keep_id long, keep_row {number}) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """Take the name out of the session; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, groups: DataFrame) -> None:
        """Append the digests of ``groups`` (one row each) that the index lacks."""
        fresh = groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        # written to a staging table first: a table can't be read and appended to at once
        fresh = materialize(fresh.select("digest", "keep_id", "keep_row"), "digests-new")
        (fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest")
         .write.mode("append").format("parquet").option("path", self.path)
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))


def batch_groups(rows: DataFrame) -> DataFrame:
    """One row per digest: its first row by (id, row id), ids before nulls."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                           F.col("row_id").alias("row")))
    return (rows.groupBy("digest").agg(first.alias("f"))
            .select("digest", F.col("f.id").alias("keep_id"), F.col("f.row").alias("keep_row")))


def exact_decisions(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2,
                    row_id: str | None = None) -> DataFrame:
    """doc_id, row_id, keep_id, group_size, kept, text_sha256 of every row.

    The rows enter the index as ``batches`` ranges of ascending ids, so that
    the document indexed first is the one with the smallest id. ``row_id`` is
    the scan's own row number, stable for a stored table. Each later join has
    a stored table on either side, which lets Spark split a hot digest."""
    spark = docs.sparkSession
    number = F.monotonically_increasing_id() if row_id is None else F.col(row_id)
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"),
                                   number.alias("row_id")), "digests")
    if index is None:
        index = DigestIndex(spark, shared_dir(spark, "digest-index"), fanout(spark))
    cuts = rows.agg(F.percentile_approx(
        "doc_id", [(i + 1) / batches for i in range(batches - 1)]).alias("c")).first()["c"] or []
    low = None
    for cut in [*sorted({*cuts}), None]:
        some = rows
        if low is not None:
            some = some.filter(F.col("doc_id").isNull() | (F.col("doc_id") > low))
        if cut is not None:
            some = some.filter(F.col("doc_id") <= cut)
        index.add(batch_groups(some))
        low = cut
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    groups = materialize(sizes.join(index.read(), "digest"), "digest-groups")
    return (rows.join(groups, "digest")
            .select("doc_id", "row_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                    (F.col("row_id") == F.col("keep_row")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows of which an earlier equal text stays. Rows are
    told apart by file and place where ``docs`` reads stored files; else the
    numbered rows are stored first. Only the numbers of the dropped rows stay
    on disk."""
    spark = docs.sparkSession
    rows = numbered(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("input"))
    with scratch(spark):
        path = shared_dir(spark, "digest-index")
        index = DigestIndex(spark, path, fanout(spark), NUMBER)
        try:
            gone = materialize(exact_decisions(rows.select("input.doc_id", "input.text", "number"), index, row_id="number")
                               .filter(~F.col("kept")).select("row_id"), "copies", keep=True)
        finally:
            index.close()
            remove_folder(spark, path)
    return (rows.join(gone, rows["number"] == gone["row_id"], "left_anti")
            .select(*[F.col("input").getField(c).alias(c) for c in docs.columns]))
