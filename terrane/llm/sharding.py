"""Sharding by weighted rendezvous hashing of record keys.

Each (key, shard) pair gets a uniform number u from a 64-bit hash, and the
key goes to the shard with the largest -weight / ln(u). A key's shard depends
on the key, the shards and their weights only. One more shard wins exactly the
keys for which its own score is the largest, so nothing moves between old
shards; a shard's share of keys is its share of the weights.

Edge cases: a null key is a key like any other (it has a hash of its own, so
null keys share a shard); repeated keys share a shard and get different slots;
a null text has size 16 and crc 0; an empty table gives no rows; input columns
other than the key and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import text_or_empty
from terrane.session import materialize

ROW_OVERHEAD = 16


def _score(key: Column, shard: Column, weight: Column, seed: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\u0000null")),
                                           shard.cast("int"), F.lit(seed)), 11)
    u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(2 ** 53))
    return -weight / F.ln(u)


def rendezvous(key: Column, weights: list[float], seed: int = 0) -> tuple[Column, Column]:
    """(shard, its score) of a key over shards 0 .. len(weights) - 1; a tie
    goes to the smaller shard."""
    ws = F.array(*[F.lit(float(w)) for w in weights])
    best = F.array_max(F.transform(
        F.sequence(F.lit(0), F.lit(len(weights) - 1)),
        lambda i: F.struct(_score(key, i, F.get(ws, i), seed).alias("score"), (-i).alias("i"))))
    return (-best["i"]).cast("int"), best["score"]


def assign_shards(docs: DataFrame, key: str, weights: list[float], added_weight: float = 1.0,
                  seed: int = 0) -> DataFrame:
    """``docs`` plus shard and grown_shard (the shard once another one of
    ``added_weight`` is there); columns of these names are replaced."""
    shard, score = rendezvous(F.col(key), weights, seed)
    n = len(weights)
    out = docs.withColumn("_best", F.struct(shard.alias("shard"), score.alias("score")))
    added = _score(F.col(key), F.lit(n), F.lit(float(added_weight)), seed)
    return (out.withColumn("shard", F.col("_best.shard"))
            .withColumn("grown_shard", F.when(added > F.col("_best.score"), F.lit(n))
                        .otherwise(F.col("_best.shard")).cast("int"))
            .drop("_best"))


def with_slots(sharded: DataFrame) -> DataFrame:
    """``sharded`` plus slot: a gapless number from 0 in each shard.

    The rows are written once. Numbers are given within (shard, file) and moved
    up by the shard's rows in earlier files, so no task ever holds a whole
    shard: the largest group is one file's rows of one shard, and the window
    over a shard sees one row per file."""
    rows = materialize(sharded, "shards")
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"),
                       F.col("_metadata.row_index").alias("_row"))
    per_file = rows.groupBy("shard", "_file").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    base = per_file.select("shard", "_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("shard", "_file").orderBy("_row")
    return (rows.withColumn("_at", F.row_number().over(inside) - 1)
            .join(base, ["shard", "_file"])
            .withColumn("slot", (F.col("_base") + F.col("_at")).cast("long"))
            .drop("_file", "_row", "_at", "_base"))


def shard_documents(docs: DataFrame, weights: list[float], added_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law (``key``), shard, slot, grown_shard of
    every document."""
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"))
    return with_slots(assign_shards(slim, "doc_id", weights, added_weight)).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
