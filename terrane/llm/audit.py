"""Filter interaction audit over failing-id relations.

Every filter has a stored relation of the ids that fail it; one more relation
holds all ids, and all are bucketed and sorted by id, so that joins between
them need no shuffle. For a set of filters that has run (a prefix of some
order), a left-anti join with each of its relations leaves the survivors; a
left-semi join of these with the next filter's relation gives what that filter
takes away, from all documents and from the failing ids of every other filter
that are still left. What earlier filters took from a filter's failing ids is
redundant to it; the rest it removes. As survivors depend on the set and not on
its order, each set is joined once, along its letters in ascending order, and
the orders read the sums.

Edge cases: null texts are empty, a null part is the empty string, a null id
comes after all others (its row fails the copy filter if a row with an id has
the same text) and has no label; rows that repeat an id count one by one, equal
label rows once; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import uuid
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import fanout, text_or_empty
from terrane.session import materialize, shared_dir

MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITALS_PERCENT = 5
BUCKET_ROWS = 200_000
JOB_PREFIXES = 4
_ALL = ""                     # tag of the relation of all ids


def row_failures(text: str = "text") -> dict[str, Column]:
    """The failure conditions that a text alone decides, by letter."""
    t = text_or_empty(text)
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < MIN_WORDS,
            "B": F.size(F.array_distinct(words)) * 100 < n * MIN_DISTINCT_PERCENT,
            "C": capitals * 100 > F.length(t) * MAX_CAPITALS_PERCENT,
            "D": t.rlike(r"[#$%&*|]")}


def judged_rows(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column], copies: str = "E",
                part: str = "source") -> DataFrame:
    """id, part, good, toxic and one boolean per filter, for every row: the
    given conditions, and ``copies`` (a row with a smaller doc_id has the text)."""
    seen = materialize(docs.select(
        F.monotonically_increasing_id().alias("id"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text_or_empty(), 256)).alias("digest"),
        *(c.alias(f) for f, c in conditions.items())), "audit-rows")
    # stored tables on both sides, so that Spark can split a hot text or id
    first = materialize(seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
                        .filter("n > 1 AND first IS NOT NULL").select("digest", "first"), "audit-first")
    marks = materialize(labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("marked"))
                        .agg(F.max((F.col("quality") == 1)).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")),
                        "audit-marks")
    none = F.lit(False)
    return (seen.join(first, "digest", "left").join(marks, F.col("doc_id") == F.col("marked"), "left")
            .select("id", "part", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"),
                    *conditions, (F.col("first").isNotNull()
                                  & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))).alias(copies)))


class FailingIds:
    """The relations of a judged table: ``of(letter)`` has the ids that fail a
    filter, ``tagged`` the rows of all relations (tag: the letter, or "" for
    all ids). Bucketed by id; ``close`` takes the tables' names out of the
    session."""

    def __init__(self, judged: DataFrame, letters: str):
        self.spark, self.letters = judged.sparkSession, letters
        stored = materialize(judged, "judged")
        # rows are slim, so small tables get fewer buckets than the session has partitions
        self.buckets, self.names = min(fanout(self.spark), stored.count() // BUCKET_ROWS + 1), []
        tags = F.filter(F.array(F.lit(_ALL), *(F.when(F.col(f), f) for f in letters)), lambda x: x.isNotNull())
        self._of = {f: self._store(stored.filter(f).select("id"), "id long") for f in letters}
        self.tagged = self._store(stored.select("id", "part", "good", "toxic", F.explode(tags).alias("tag")),
                                  "id long, part string, good boolean, toxic boolean, tag string")

    def _store(self, rows: DataFrame, schema: str) -> DataFrame:
        name = f"failing_ids_{uuid.uuid4().hex[:12]}"
        path = shared_dir(self.spark, "failing-ids")
        self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (id) SORTED BY (id) "
                       f"INTO {self.buckets} BUCKETS LOCATION '{path}'")
        self.names.append(name)
        (rows.repartition(self.buckets, "id").sortWithinPartitions("id")
         .write.mode("append").format("parquet").option("path", path)
         .bucketBy(self.buckets, "id").sortBy("id").saveAsTable(name))
        return self.spark.table(name)

    def of(self, letter: str) -> DataFrame:
        return self._of[letter].hint("merge")

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def prefixes_of(letters: str) -> list[str]:
    return ["".join(p) for k in range(len(letters) + 1) for p in combinations(letters, k)]


def taken(ids: FailingIds, prefixes: list[str]) -> DataFrame:
    """part, prefix, tag, n, good, toxic: of each relation's ids that survive
    all filters of a prefix (letters, ascending) but its last, those that the
    last one fails. The empty prefix has the whole relations."""
    out = None
    for prefix in prefixes:
        rows = ids.tagged.filter(~F.col("tag").isin(*prefix)) if prefix else ids.tagged
        for f in prefix[:-1]:
            rows = rows.join(ids.of(f), "id", "left_anti")
        for f in prefix[-1:]:
            rows = rows.join(ids.of(f), "id", "left_semi")
        rows = rows.select(F.lit(prefix).alias("prefix"), "part", "tag", "good", "toxic")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("part", "prefix", "tag").agg(
        F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"),
        F.sum(F.col("toxic").cast("long")).alias("toxic"))


def all_taken(ids: FailingIds) -> DataFrame:
    """``taken`` of every prefix, stored: a few prefixes to a job, since each
    task reports the metrics of all joins of its job to the driver."""
    path, prefixes = shared_dir(ids.spark, "audit-counts"), prefixes_of(ids.letters)
    for i in range(0, len(prefixes), JOB_PREFIXES):
        taken(ids, prefixes[i:i + JOB_PREFIXES]).write.mode("append").parquet(path)
    return ids.spark.read.parquet(path)


def _plan(letters: str) -> tuple[list, list]:
    """(set, prefix) for every set of filters and the prefixes that sum up to
    it, and (filter_order, step, set, filter) of all orders."""
    chains = [(s, s[:i]) for s in prefixes_of(letters) for i in range(1, len(s) + 1)]
    steps = [("".join(o), i + 1, "".join(sorted(o[:i])), o[i]) for o in permutations(letters) for i in range(len(o))]
    return chains, steps


def order_audit(counts: DataFrame, letters: str) -> DataFrame:
    """The report of every part, order and step from the sums of ``taken``."""
    spark = counts.sparkSession
    chains, steps = _plan(letters)
    whole = counts.filter("prefix = ''").drop("prefix")
    lost = (counts.join(F.broadcast(spark.createDataFrame(chains, "set string, prefix string")), "prefix")
            .filter("tag = '' OR instr(set, tag) = 0")
            .groupBy("part", "set", "tag").agg(F.sum("n").alias("n"), F.sum("good").alias("good"),
                                               F.sum("toxic").alias("toxic")))
    size, others = len(letters), {f: "".join(x for x in letters if x != f) for f in letters}
    turns = [(s, f, factorial(len(s)) * factorial(size - 1 - len(s)))
             for s, f in sorted({(s, f) for _, _, s, f in steps})]
    # every part has every turn, also where nothing fails
    turn = F.explode(F.array(*(F.struct(F.lit(s).alias("set"), F.lit(f).alias("filter"),
                                        F.lit(w).cast("long").alias("weight"), F.lit(s == others[f]).alias("last"))
                               for s, f, w in turns)))
    base = (whole.filter(F.col("tag") == _ALL).select("part", F.col("n").alias("rows"), turn.alias("t"))
            .select("part", "rows", "t.*"))
    fails = whole.select("part", F.col("tag").alias("filter"), *(F.col(c).alias(f"f_{c}") for c in ("n", "good", "toxic")))
    before = lost.select("part", "set", F.col("tag").alias("filter"),
                         *(F.col(c).alias(f"l_{c}") for c in ("n", "good", "toxic")))
    gone = lost.filter(F.col("tag") == _ALL).select("part", "set", F.col("n").alias("gone"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    told = (base.join(fails, ["part", "filter"], "left").join(before, ["part", "set", "filter"], "left")
            .join(gone, ["part", "set"], "left")
            .select("part", "set", "filter", "weight", "last",
                    (zero("f_n") - zero("l_n")).alias("removed"), zero("l_n").alias("redundant"),
                    (zero("f_good") - zero("l_good")).alias("good_lost"),
                    (zero("f_toxic") - zero("l_toxic")).alias("toxic_lost"),
                    (F.col("rows") - zero("gone")).alias("alive")))
    told = materialize(told, "audit-turns")
    sums = told.groupBy("part", "filter").agg(F.sum(F.col("weight") * F.col("removed")).alias("shapley"),
                                              F.max(F.when(F.col("last"), F.col("removed"))).alias("unique_fails"))
    orders = spark.createDataFrame(steps, "filter_order string, step int, set string, filter string")
    return (told.join(sums, ["part", "filter"]).join(F.broadcast(orders), ["set", "filter"])
            .select("part", "filter_order", "step", "filter", (F.col("alive") - F.col("removed")).alias("kept"),
                    "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over ``docs``, by source."""
    conditions = row_failures()
    letters = "".join(conditions) + "E"
    ids = FailingIds(judged_rows(docs, labels, conditions), letters)
    try:
        return order_audit(all_taken(ids), letters)
    finally:
        ids.close()
