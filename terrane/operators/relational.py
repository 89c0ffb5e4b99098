"""Attribute operators: aggregations (A1, A2, A5, A8-A10), joins (J1, J5-J8),
window idioms (W1, W2), set operations (U1-U6) and theme selection (S13, U2,
G13, F16). All are DataFrame plans; every grouping uses partial aggregation
and no group is gathered into a single task unless its size is bounded by the
data model (noted where so)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.filters import padded_key
from terrane.functions import text as TX
from terrane.session import materialize


# --------------------------------------------------------------------------- #
# aggregations
# --------------------------------------------------------------------------- #

def distinct_concat(df: DataFrame, key: str, value: str, sep: str = ";",
                    out: str | None = None) -> DataFrame:
    """A1: per key, the distinct non-null values sorted and joined by ``sep``;
    rows with a null key or value are dropped first. Distinct pairs are formed
    by a partial-aggregated distinct before the per-key gather, so a key's
    gathered list is bounded by its number of distinct values."""
    d = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value).distinct()
    return d.groupBy(key).agg(
        F.array_join(F.sort_array(F.collect_list(value)), sep).alias(out or value))


def first_per_key(df: DataFrame, key: str | list[str], order: list[str],
                  cols: list[str]) -> DataFrame:
    """A2: the first row per key in input order (``order`` is an explicit
    ordinal); a null key is a key. ``min(struct(order..., cols...))`` is a
    partial aggregate, so a hot key costs one row per map task."""
    keys = [key] if isinstance(key, str) else list(key)
    # own field names: a column may be both in the order and in the result
    s = F.min(F.struct(*[F.col(f"`{o}`").alias(f"o{i}") for i, o in enumerate(order)],
                       *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])).alias("__f")
    g = df.groupBy(*keys).agg(s)
    return g.select(*keys, *[F.col(f"__f.c{i}").alias(c) for i, c in enumerate(cols)])


def facility_rollup(records: DataFrame, key: str = "registry_id", program: str = "pgm_sys_acrnm",
                    order: list[str] | None = None,
                    meta: tuple[str, ...] = ("primary_name", "location_address", "city_name",
                                             "postal_code", "site_type_name")) -> DataFrame:
    """Flat facility x program records -> one row per facility with the
    metadata of its first record (A2, optional columns only, F17) and its
    distinct sorted program list (A1), left-joined on the key (J1)."""
    present = [c for c in meta if c in records.columns]
    order = order or ["__ord"]
    firsts = first_per_key(records, key, order, present)
    programs = distinct_concat(records, key, program)
    return firsts.join(programs, key, "left")


def count_by(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """A5: rows per group."""
    return df.groupBy(key).agg(F.count("*").alias(name))


def pivot_wide(long: DataFrame, key: str, var: str, values: list[str],
               est: str = "estimate", moe: str = "moe") -> DataFrame:
    """Long (key, variable, estimate, moe) -> one row per key with
    ``<value>E`` and ``<value>M`` columns. The value list is given, so Spark
    needs no extra pass to find the pivot values."""
    p = long.groupBy(key).pivot(var, values).agg(F.first(est).alias("E"), F.first(moe).alias("M"))
    ren = [F.col(key)]
    for v in values:
        ren.append(F.col(f"`{v}_E`").alias(f"{v}E"))
        ren.append(F.col(f"`{v}_M`").alias(f"{v}M"))
    return p.select(*ren)


# --------------------------------------------------------------------------- #
# joins
# --------------------------------------------------------------------------- #

def attach(layer: DataFrame, table: DataFrame, key: str, table_key: str | None = None,
           width: int | None = None, agg: dict[str, Column] | None = None,
           order: list[str] | None = None) -> DataFrame:
    """Attach a table to a layer on a key. Keys are normalised to text
    (left-padded to ``width`` when given, F8); the table is reduced to one row
    per key first, then left-joined: by ``agg``, or to the key's first row by
    ``order`` (columns that number the input rows; without it the smallest row
    by all columns). Spark chooses a broadcast join only when the reduced table
    is under its threshold."""
    tk = table_key or key

    def norm(c):
        return padded_key(F.col(c), width)

    t = table.withColumn("__k", norm(tk))
    if agg:
        t = t.groupBy("__k").agg(*[v.alias(k) for k, v in agg.items()])
    else:
        cols = [c for c in table.columns if c != tk]
        t = first_per_key(t, "__k", order or [], cols) if cols else t.select("__k").distinct()
    lay = layer.withColumn("__k", norm(key))
    return lay.join(t, "__k", "left").drop("__k")


def match_rate(layer: DataFrame, table: DataFrame, key: str, table_key: str | None = None,
               width: int | None = None) -> DataFrame:
    """J7 report: features, matched features and rate for a key join."""
    tk = table_key or key

    def norm(df, c):
        return df.select(padded_key(F.col(c), width).alias("__k"))

    keys = norm(table, tk).distinct().withColumn("__hit", F.lit(1))
    j = norm(layer, key).join(keys, "__k", "left")
    return j.agg(F.count("*").alias("n_features"),
                 F.count("__hit").alias("n_matched")).withColumn(
        "match_rate", F.when(F.col("n_features") > 0, F.col("n_matched") / F.col("n_features")))


def triples_with_labels(triples: DataFrame, props: DataFrame, labels: DataFrame,
                        subject: str, lang: str = "en") -> DataFrame:
    """Statements of one subject with property and value labels. Each
    predicate maps to its property through ``props`` (directClaim); labels in
    ``lang`` come from ``labels`` (id, lang, label); a missing label falls back
    to the id itself, a literal value to the literal."""
    t = triples.where(F.col("subject") == subject)
    t = t.join(props, t.predicate == props.direct_claim, "inner").select(
        F.col("prop"), F.col("value"))
    lab = labels.where(F.col("lang") == lang).select("id", "label")
    pl = lab.select(F.col("id").alias("prop"), F.col("label").alias("propLabel"))
    vl = lab.select(F.col("id").alias("value"), F.col("label").alias("valueLabel"))
    out = t.join(pl, "prop", "left").join(vl, "value", "left")
    return out.select("prop", F.coalesce("propLabel", "prop").alias("propLabel"),
                      "value", F.coalesce("valueLabel", "value").alias("valueLabel"))


def layer_diff(before: DataFrame, after: DataFrame, key: str = "layer_id") -> DataFrame:
    """Ids added and removed between two snapshots (left anti joins)."""
    added = after.select(key).distinct().join(before.select(key), key, "left_anti")
    removed = before.select(key).distinct().join(after.select(key), key, "left_anti")
    return (added.withColumn("change", F.lit("added"))
            .unionByName(removed.withColumn("change", F.lit("removed"))))


def intersect_ordered(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """U4: left rows whose key is in right, keeping left's order column."""
    return left.join(right.select(key).distinct(), key, "left_semi").orderBy(order)


# --------------------------------------------------------------------------- #
# windows
# --------------------------------------------------------------------------- #

def first_by_rank(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Keep the first row per key under the given ordering. A min over a
    struct of the sort keys plus the row: partial aggregation, no window."""
    cols = df.columns
    sk = [o.alias(f"__s{i}") for i, o in enumerate(order)]
    s = F.struct(*sk, *[F.col(c) for c in cols])
    g = df.groupBy(F.col(key).alias("__key")).agg(F.min(s).alias("__m"))
    return g.select(*[F.col(f"__m.{c}").alias(c) for c in cols])


def global_ordinal(df: DataFrame, order: list[str], name: str = "ordinal",
                   checkpoint: bool = True) -> DataFrame:
    """1-based position of every row in the total order ``order`` (keys must
    be unique). Rows are range-partitioned and sorted (Spark's sort), numbered
    within their partition, and offset by the row counts of earlier
    partitions; only one count per partition is combined, so no partition
    holds more than its range. The sorted data (with its partition ids) is
    written as a table in the shared folder, so a recomputation sees the
    same partitioning."""
    s = df.orderBy(*order)
    s = s.withColumn("__pid", F.spark_partition_id())
    if checkpoint:
        s = materialize(s, "ordinal")
    w = Window.partitionBy("__pid").orderBy(*order)
    s = s.withColumn("__rn", F.row_number().over(w))
    counts = s.groupBy("__pid").agg(F.count("*").alias("__n"))
    cw = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("__off", F.coalesce(F.sum("__n").over(cw), F.lit(0)))
    out = s.join(F.broadcast(offs.select("__pid", "__off")), "__pid")
    return out.withColumn(name, (F.col("__off") + F.col("__rn")).cast("long")).drop("__pid", "__rn", "__off")


def jitter_grid(ordinal: Column, lon0: float, lat0: float, step: float = 0.0009,
                per_row: int = 12) -> tuple[Column, Column]:
    """Deterministic pin grid around a point from a 1-based ordinal."""
    i = ordinal - 1
    lon = F.lit(lon0) + (F.pmod(i, F.lit(per_row)) - 6) * F.lit(step)
    lat = F.lit(lat0) + (F.floor(i / per_row) - 6) * F.lit(step)
    return lon, lat


# --------------------------------------------------------------------------- #
# themes and preferred sources
# --------------------------------------------------------------------------- #

def explode_themes(df: DataFrame, keys: list[str], id_cols: list[str]) -> DataFrame:
    """One row per (feature, matched tag key): a feature carrying two of
    the keys appears twice, exactly as a UNION ALL of per-key scans."""
    tagged = F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("theme"),
                                                               F.col(k).cast("string").alias("tag")))
                       for k in keys])
    return (df.select(*id_cols, F.explode(F.filter(tagged, lambda t: t.isNotNull())).alias("t"))
            .select(*id_cols, "t.theme", "t.tag"))


# Dominant-geometry preference for a theme.
KIND_RANK = {"poly": 1, "line": 2, "point": 3}


def dominant_kind(df: DataFrame, group: str, kind: str = "kind") -> DataFrame:
    """Per group keep only rows of its dominant geometry kind (polygons,
    else lines, else points). The per-group minimum is a tiny aggregate joined
    back on the group key."""
    rank = F.create_map(*[x for k, v in KIND_RANK.items() for x in (F.lit(k), F.lit(v))])
    d = df.withColumn("__kr", F.element_at(rank, F.col(kind)))
    best = d.groupBy(group).agg(F.min("__kr").alias("__best"))
    return d.join(best, group).where(F.col("__kr") == F.col("__best")).drop("__kr", "__best")


def preferred_rank(url: Column, preferred: list[str]) -> Column:
    """F16: 1-based index of the first preferred service name the URL contains
    (literal match); null when none does."""
    hits = F.array(*[F.when(F.instr(url, F.lit(p)) > 0, F.lit(i + 1)) for i, p in enumerate(preferred)])
    return F.array_min(hits)


def discover_layers(services: DataFrame, preferred: list[str], name: str = "name",
                    url: str = "url", type_col: str = "type", order: str = "ordinal") -> DataFrame:
    """P2 plan: S22 vector services only -> U3 distinct URL -> F16 preferred
    filter and rank -> X1 slug -> F19 non-empty -> W2 first per slug by
    (rank, input order)."""
    s = services.where(F.col(type_col).isin("MapServer", "FeatureServer"))
    s = first_by_rank(s, url, [F.col(order)])
    s = s.withColumn("pref_rank", preferred_rank(F.col(url), preferred)).where(F.col("pref_rank").isNotNull())
    s = s.withColumn("slug", TX.slug(F.col(name))).where(F.length("slug") > 0)
    return first_by_rank(s, "slug", [F.col("pref_rank"), F.col(order)])


def union_all(dfs: list[DataFrame]) -> DataFrame:
    """Union of pages / parts by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
