"""Attribute filters and projections: F3, F4, F6-F14, F17-F19, S24.
Each builds a Column (or a column list from the schema) so Catalyst can push
the predicate into the Parquet scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def where_sql(df: DataFrame, where: str = "1=1") -> DataFrame:
    """free-form SQL predicate (default keeps everything)."""
    return df.where(F.expr(where))


# The filter builder's operators.
FILTER_OPS = ("=", "!=", ">", "<", ">=", "<=", "LIKE", "ILIKE", "IS NULL", "IS NOT NULL")
_NUMERIC = re.compile(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$")


def parse_number(val: str) -> float | None:
    """The builder's numeric test: a value that parses as a number is compared
    as a number, else as a string."""
    if val is None:
        return None
    v = val.strip()
    if v.lower() in ("inf", "-inf", "+inf", "nan"):
        return float(v)
    return float(v) if _NUMERIC.match(v) else None


def build_filter(col: str, op: str, value: str | None = None, dtype: T.DataType | None = None) -> Column:
    """one (column, operator, value) condition. The value is trimmed;
    LIKE / ILIKE wrap it as %value% (its own % and _ stay wildcards); null
    tests ignore the value. Identifiers are quoted, values are literals, so no
    SQL text is assembled. A value that parses as a number compares as a
    number with a numeric column and as a string with a text column; without
    the column's ``dtype``, row by row, as a number where the row's value is
    one. Any other value compares as a string."""
    if op not in FILTER_OPS:
        raise ValueError(f"unsupported operator {op!r}")
    c = F.col(f"`{col}`")
    if op == "IS NULL":
        return c.isNull()
    if op == "IS NOT NULL":
        return c.isNotNull()
    v = (value or "").strip()
    if op == "LIKE":
        return c.cast("string").like(f"%{v}%")
    if op == "ILIKE":
        return c.cast("string").ilike(f"%{v}%")
    num = parse_number(v)

    def compare(left, lit):
        return {"=": left == lit, "!=": left != lit, ">": left > lit, "<": left < lit,
                ">=": left >= lit, "<=": left <= lit}[op]

    as_text = compare(c.cast("string"), F.lit(v))
    if num is None or isinstance(dtype, T.StringType):
        return as_text
    if isinstance(dtype, T.NumericType):
        return compare(c, F.lit(num))
    as_number = c.cast("string").try_cast("double")
    return F.when(as_number.isNotNull(), compare(as_number, F.lit(num))).otherwise(as_text)


def padded_key(c: Column, width: int | None) -> Column:
    """A key as text, left-padded with zeros to ``width``; longer keys stay
    whole (lpad would cut them)."""
    c = c.cast("string")
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c) if width else c


def in_list(col: str, ids: list[str], width: int | None = None) -> Column:
    """F8: key in a literal id list, keys normalised to text (left-padded)."""
    return padded_key(F.col(col), width).isin(list(ids))


def semi_filter(df: DataFrame, keys: DataFrame, col: str, key_col: str,
                width: int | None = None) -> DataFrame:
    """F8 with a key table: a left-semi join on text-normalised keys."""
    k = keys.select(padded_key(F.col(key_col), width).alias("__k")).distinct()
    return df.withColumn("__k", padded_key(F.col(col), width)).join(k, "__k", "left_semi").drop("__k")


def catalog_listing(catalog: DataFrame, exclude: tuple[tuple[str, str], ...] = (("external", "usa_structures"),)) -> DataFrame:
    """F9 + W3: map layers with features, minus excluded ones, ordered by
    schema then size descending."""
    cond = (F.col("target") == "map+db") & (F.col("n_features") > 0)
    for s, t in exclude:
        cond = cond & ~((F.col("schema_name") == s) & (F.col("table_name") == t))
    return (catalog.where(cond).select("schema_name", "table_name", "n_features")
            .orderBy(F.col("schema_name").asc(), F.col("n_features").desc()))


def exclude_prefix(col: str, prefix: str = "List of") -> Column:
    """value does not start with ``prefix``."""
    return ~F.col(col).startswith(prefix)


def name_search(q: str, *cols: str) -> Column:
    """case-insensitive literal substring in any of the columns; an
    empty query matches everything."""
    q = (q or "").strip().lower()
    if not q:
        return F.lit(True)
    conds = [F.instr(F.lower(F.col(c)), q) > 0 for c in cols]
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def facts_filter(df: DataFrame) -> DataFrame:
    """both labels present and the value label is not an id (Q...)."""
    return df.where(F.col("propLabel").isNotNull() & F.col("valueLabel").isNotNull()
                    & ~F.col("valueLabel").like("Q%"))


# Attribute columns hidden from cards and the inspector.
HIDDEN_COLS = r"^(geom|geometry|wkb|globalid|objectid|gid|fid|oid|id)$|_id$|code$|^se_anno|shape[_.]"
HIDDEN_COLS_INSPECTOR = r"^(geom|geometry|wkb|globalid|objectid|gid|fid|oid|id|popup_html)$|_id$|code$|^se_anno|shape[_.]"


def shown_columns(df: DataFrame, pattern: str = HIDDEN_COLS) -> list[str]:
    """attribute columns not matching the hidden-name pattern
    (case-insensitive)."""
    rx = re.compile(pattern, re.IGNORECASE)
    return [c for c in df.columns if not rx.search(c)]


# Columns the filter builder never offers.
FILTER_HIDDEN = ("geometry", "geom", "wkb_geometry", "gid", "objectid", "globalid", "fid", "oid",
                 "popup_html")


def filter_columns(df: DataFrame) -> list[str]:
    """Filterable columns in ordinal order: no geometry-typed (struct /
    binary) columns and none of the id / geometry names."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StructType, T.BinaryType)) or f.name in FILTER_HIDDEN:
            continue
        out.append(f.name)
    return out


def select_existing(df: DataFrame, cols: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """select the listed columns, with a typed null for each missing one."""
    types = types or {}
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast(types.get(c, "string")).alias(c)
                       for c in cols])


def non_empty(col: str) -> Column:
    """non-null and non-empty."""
    return F.col(col).isNotNull() & (F.length(F.col(col)) > 0)
