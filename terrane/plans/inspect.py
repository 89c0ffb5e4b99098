"""Feature cards (X16), inspector attribute rows (X17) and inspect-at-point
(P10 = J4 nearest + X17), all as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import style as ST
from terrane.functions import text as TX
from terrane.operators import filters as FL
from terrane.operators import spatial as S

# Columns tried, in order, as a card's title (case-insensitive).
TITLE_CANDIDATES = ("name", "primary_name", "title", "sch_name", "school_name", "facility",
                    "fac_name", "label")
CARD_FIELDS = 6


def title_column(cols: list[str]) -> str | None:
    low = {c.lower(): c for c in reversed(cols)}
    for cand in TITLE_CANDIDATES:
        if cand in low:
            return low[cand]
    return None


def _label_from_name(name: str) -> str:
    """X2 applied to a column name known on the driver (schema metadata)."""
    import re
    s = name.replace("_", " ")
    for a in TX.ACRONYMS:
        s = re.sub(rf"(?i)\b{a}\b", a.upper(), s)
    return s[:1].upper() + s[1:]


def feature_cards(layer: DataFrame, schema: str, table: str, geom: str = "geom",
                  max_rows: int | None = None) -> DataFrame:
    """One card per feature: title, category label and colour, and the
    first six cleaned (label, value) fields. Cards are a row-wise projection,
    so any layer size costs the same per row. ``max_rows``, off by default, is
    a screen limit: a larger layer then keeps its rows with empty fields."""
    id_col = "feature_id" if "feature_id" in layer.columns else None
    attrs = [c for c in layer.columns if c != geom]
    shown = FL.shown_columns(layer.select(*attrs))
    tcol = title_column(shown)
    fields = F.array(*[F.struct(F.lit(_label_from_name(c)).alias("label"),
                                TX.clean_value(F.col(f"`{c}`")).alias("value"))
                       for c in shown if c != tcol])
    fields = F.slice(F.filter(fields, lambda f: f["value"].isNotNull()), 1, CARD_FIELDS)
    table_label = _label_from_name(table)
    if tcol:
        t = F.col(f"`{tcol}`").cast("string")
        title = F.when(t.isNotNull() & (F.trim(t) != ""), t).otherwise(F.lit(table_label))
    else:
        title = F.lit(table_label)
    out = layer.select(*([F.col(id_col)] if id_col else []), title.alias("title"),
                       ST.category_label(F.lit(schema)).alias("category_label"),
                       ST.category_color(F.lit(schema)).alias("category_color"),
                       fields.alias("fields"))
    if max_rows is not None and not S.fits(layer, max_rows):
        return out.withColumn("fields", F.slice("fields", 1, 0))
    return out


def attribute_rows(layer: DataFrame, geom: str = "geom", key: str = "feature_id") -> DataFrame:
    """(feature, label, value) for every shown attribute, in column order,
    trimmed, with null / empty / 'NA' values removed."""
    attrs = [c for c in layer.columns if c not in (geom,)]
    shown = FL.shown_columns(layer.select(*attrs), FL.HIDDEN_COLS_INSPECTOR)
    kv = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(_label_from_name(c)).alias("key"),
                            F.trim(F.col(f"`{c}`").cast("string")).alias("value"))
                   for i, c in enumerate(shown)])
    rows = layer.select(key, F.explode(kv).alias("kv")).select(key, "kv.key", "kv.value")
    return rows.where(F.col("value").isNotNull() & (F.col("value") != "") & (F.col("value") != "NA"))


def inspect_at(clicks: DataFrame, layers: list[tuple[str, DataFrame]], radius_m: float = 200.0,
               poly_layers: set[str] | None = None) -> DataFrame:
    """P10: for every click, the winning (layer, feature) of J4."""
    return S.nearest_within(clicks, layers, radius_m, poly_layers=poly_layers)
