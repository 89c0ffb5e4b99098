"""Thematic classification and styling: X13 (breaks + colour ramp), X14
(legend ticks), X15 (height ramp), X18 (layer categories), W6 (category
order). Colours are interpolated per channel in the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import text as TX

# Layer categories (schema -> label, colour) in display order.
CATEGORIES = {
    "city": ("City", "#2563eb"),
    "schools": ("Schools", "#dc2626"),
    "business": ("Business", "#db2777"),
    "osm": ("OpenStreetMap", "#7c3aed"),
    "external": ("Federal & state", "#059669"),
    "apis": ("APIs & sensors", "#d97706"),
    "knowledge": ("Knowledge", "#0891b2"),
    "web": ("Web exports", "#475569"),
}
CATEGORY_ORDER = tuple(CATEGORIES)
DEFAULT_COLOR = "#475569"


@dataclass(frozen=True)
class Choropleth:
    label: str
    schema: str
    table: str
    col: str
    palette: tuple[str, ...]
    breaks: tuple[float, ...]
    unit: str
    na_color: str = "#cccccc"


# The four configured thematic overlays.
CHOROPLETHS = {
    "acs_income": Choropleth("Median household income (ACS)", "apis", "acs_tracts",
                             "median_household_incomeE",
                             ("#f7f7f7", "#d1e5f0", "#92c5de", "#4393c3", "#2166ac"),
                             (30000, 50000, 70000, 90000, 120000), "$/yr"),
    "acs_population": Choropleth("Total population (ACS)", "apis", "acs_tracts", "total_populationE",
                                 ("#f7f7f7", "#c7e9b4", "#7fcdbb", "#2c7fb8", "#253494"),
                                 (0, 2000, 4000, 6000, 10000), "people"),
    "acs_rent": Choropleth("Median gross rent (ACS)", "apis", "acs_tracts", "median_gross_rentE",
                           ("#f7f7f7", "#fee090", "#fc8d59", "#d73027"), (600, 900, 1200, 1500), "$/mo"),
    "cdc_mental": Choropleth("CDC PLACES: mental health (% poor)", "apis", "cdc_places_tracts_poly",
                             "MHLTH_CrudePrev", ("#f7f7f7", "#fee8c8", "#fdbb84", "#e34a33"),
                             (10, 15, 20, 25), "%"),
}

# Building height ramp (metres -> colour) and its NA colour.
HEIGHT_STOPS = ((2.0, "#e2e8f0"), (8.0, "#7c93c0"), (20.0, "#1d4ed8"))
HEIGHT_NA = "#cbd5e1"


def _rgb(hexcolor: str) -> tuple[int, int, int]:
    h = hexcolor.lstrip("#")
    return int(h[0:2], 16), int(h[2:4], 16), int(h[4:6], 16)


def _hex2(v: Column) -> Column:
    return F.lpad(F.lower(F.hex(v.cast("long"))), 2, "0")


def ramp(v, stops: list[tuple[float, str]], na_color: str) -> Column:
    """Linear interpolation between colour stops; clamped at both ends; null
    value -> ``na_color``. Channels are rounded half-up to integers."""
    v = F.col(v) if isinstance(v, str) else v
    vals = [float(s) for s, _ in stops]
    rgbs = [_rgb(c) for _, c in stops]

    def channel(k):
        expr = F.lit(float(rgbs[-1][k]))
        for i in range(len(vals) - 2, -1, -1):
            lo, hi = vals[i], vals[i + 1]
            a, b = float(rgbs[i][k]), float(rgbs[i + 1][k])
            seg = F.lit(a) + (v - F.lit(lo)) / F.lit(hi - lo) * F.lit(b - a)
            expr = F.when(v < F.lit(hi), seg).otherwise(expr)
        expr = F.when(v <= F.lit(vals[0]), F.lit(float(rgbs[0][k]))).otherwise(expr)
        return F.round(expr, 0)

    color = F.concat(F.lit("#"), _hex2(channel(0)), _hex2(channel(1)), _hex2(channel(2)))
    return F.when(v.isNull() | F.isnan(v), F.lit(na_color)).otherwise(color)


def choropleth_stops(cfg: Choropleth) -> list[tuple[float, str]]:
    """X13 stops: one before the first break, then every break; the palette
    has as many colours as breaks, so the last stop is clamped to the last
    colour (the configuration asks for one colour more than it holds)."""
    vals = [cfg.breaks[0] - 1] + list(cfg.breaks)
    cols = [cfg.palette[min(i, len(cfg.palette) - 1)] for i in range(len(vals))]
    return list(zip(vals, cols))


def classify(v, cfg: Choropleth) -> tuple[Column, Column]:
    """(bin, colour). ``bin`` = number of breaks <= v (0 below the first)."""
    v = F.col(v) if isinstance(v, str) else v
    breaks = F.array(*[F.lit(float(b)) for b in cfg.breaks])
    bin_ = F.when(v.isNull(), None).otherwise(F.size(F.filter(breaks, lambda b: v >= b)))
    return bin_, ramp(v, choropleth_stops(cfg), cfg.na_color)


def legend_position(v, cfg: Choropleth) -> Column:
    """Position (0-100 %) of a value along the legend bar, whose ticks sit
    evenly spaced at the breaks; linear between ticks, clamped at the ends."""
    v = F.col(v) if isinstance(v, str) else v
    b = [float(x) for x in cfg.breaks]
    n = len(b)
    pct = [100.0 * i / (n - 1) for i in range(n)]
    expr = F.lit(100.0)
    for i in range(n - 2, -1, -1):
        seg = F.lit(pct[i]) + (v - F.lit(b[i])) / F.lit(b[i + 1] - b[i]) * F.lit(pct[i + 1] - pct[i])
        expr = F.when(v < F.lit(b[i + 1]), seg).otherwise(expr)
    return F.when(v.isNull(), None).when(v <= F.lit(b[0]), F.lit(0.0)).otherwise(expr)


def legend_ticks(cfg: Choropleth) -> list[tuple[float, str]]:
    """(percent, label) per break, evenly spaced from 0 to 100."""
    n = len(cfg.breaks)
    out = []
    for j, b in enumerate(cfg.breaks):
        pct = 100.0 * j / (n - 1) if n > 1 else 0.0
        lab = f"{round(b / 1000)}k" if b >= 1000 else f"{b:g}"
        out.append((round(pct, 1), lab))
    return out


def legend_tick_rows(df: DataFrame, value: str, cfg: Choropleth) -> DataFrame:
    """X14 + X8 as rows: per break its number, place on the bar (percent), label
    and the rows of ``df`` that fall in the class that starts there."""
    n = len(cfg.breaks)
    bin_, _ = classify(value, cfg)
    counts = df.groupBy(bin_.alias("tick")).agg(F.count("*").alias("n"))
    ticks = df.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("tick"))
    brk = F.element_at(F.array(*[F.lit(float(b)) for b in cfg.breaks]), F.col("tick"))
    return (ticks.join(counts, "tick", "left")
            .select("tick", F.round((F.col("tick") - 1) * 100.0 / max(n - 1, 1), 1).alias("percent"),
                    TX.tick_label(brk).alias("label"), F.coalesce("n", F.lit(0)).alias("n")))


def height_color(h) -> Column:
    """Extrusion colour from HEIGHT."""
    return ramp(h, list(HEIGHT_STOPS), HEIGHT_NA)


def clean_height(h, default: float = 3.0, min_height: float = 2.0) -> Column:
    """HEIGHT null or below 2 -> 3."""
    h = F.col(h) if isinstance(h, str) else h
    return F.when(h.isNull() | (h < min_height), F.lit(default)).otherwise(h)


def category_label(schema) -> Column:
    """Category label for a schema (the schema itself when unknown)."""
    s = F.col(schema) if isinstance(schema, str) else schema
    m = F.create_map(*[x for k, (lab, _) in CATEGORIES.items() for x in (F.lit(k), F.lit(lab))])
    return F.coalesce(F.element_at(m, s), s)


def category_color(schema) -> Column:
    s = F.col(schema) if isinstance(schema, str) else schema
    m = F.create_map(*[x for k, (_, col) in CATEGORIES.items() for x in (F.lit(k), F.lit(col))])
    return F.coalesce(F.element_at(m, s), F.lit(DEFAULT_COLOR))


def category_rank(schema) -> Column:
    """Position in the fixed category order (unknown schemas last)."""
    s = F.col(schema) if isinstance(schema, str) else schema
    order = F.array(*[F.lit(c) for c in CATEGORY_ORDER])
    p = F.array_position(order, s)
    return F.when(p == 0, F.lit(len(CATEGORY_ORDER) + 1)).otherwise(p)
