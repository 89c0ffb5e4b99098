"""P12 per-layer validation: placement (inside the region, not at null
island), geometry (one kind, closed rings), count against an expected
number, attribute completeness, coverage of the region by grid cells, and
join-key match rate. The measures are one set of aggregates: over a layer that
stands (``layer_checks``), or gathered by the write that stores it
(``load_checked``), which needs no second scan. The result is check rows
(layer, check, expected, got, ok), and a layer passing all checks is flagged
validated in the catalog (K3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.config import BBox
from terrane.operators import relational as R


#: Cells of the region's grid along one side; their 64 flags fit in a long.
GRID = 8


def measures(layer: DataFrame, region: BBox, geom: str = "geom", attrs: list[str] | None = None) -> list[Column]:
    """The aggregates that the checks rest on, all of fixed size per task."""
    g = F.col(geom)
    rings = F.flatten(g["parts"])
    open_rings = F.size(F.filter(rings, lambda r: (F.element_at(r, 1)["x"] != F.element_at(r, -1)["x"])
                                 | (F.element_at(r, 1)["y"] != F.element_at(r, -1)["y"])))
    inside = ((g["xmin"] >= region.xmin) & (g["xmax"] <= region.xmax)
              & (g["ymin"] >= region.ymin) & (g["ymax"] <= region.ymax))
    null_island = (F.abs(g["xmin"]) < 1e-9) & (F.abs(g["ymin"]) < 1e-9)

    def place(v, low, high):
        return F.least(F.floor((v - low) / (high - low) * GRID), F.lit(GRID - 1)).cast("int")
    cell = place(g["xmin"], region.xmin, region.xmax) * GRID + place(g["ymin"], region.ymin, region.ymax)
    kinds = [F.coalesce(F.max((g["kind"] == k).cast("int")), F.lit(0)) for k in ("point", "line", "poly")]
    aggs = [F.count(F.lit(1)).alias("n_rows"),
            F.count_if(inside).alias("n_inside"),
            F.count_if(null_island).alias("n_null_island"),
            (kinds[0] + kinds[1] + kinds[2]).alias("n_kinds"),
            F.coalesce(F.sum(F.when(g["kind"] == "poly", open_rings).otherwise(0)), F.lit(0)).alias("n_open_rings"),
            F.count_if(g.isNull()).alias("n_null_geom"),
            F.bit_count(F.coalesce(F.bit_or(F.when(inside, _flag(cell))), F.lit(0).cast("long"))).alias("n_cells")]
    return aggs + [F.count(F.col(f"`{c}`")).alias(f"nn_{i}") for i, c in enumerate(_attributes(layer, geom, attrs))]


def _flag(cell: Column) -> Column:
    """A long with the bit of the cell set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), cell)


def _attributes(layer: DataFrame, geom: str, attrs: list[str] | None) -> list[str]:
    return attrs or [c for c in layer.columns if c != geom]


def _checks(row: DataFrame, name: str, attrs: list[str], expected: int | None, min_cells: int | None) -> DataFrame:
    """Check rows from one row of measures."""
    def check(label, expected_col, got_col, ok_col):
        return F.struct(F.lit(label).alias("check"), expected_col.cast("string").alias("expected"),
                        got_col.cast("string").alias("got"), ok_col.alias("ok"))

    n = F.col("n_rows")
    checks = [
        check("count", F.lit(expected) if expected is not None else F.lit(">0"), n,
              (n == F.lit(expected)) if expected is not None else (n > 0)),
        check("inside_region", n, F.col("n_inside"), F.col("n_inside") == n),
        check("not_null_island", F.lit(0), F.col("n_null_island"), F.col("n_null_island") == 0),
        check("single_kind", F.lit(1), F.col("n_kinds"), F.col("n_kinds") <= 1),
        check("rings_closed", F.lit(0), F.col("n_open_rings"), F.col("n_open_rings") == 0),
        check("geometry_present", F.lit(0), F.col("n_null_geom"), F.col("n_null_geom") == 0),
    ]
    if min_cells is not None:
        checks.append(check("coverage", F.lit(f">={min_cells}"), F.col("n_cells"), F.col("n_cells") >= min_cells))
    for i, c in enumerate(attrs):
        checks.append(check(f"populated:{c}", n, F.col(f"nn_{i}"),
                            (F.col(f"nn_{i}") > 0) | ((n == 0) & F.lit(expected == 0))))
    return row.select(F.explode(F.array(*checks)).alias("c")).select(
        F.lit(name).alias("layer"), "c.check", "c.expected", "c.got", "c.ok")


def layer_checks(layer: DataFrame, name: str, region: BBox, expected: int | None = None,
                 geom: str = "geom", attrs: list[str] | None = None, min_cells: int | None = None) -> DataFrame:
    """Check rows of a layer, in one aggregate pass over it. ``min_cells``: the
    fewest cells of the region's 8 by 8 grid that hold a feature's corner."""
    return _checks(layer.agg(*measures(layer, region, geom, attrs)), name, _attributes(layer, geom, attrs), expected,
                   min_cells)


def load_checked(store, layers: dict[tuple[str, str], DataFrame], region: BBox,
                 rules: dict[tuple[str, str], dict] | None = None) -> DataFrame:
    """Store the layers, check them by what their writes measured, and flag them
    in the catalog. ``rules`` may give a layer's ``expected`` count, ``attrs``
    and ``min_cells``. Returns the check rows with the layer's flag. A layer
    without rows is not written (K1); its measures are those of no rows."""
    spark, out = store.spark, None
    rules = rules or {}
    with store.group():
        for (schema, table), layer in layers.items():
            attrs = rules.get((schema, table), {}).get("attrs")
            store.write_layer(layer, schema, table, metrics=measures(layer, region, attrs=attrs))
    for (schema, table), layer in layers.items():
        rule = rules.get((schema, table), {})
        attrs = _attributes(layer, "geom", rule.get("attrs"))
        got = store.observed[schema, table]
        names = ["n_rows", "n_inside", "n_null_island", "n_kinds", "n_open_rings", "n_null_geom", "n_cells",
                 *(f"nn_{i}" for i in range(len(attrs)))]
        row = spark.createDataFrame([tuple(int(got.get(c) or 0) for c in names)], ", ".join(f"{c} long" for c in names))
        some = _checks(row, f"{schema}.{table}", attrs, rule.get("expected"), rule.get("min_cells"))
        out = some if out is None else out.unionByName(some)
    mark_validated(store, out)
    flags = store.catalog().select(F.concat_ws(".", "schema_name", "table_name").alias("layer"), "validated")
    return out.join(flags, "layer")


def key_check(layer: DataFrame, table: DataFrame, name: str, key: str, table_key: str | None = None,
              width: int | None = None, min_rate: float = 1.0) -> DataFrame:
    """Join-key match rate between a layer and a table."""
    m = R.match_rate(layer, table, key, table_key, width)
    return m.select(F.lit(name).alias("layer"), F.lit(f"key_match:{key}").alias("check"),
                    F.col("n_features").cast("string").alias("expected"),
                    F.col("n_matched").cast("string").alias("got"),
                    (F.col("match_rate") >= min_rate).alias("ok"))


def mark_validated(store, checks: DataFrame) -> None:
    """P12 into K3: set ``validated`` in the store's catalog for the layers of
    ``checks`` (named schema.table); other catalog rows keep theirs."""
    at = F.split("layer", r"\.", 2)
    store.set_validated(validated_flags(checks).select(
        at[0].alias("schema_name"), at[1].alias("table_name"), "validated"))


def validated_flags(checks: DataFrame) -> DataFrame:
    """(layer, validated): true when every check of the layer passed."""
    return checks.groupBy("layer").agg(F.min(F.col("ok").cast("int")).cast("boolean").alias("validated"))
