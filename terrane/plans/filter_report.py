"""P9 filter-and-highlight: F6 builder -> matched rows + a count message.
The count comes from an observation of the same pass that produces the rows
(no second scan)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from terrane.operators import filters as FL
from terrane.plans.inspect import _label_from_name


def filter_layer(layer: DataFrame, col: str, op: str, value: str | None = None) -> DataFrame:
    """Rows of ``layer`` matching one builder condition."""
    return layer.where(FL.build_filter(col, op, value, layer.schema[col].dataType))


def filter_report(layer: DataFrame, table: str, col: str, op: str, value: str | None = None):
    """(matched rows, Observation holding ``n``, message builder). Collect or
    write the rows first; then ``message(obs)`` formats the status line."""
    obs = Observation(f"filter_{table}")
    rows = filter_layer(layer, col, op, value).observe(obs, F.count(F.lit(1)).alias("n"))

    def message(o: Observation = obs) -> str:
        n = int(o.get.get("n", 0))
        if n == 0:
            return "No matches, or query error."
        return (f"{_label_from_name(table)}: {n} features match — "
                f"{_label_from_name(col)} {op} '{(value or '').strip()}'.")
    return rows, obs, message
