"""Layers written in space-filling order, so that a bbox read skips files, row
groups and pages by their statistics.

The key is the Morton code of the envelope's centre: 31 bits of longitude and
latitude, interleaved. Rows are range-partitioned and sorted by it, so a file
holds neighbours and the statistics of its envelope columns are narrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BITS = 31


def _spread_bits(v: Column) -> Column:
    """The low 31 bits of ``v``, with a zero before each."""
    for shift in (16, 8, 4, 2, 1):
        # runs of ``shift`` ones and ``shift`` zeros
        mask = sum(((1 << shift) - 1) << at for at in range(0, 64, 2 * shift))
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def morton_key(x: Column, y: Column, bounds: tuple[float, float, float, float] = (-180.0, -90.0, 180.0, 90.0)) -> Column:
    """Morton code (long, not negative) of a place; what lies outside the
    bounds counts as on their edge. Null where a coordinate is null or NaN."""
    def steps(v: Column, lo: float, hi: float) -> Column:
        at = F.floor((v - lo) / (hi - lo) * float(1 << _BITS))
        inside = F.least(F.greatest(at, F.lit(0)), F.lit((1 << _BITS) - 1)).cast("long")
        return F.when(v.isNotNull() & ~F.isnan(v), inside)     # least and greatest skip nulls
    x0, y0, x1, y1 = bounds
    return _spread_bits(steps(x, x0, x1)).bitwiseOR(F.shiftleft(_spread_bits(steps(y, y0, y1)), 1))


def space_ordered(df: DataFrame, geom: str = "geom", files: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by the Morton code of its envelopes'
    centres. ``files``: number of partitions; by default AQE sizes them.

    Equal places are told apart by a hash of the row, so that a place that
    holds a third of all rows goes to many tasks; so do rows without a place,
    which come first. Rows that are equal in all columns stay together."""
    g = F.col(geom)
    key = morton_key((g["xmin"] + g["xmax"]) / 2, (g["ymin"] + g["ymax"]) / 2)
    row = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()
                       and not isinstance(f.dataType, (T.VariantType, T.NullType))])
    by = ("__place", "__row")
    keyed = df.withColumn("__place", F.coalesce(key, F.lit(-1))).withColumn("__row", row)
    parted = keyed.repartitionByRange(*((files,) if files else ()), *by)
    return parted.sortWithinPartitions(*by).drop(*by)
