"""Slippy-map tile binning and per-tile thinning.

Tile keys (z, x, y) are plain arithmetic on lon/lat; features are replicated
once per zoom with ``explode(sequence(zmin, zmax))``. Thinning keeps at most
``cap`` features per tile (lowest feature ids first) with a salted two-level
top-k, so a tile holding a third of all features is still ranked by many
tasks: each (tile, salt) sub-group keeps its own top ``cap``, and the final
rank runs over at most ``salt * cap`` survivors per tile.

Lines are cut to every tile they pass through (``cut_lines``): segments are
projected, keyed by the tiles on their way only, and clipped to each.
``thin_line_tiles`` keeps the ``cap`` lines with the longest part in a tile.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators import spatial as S

#: Parts of a segment shorter than this share of it count as touching a tile only.
TOUCH = 1e-9


def tile_xy(lon: Column, lat: Column, z: Column) -> tuple[Column, Column]:
    """Web-mercator tile column and row at zoom ``z`` (clamped to the grid)."""
    n = F.pow(F.lit(2.0), z)
    lat_r = F.radians(F.greatest(F.least(lat, F.lit(85.0511287798)), F.lit(-85.0511287798)))
    x = F.floor((lon + 180.0) / 360.0 * n)
    y = F.floor((F.lit(1.0) - F.log(F.tan(lat_r) + F.lit(1.0) / F.cos(lat_r)) / F.lit(math.pi)) / 2.0 * n)
    maxi = n - 1
    return (F.least(F.greatest(x, F.lit(0.0)), maxi).cast("long"),
            F.least(F.greatest(y, F.lit(0.0)), maxi).cast("long"))


def bin_tiles(points: DataFrame, zmin: int, zmax: int, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One row per (feature, zoom) with its tile key."""
    d = points.withColumn("z", F.explode(F.sequence(F.lit(zmin), F.lit(zmax))))
    x, y = tile_xy(F.col(lon), F.col(lat), F.col("z"))
    return d.withColumn("tx", x).withColumn("ty", y)


def top_k_per_group(df: DataFrame, group: list[str], order: list[str], k: int,
                    salt: int = 16, salt_of: list[str] | None = None) -> DataFrame:
    """Exact top-k rows per group by ``order`` with hot groups split by salt:
    the top k of a group is contained in the union of the top k of its salted
    sub-groups."""
    s = F.pmod(F.xxhash64(*[F.col(c) for c in (salt_of or order)]), F.lit(salt))
    d = df.withColumn("__salt", s)
    w1 = Window.partitionBy(*group, "__salt").orderBy(*order)
    d = d.withColumn("__r1", F.row_number().over(w1)).where(F.col("__r1") <= k)
    w2 = Window.partitionBy(*group).orderBy(*order)
    d = d.withColumn("__r2", F.row_number().over(w2)).where(F.col("__r2") <= k)
    return d.drop("__salt", "__r1", "__r2")


def thin_tiles(points: DataFrame, zmin: int, zmax: int, cap: int, key: str = "feature_id",
               lon: str = "lon", lat: str = "lat") -> tuple[DataFrame, DataFrame]:
    """(kept features per zoom, per-tile counts before / after thinning)."""
    b = bin_tiles(points.select(key, lon, lat), zmin, zmax, lon, lat)
    kept = top_k_per_group(b, ["z", "tx", "ty"], [key], cap)
    counts = b.groupBy("z", "tx", "ty").agg(F.count("*").alias("n"))
    kc = kept.groupBy("z", "tx", "ty").agg(F.count("*").alias("n_kept"))
    return kept, counts.join(kc, ["z", "tx", "ty"], "left").fillna(0, ["n_kept"])


def _mercator(lon: str, lat: str) -> tuple[Column, Column]:
    """World coordinates from 0 to 1, x to the east and y to the south."""
    lat_r = F.radians(F.greatest(F.least(F.col(lat), F.lit(85.0511287798)), F.lit(-85.0511287798)))
    y = (F.lit(1.0) - F.log(F.tan(lat_r) + F.lit(1.0) / F.cos(lat_r)) / F.lit(math.pi)) / 2.0
    return (F.col(lon) + 180.0) / 360.0, y


def _inside(a: str, b: str, cell: str) -> tuple[Column, Column]:
    """Where (from 0 to 1) a segment enters and leaves the strip of a tile in
    one dimension. What runs along a border is in the strip that begins there,
    at the end of the world in the last one."""
    d = F.col(b) - F.col(a)
    at = F.least(F.floor(F.col(a)), F.pow(F.lit(2.0), F.col("z")).cast("long") - 1)
    lo, hi = (F.col(cell) - F.col(a)) / d, (F.col(cell) + 1 - F.col(a)) / d
    beside = F.when(at == F.col(cell), F.lit(0.0)).otherwise(F.lit(2.0))
    return (F.when(d == 0, beside).otherwise(F.least(lo, hi)),
            F.when(d == 0, F.lit(1.0)).otherwise(F.greatest(lo, hi)))


def cut_lines(lines: DataFrame, zmin: int, zmax: int, key: str = "feature_id", geom: str = "geom") -> DataFrame:
    """Lines clipped to the tiles they pass through: key, z, tx, ty and the part
    (ax, ay)-(bx, by) of one segment, in units of that zoom's tiles.

    Rows grow with a line's length in tiles, not with its envelope. A part that
    only touches a tile is no part of it. A line of one vertex is a part of
    length 0 in its tile; lines without vertices have none. Latitudes beyond
    the projection are moved to its edge."""
    seg = S.segment_rows(lines.select(F.col(key).alias("feature_id"), F.col(geom).alias("geom")))
    (ax, ay), (bx, by) = _mercator("ax", "ay"), _mercator("bx", "by")
    world = seg.select("feature_id", ax.alias("wax"), ay.alias("way"), bx.alias("wbx"), by.alias("wby"))
    n = F.pow(F.lit(2.0), F.col("z"))
    at = world.withColumn("z", F.explode(F.sequence(F.lit(zmin), F.lit(zmax)))).select(
        "feature_id", "z", *[(F.col("w" + c) * n).alias(c) for c in ("ax", "ay", "bx", "by")])
    cells = S.segment_cells(at, 1.0).withColumnsRenamed({"cx": "tx", "cy": "ty"})
    (in_x, out_x), (in_y, out_y) = _inside("ax", "bx", "tx"), _inside("ay", "by", "ty")
    parts = (cells.withColumn("t0", F.greatest(F.lit(0.0), in_x, in_y)).withColumn("t1", F.least(F.lit(1.0), out_x, out_y))
             .where((F.col("t1") - F.col("t0") > TOUCH) & F.col("tx").between(0, n - 1) & F.col("ty").between(0, n - 1)))
    along = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * F.col(t)
    return parts.select(F.col("feature_id").alias(key), "z", "tx", "ty",
                        along("ax", "bx", "t0").alias("ax"), along("ay", "by", "t0").alias("ay"),
                        along("ax", "bx", "t1").alias("bx"), along("ay", "by", "t1").alias("by"))


def thin_line_tiles(lines: DataFrame, zmin: int, zmax: int, cap: int, key: str = "feature_id",
                    geom: str = "geom") -> tuple[DataFrame, DataFrame]:
    """(kept lines per tile with the length of their part, per-tile number and
    length of lines before and after thinning). The lines with the longest part
    in a tile stay (lengths to 6 decimals of a tile), then smaller keys."""
    long = F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))
    tile = ["z", "tx", "ty"]
    per_line = (cut_lines(lines, zmin, zmax, key, geom).groupBy(*tile, key)
                .agg(F.round(F.sum(long), 6).alias("length")).withColumn("shorter", -F.col("length")))
    kept = top_k_per_group(per_line, tile, ["shorter", key], cap, salt_of=[key]).drop("shorter")
    sums = lambda df, n, length: df.groupBy(*tile).agg(F.count("*").alias(n), F.sum("length").alias(length))
    counts = sums(per_line, "n", "length").join(sums(kept, "n_kept", "length_kept"), tile)
    return kept, counts
