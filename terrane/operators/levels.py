"""Multi-level grid keys: every geometry gets the grid level that fits its own
extent, so it has a bounded number of cells whatever its size.

Level l has cells of 2**l units (degrees or metres). A point has one cell at
the finest level; a polygon has the cells of its envelope, at the level at
which they are at most 3 by 3; a line has the cells that its paths pass
through, at the level at which its envelope is at most 10 by 10 cells. Since
sizes are powers of two, a cell's ancestors are bit shifts of its key.

Two geometries meet at the coarser of their levels: there one has its own cells
and the other the ancestors of its own. Rows are keyed by (side, level, cx, cy):
side 1 holds the query's own cells, side 2 its ancestors; a feature looks in
side 1 with its own cells and their ancestors at the query side's levels, and
in side 2 with its own cells. So each pair meets at one level only, and the join
is a plain equi-join that Spark can broadcast, sort-merge and split. A pair that
shares several cells is kept in the first of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import geom as G

MIN_LEVEL, MAX_LEVEL = -14, 40
#: Cells along the longer side of an envelope, about.
POLY_CELLS, LINE_CELLS = 2, 8
#: Most cells a geometry can have at its own level.
MOST_CELLS = (LINE_CELLS + 2) ** 2
KEYS = ["side", "level", "cx", "cy"]


def level_of(geom: str) -> Column:
    """The geometry's own level, from its stored envelope and kind."""
    g = F.col(geom)
    ext = F.greatest(g["xmax"] - g["xmin"], g["ymax"] - g["ymin"])
    per = F.when(g["kind"] == "line", F.lit(float(LINE_CELLS))).otherwise(F.lit(float(POLY_CELLS)))
    fit = F.ceil(F.log2(ext / per)).cast("int")
    return F.when(ext > 0, F.least(F.greatest(fit, F.lit(MIN_LEVEL)), F.lit(MAX_LEVEL))).otherwise(F.lit(MIN_LEVEL))


def _span(lo: str, hi: str) -> str:
    return f"sequence(CAST(floor({lo}) AS BIGINT), CAST(floor({hi}) AS BIGINT))"


def cells_sql(geom: str, edges: str, size: str) -> str:
    """Distinct cells (array<struct<cx, cy>>) of a geometry at its own level:
    those of the envelope, or for a line those of its edges. An edge is cut at
    the cell columns it spans; rows are widened by far less than a cell, so
    that rounding loses none."""
    env = (f"flatten(transform({_span(f'{geom}.xmin / {size}', f'{geom}.xmax / {size}')}, cx -> "
           f"transform({_span(f'{geom}.ymin / {size}', f'{geom}.ymax / {size}')}, cy -> "
           f"named_struct('cx', cx, 'cy', cy))))")
    pad = f"({size} * 1e-6D)"
    at = lambda x: f"(e.ay + (({x}) - e.ax) * (e.by - e.ay) / (e.bx - e.ax))"
    lo_x, hi_x = "least(e.ax, e.bx)", "greatest(e.ax, e.bx)"
    left, right = f"least(greatest(cx * {size}, {lo_x}), {hi_x})", f"greatest(least((cx + 1) * {size}, {hi_x}), {lo_x})"
    # a steep edge's row is less exact than its column
    slack = f"({pad} + CASE WHEN e.ax = e.bx THEN 0D ELSE abs((e.by - e.ay) / (e.bx - e.ax)) * 1e-13D * (1 + abs(e.ax)) END)"
    low = f"CASE WHEN e.ax = e.bx THEN least(e.ay, e.by) ELSE greatest(least({at(left)}, {at(right)}) - {slack}, least(e.ay, e.by) - {pad}) END"
    high = f"CASE WHEN e.ax = e.bx THEN greatest(e.ay, e.by) ELSE least(greatest({at(left)}, {at(right)}) + {slack}, greatest(e.ay, e.by) + {pad}) END"
    rows = _span(f"({low}) / {size}", f"({high}) / {size}")
    path = (f"array_distinct(flatten(transform({edges}, e -> flatten(transform("
            f"{_span(f'({lo_x} - {pad}) / {size}', f'({hi_x} + {pad}) / {size}')}, cx -> "
            f"transform({rows}, cy -> named_struct('cx', cx, 'cy', cy)))))))")
    return f"CASE WHEN {geom}.kind = 'line' AND size({edges}) > 0 THEN {path} ELSE {env} END"


class Extent:
    """What a query side tells about itself: the own levels that occur and the
    envelope of all its geometries. ``top`` is the level at which that envelope
    has at most 2 by 2 cells; no coarser level is of use."""

    def __init__(self, df: DataFrame, geom: str):
        g = F.col(geom)
        r = (df.where(g["xmin"].isNotNull())
             .agg(F.collect_set(level_of(geom)).alias("levels"), F.min(g["xmin"]).alias("x0"),
                  F.min(g["ymin"]).alias("y0"), F.max(g["xmax"]).alias("x1"), F.max(g["ymax"]).alias("y1")).first())
        self.box = None if r["x0"] is None else (r["x0"], r["y0"], r["x1"], r["y1"])
        size = 0.0 if self.box is None else max(r["x1"] - r["x0"], r["y1"] - r["y0"])
        self.top = min(MAX_LEVEL, max(MIN_LEVEL, math.ceil(math.log2(size)) if size > 0 else MIN_LEVEL))
        self.levels = sorted({min(x, self.top) for x in r["levels"]})

    def finest(self, n: int, wide: float, row: float) -> int:
        """The level below which it doesn't pay to cut edges, for ``n`` polygons
        of ``wide`` units: with the fewest rows of cells (``row`` times as dear
        as a candidate) and candidates for an edge. It bears on the work only."""
        if self.box is None or not n:
            return MIN_LEVEL
        area = max((self.box[2] - self.box[0]) * (self.box[3] - self.box[1]), 1e-30)
        work = lambda g: (row + n * (wide + g) ** 2 / area) / g
        return min(range(MIN_LEVEL, self.top + 1), key=lambda x: work(2.0 ** x))

    def meets(self, geom: str) -> Column:
        """The geometry's envelope meets the query side's."""
        if self.box is None:
            return F.lit(False)
        g, (x0, y0, x1, y1) = F.col(geom), self.box
        return (g["xmin"] <= x1) & (g["xmax"] >= x0) & (g["ymin"] <= y1) & (g["ymax"] >= y0)


def edge_cells(edges: DataFrame, levels: list[int], extent: Extent) -> DataFrame:
    """The cells (level, cx, cy) at every one of ``levels`` that an edge (ax, ay,
    bx, by) passes through inside the extent, each once: for every cell column it
    spans, the rows between its clipped ends (row0 to row1), widened by far less
    than a cell against rounding. row0_before and row1_before: the rows in the
    column before, null in the first one."""
    if extent.box is None:
        return (edges.where(F.lit(False)).withColumn("level", F.lit(0))
                .withColumns({c: F.lit(0).cast("long") for c in ("cx", "cy", "row0", "row1", "row0_before", "row1_before")}))
    x0, y0, x1, y1 = (F.lit(float(v)) for v in extent.box)
    size, ax, ay = F.col("size"), F.col("ax"), F.col("ay")
    lo_x, hi_x, lo_y, hi_y = F.least("ax", "bx"), F.greatest("ax", "bx"), F.least("ay", "by"), F.greatest("ay", "by")
    d = edges.where((lo_x <= x1) & (hi_x >= x0) & (lo_y <= y1) & (hi_y >= y0))
    d = d.withColumn("slope", F.when(F.col("bx") != ax, (F.col("by") - ay) / (F.col("bx") - ax)))
    d = d.withColumn("level", F.explode(F.array(*[F.lit(x) for x in sorted(set(levels))])))
    d = d.withColumn("size", F.pow(F.lit(2.0), F.col("level")))
    pad = size * F.lit(1e-6)
    d = d.withColumn("slack", pad + F.coalesce(F.abs("slope"), F.lit(0.0)) * F.lit(1e-13) * (1 + F.abs(ax)))
    d = d.withColumn("col0", F.floor((lo_x - pad) / size)).withColumn("col1", F.floor((hi_x + pad) / size))
    d = (d.withColumn("lo", F.greatest("col0", F.floor(x0 / size))).withColumn("hi", F.least("col1", F.floor(x1 / size)))
         .withColumn("cx", F.explode(F.expr("sequence(lo, IF(lo <= hi, hi, NULL))"))))

    def height(column: Column, otherwise: str) -> Column:
        x = F.least(F.greatest(column * size, lo_x), hi_x)
        return F.coalesce(ay + (x - ax) * F.col("slope"), F.col(otherwise))

    def rows(left: str, right: str) -> tuple[Column, Column]:
        return (F.floor(F.greatest(F.least(left, right) - F.col("slack"), lo_y - pad) / size),
                F.floor(F.least(F.greatest(left, right) + F.col("slack"), hi_y + pad) / size))

    # of a vertical edge the whole; a steep one's row is less exact than its column
    d = (d.withColumn("h0", height(F.col("cx") - 1, "ay")).withColumn("h1", height(F.col("cx"), "ay"))
         .withColumn("h2", height(F.col("cx") + 1, "ay")))
    d = d.withColumn("h0", F.when(F.col("slope").isNull(), F.col("by")).otherwise(F.col("h0"))) \
         .withColumn("h2", F.when(F.col("slope").isNull(), F.col("by")).otherwise(F.col("h2")))
    before0, before1 = rows("h0", "h1")
    now0, now1 = rows("h1", "h2")
    has_before = F.col("cx") > F.col("col0")
    d = (d.withColumn("row0", now0).withColumn("row1", now1)
         .withColumn("row0_before", F.when(has_before, before0)).withColumn("row1_before", F.when(has_before, before1))
         .withColumn("lo", F.greatest("row0", F.floor(y0 / size))).withColumn("hi", F.least("row1", F.floor(y1 / size))))
    return (d.withColumn("cy", F.explode(F.expr("sequence(lo, IF(lo <= hi, hi, NULL))")))
            .drop("slope", "size", "slack", "col0", "col1", "lo", "hi", "h0", "h1", "h2"))


def with_level_cells(df: DataFrame, geom: str, edges: str, extent: Extent) -> DataFrame:
    """Add ``own`` (level) and ``cells`` (at that level) to the geometries that
    meet the extent and whose edge array stands in ``edges``. What is coarser
    than the extent's top level has there the cells of the part of its envelope
    that lies in the extent."""
    if extent.box is None:
        none = F.array().cast("array<struct<cx: bigint, cy: bigint>>")
        return df.where(F.lit(False)).withColumn("own", F.lit(0)).withColumn("cells", none)
    x0, y0, x1, y1 = (f"CAST({v!r} AS DOUBLE)" for v in extent.box)
    cut = "named_struct('cx', cx, 'cy', cy)"
    size = f"{2.0 ** extent.top!r}D"
    within = (f"flatten(transform({_span(f'greatest({geom}.xmin, {x0}) / {size}', f'least({geom}.xmax, {x1}) / {size}')}, cx -> "
              f"transform({_span(f'greatest({geom}.ymin, {y0}) / {size}', f'least({geom}.ymax, {y1}) / {size}')}, cy -> {cut})))")
    return (df.where(extent.meets(geom)).withColumn("fit", level_of(geom))
            .withColumn("size", F.pow(F.lit(2.0), F.col("fit")))
            .withColumn("cells", F.expr(f"CASE WHEN fit > {extent.top} THEN {within} ELSE "
                                        f"{cells_sql(geom, edges, 'size')} END"))
            .withColumn("own", F.least("fit", F.lit(extent.top))).drop("size", "fit"))


def levels_present(df: DataFrame, geom: str, extent: Extent) -> list[int]:
    """The distinct own levels of what meets the extent (at most MAX_LEVEL -
    MIN_LEVEL + 1 values); reads envelopes only."""
    rows = df.where(extent.meets(geom)).select(level_of(geom).alias("own")).distinct().collect()
    return sorted({min(r["own"], extent.top) for r in rows})


def _place(side: int, level) -> Column:
    return F.struct(F.lit(side).alias("side"), level.cast("int").alias("level"))


_NO_PLACES = "array<struct<side: int, level: int>>"


def query_keys(df: DataFrame, geom: str, feature_levels: list[int], extent: Extent) -> DataFrame:
    """The query side (polygons) by key: own cells in side 1, ancestors at the
    features' coarser levels in side 2. A polygon's cells at any level are a
    rectangle of them: columns qx0, qx1, qy0, qy1."""
    own = F.least(level_of(geom), F.lit(extent.top))
    above = F.filter(F.array(*[F.lit(x) for x in feature_levels]) if feature_levels else F.array().cast("array<int>"),
                     lambda x: x > own)
    placed = (df.where(F.col(f"{geom}.xmin").isNotNull())
              .withColumn("place", F.explode(F.concat(F.array(_place(1, own)), F.transform(above, lambda x: _place(2, x)))))
              .withColumn("side", F.col("place.side")).withColumn("level", F.col("place.level")))
    at = lambda c: F.floor(F.col(f"{geom}.{c}") / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    return (placed.withColumn("qx0", at("xmin")).withColumn("qx1", at("xmax"))
            .withColumn("qy0", at("ymin")).withColumn("qy1", at("ymax")).drop("place")
            .withColumn("cx", F.explode(F.sequence("qx0", "qx1"))).withColumn("cy", F.explode(F.sequence("qy0", "qy1"))))


def feature_keys(df: DataFrame, query_levels: list[int]) -> DataFrame:
    """The feature side (with ``own`` and ``cells``) by key: its cells at the
    query side's levels from its own on in side 1; its own cells in side 2, if
    a query has a finer level. ``at`` is the cell's place in ``cells``."""
    if query_levels:
        up = F.filter(F.array(*[F.lit(x) for x in query_levels]), lambda x: x >= F.col("own"))
        below = F.when(F.col("own") > query_levels[0], F.array(_place(2, F.col("own")))).otherwise(
            F.array().cast(_NO_PLACES))
        places = F.concat(F.transform(up, lambda x: _place(1, x)), below)
    else:
        places = F.array().cast(_NO_PLACES)
    by = "CAST(level - own AS INT)"
    lifted = F.expr(f"CASE WHEN level = own THEN cells ELSE array_distinct(transform(cells, c -> "
                    f"named_struct('cx', shiftright(c.cx, {by}), 'cy', shiftright(c.cy, {by})))) END")
    placed = (df.withColumn("place", F.explode(places))
              .withColumn("side", F.col("place.side")).withColumn("level", F.col("place.level"))
              .withColumn("cells", lifted).drop("place", "own"))
    return (placed.select("*", F.posexplode("cells").alias("at", "cell"))
            .withColumn("cx", F.col("cell.cx")).withColumn("cy", F.col("cell.cy")).drop("cell"))


def first_shared_cell() -> Column:
    """True in the first of the feature's cells that the polygon has as well."""
    return F.expr("at = 0 OR NOT exists(slice(cells, 1, at), c -> "
                  "c.cx BETWEEN qx0 AND qx1 AND c.cy BETWEEN qy0 AND qy1)")


def edges_of(geom: str) -> Column:
    return F.expr(G.edges_array_sql(geom))
