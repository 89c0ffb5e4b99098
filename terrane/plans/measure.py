"""P8 draw-to-measure report, batch form: for every query (a set of drawn
shapes) the summed area (A6, overlaps counted twice), the perimeter of the
union (A7, overlaps and shared edges dissolved), both in UTM 19N metres
(G3-G5) with acres / feet (X11), and per-layer counts of features that
intersect the union (J3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import geom as G
from terrane.operators import spatial as S
from terrane.session import materialize, scratch


def measure_shapes(shapes: DataFrame, query: str = "query_id", shape: str = "shape_id",
                   geom: str = "geom", lon0: float = G.UTM19_LON0) -> DataFrame:
    """One row per query: area_m2, area_acres, perim_m, perim_ft."""
    with scratch(shapes.sparkSession):
        # projected once, for the area and the perimeter, in parallel even where shapes come from few splits
        utm = materialize(S.spread(shapes, query, shape).select(query, shape, G.to_utm(geom, lon0).alias("geom")), "utm-shapes")
        area = utm.groupBy(query).agg(F.sum(G.area("geom")).alias("area_m2"))
        perim = S.union_boundary_length(utm, query, shape, "geom", stored=True)
        out = materialize(area.join(perim.hint("merge"), query), "measures", keep=True)
    return out.select(
        query, "area_m2", (F.col("area_m2") / F.lit(G.M2_PER_ACRE)).alias("area_acres"),
        F.col("perimeter").alias("perim_m"),
        (F.col("perimeter") * F.lit(G.FT_PER_M)).alias("perim_ft"))


def count_in_shapes(shapes: DataFrame, layers: dict[str, DataFrame],
                    query: str = "query_id", shape: str = "shape_id") -> DataFrame:
    """Per (query, layer): features intersecting any of the query's shapes."""
    return S.count_intersecting(shapes, layers, query, shape)
