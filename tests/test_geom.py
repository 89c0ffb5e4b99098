"""Hand-computed geometry: point in polygon (holes, edges, vertices, concave
rings), intersects, distances, measures, projection, text forms."""

import math

import pytest
from pyspark.sql import functions as F

from terrane.functions import geom as G

SQUARE_WITH_HOLE = dict(coords=[(0, 0), (2, 0), (2, 2), (0, 2)], holes=[[(0.5, 0.5), (1, 0.5), (1, 1), (0.5, 1)]])
# concave ring with a notch cut in from the top between x=1 and x=2
CONCAVE = [(0, 0), (3, 0), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3)]


def _pts(spark, pts):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id int, x double, y double")


def test_point_in_polygon_with_hole(spark):
    df = _pts(spark, [(1.5, 1.5), (0.75, 0.75), (2.0, 1.0), (3.0, 1.0), (0.5, 0.7), (0.0, 0.0), (1.0, 0.75)])
    df = df.withColumn("poly", G.literal_polygon(**SQUARE_WITH_HOLE))
    got = [r.inside for r in df.orderBy("id").select(G.covers_point("poly", "x", "y").alias("inside")).collect()]
    # inside, in hole, on outer edge, outside, on hole edge, outer vertex, on hole edge
    assert got == [True, False, True, False, True, True, True]


def test_point_in_concave_ring(spark):
    pts = [(0.5, 2.5), (1.5, 2.5), (1.5, 0.5), (2.0, 2.0), (1.0, 1.0), (3.5, 1.0), (2.5, 2.9)]
    df = _pts(spark, pts).withColumn("poly", G.literal_polygon(CONCAVE))
    got = [r.inside for r in df.orderBy("id").select(G.covers_point("poly", "x", "y").alias("inside")).collect()]
    # left arm, notch (outside), base, notch edge, notch vertex, outside, right arm
    assert got == [True, False, True, True, True, False, True]


def test_intersects_line_and_polygon(spark):
    df = spark.range(1).select(
        G.literal_polygon(**SQUARE_WITH_HOLE).alias("poly"),
        G.line(F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y"))
                         for a, b in [(-1.0, 3.0), (3.0, 3.0)]])).alias("miss"),
        G.line(F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y"))
                         for a, b in [(-1.0, 1.0), (3.0, 1.0)]])).alias("cross"),
        G.line(F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y"))
                         for a, b in [(0.6, 0.6), (0.9, 0.9)]])).alias("in_hole"),
        G.line(F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y"))
                         for a, b in [(-1.0, 2.0), (3.0, 2.0)]])).alias("touch"),
        G.literal_polygon([(1.5, 1.5), (5, 1.5), (5, 5), (1.5, 5)]).alias("overlap"),
        G.literal_polygon([(0.6, 0.6), (0.9, 0.6), (0.9, 0.9)]).alias("inside_hole"))
    r = df.select(*[F.expr(G.intersects_polygon_sql(c, "poly")).alias(c)
                    for c in ("miss", "cross", "in_hole", "touch", "overlap", "inside_hole")]).first()
    assert (r.miss, r.cross, r.in_hole, r.touch, r.overlap, r.inside_hole) == (False, True, False, True, True, False)


def test_area_length_centroid(spark):
    df = spark.range(1).select(G.literal_polygon(**SQUARE_WITH_HOLE).alias("g"),
                               G.literal_polygon(CONCAVE).alias("c"))
    cx, cy = G.centroid_sql("g")
    r = df.select(G.area("g").alias("a"), G.length("g").alias("l"), F.expr(cx).alias("cx"),
                  F.expr(cy).alias("cy"), G.area("c").alias("ca")).first()
    assert r.a == pytest.approx(4 - 0.25)
    assert r.l == pytest.approx(8 + 2)
    # centroid of square minus hole: (4*1 - 0.25*0.75) / 3.75
    assert r.cx == pytest.approx((4 * 1 - 0.25 * 0.75) / 3.75)
    assert r.cy == pytest.approx((4 * 1 - 0.25 * 0.75) / 3.75)
    assert r.ca == pytest.approx(9 - 2)


def test_small_polygon_centroid_far_from_origin(spark):
    sq = [(-71.95, 42.95), (-71.949, 42.95), (-71.949, 42.951), (-71.95, 42.951)]
    cx, cy = G.centroid_sql("g")
    r = spark.range(1).select(G.literal_polygon(sq).alias("g")).select(F.expr(cx).alias("x"), F.expr(cy).alias("y")).first()
    assert r.x == pytest.approx(-71.9495, abs=1e-10) and r.y == pytest.approx(42.9505, abs=1e-10)


def test_utm_reference_points(spark):
    e, n = G.utm_sql("x", "y")
    rows = _pts(spark, [(-69.0, 0.0), (-71.538, 43.207)]).orderBy("id").select(
        F.expr(e).alias("e"), F.expr(n).alias("n")).collect()
    assert rows[0].e == pytest.approx(500000.0, abs=1e-6) and rows[0].n == pytest.approx(0.0, abs=1e-6)
    assert rows[1].e == pytest.approx(293823.274, abs=1e-3) and rows[1].n == pytest.approx(4786929.629, abs=1e-3)


def test_distances(spark):
    df = _pts(spark, [(1.5, 1.5), (3.0, 1.0), (0.75, 0.75)]).withColumn("poly", G.literal_polygon(**SQUARE_WITH_HOLE))
    got = [r.d for r in df.orderBy("id").select(F.expr(G.distance_deg_sql("poly", "x", "y")).alias("d")).collect()]
    assert got == pytest.approx([0.0, 1.0, 0.25])
    hv = spark.range(1).select(F.expr(G.haversine_sql("0.0", "0.0", "1.0", "0.0")).alias("m")).first().m
    assert hv == pytest.approx(G.EARTH_RADIUS_M * math.pi / 180, rel=1e-12)


def test_wkt_round_trip(spark):
    texts = ["POINT (1.5 2.5)", "LINESTRING (0.0 0.0, 1.0 1.0, 2.0 0.5)",
             "POLYGON ((0.0 0.0, 2.0 0.0, 2.0 2.0, 0.0 0.0))"]
    df = spark.createDataFrame([(t,) for t in texts] + [("not wkt",), ("Point(-71.5 43.2)",)], "t string")
    out = [r.w for r in df.select(G.geom_from_wkt(F.col("t")).alias("g")).select(G.to_wkt("g").alias("w")).collect()]
    assert out[:3] == texts
    assert out[3] is None
    assert out[4] == "POINT (-71.5 43.2)"


def test_ring_with_one_vertex_is_safe(spark):
    """Degenerate paths do not index out of range under ANSI mode."""
    g = G.line(F.array(F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))))
    r = spark.range(1).select(g.alias("g"), G.literal_polygon(**SQUARE_WITH_HOLE).alias("p")).select(
        G.length("g").alias("l"), F.expr(G.intersects_polygon_sql("g", "p")).alias("i")).first()
    assert r.l == 0.0 and r.i is True


def test_wkt_multi_forms(spark):
    texts = ["MULTIPOINT (1.0 2.0, 3.0 4.0)", "MULTILINESTRING ((0.0 0.0, 1.0 1.0), (2.0 2.0, 3.0 3.0, 4.0 2.0))",
             "MULTIPOLYGON (((0.0 0.0, 4.0 0.0, 4.0 4.0, 0.0 0.0), (1.0 0.5, 2.0 0.5, 2.0 1.0, 1.0 0.5)), "
             "((5.0 5.0, 6.0 5.0, 6.0 6.0, 5.0 5.0)))"]
    df = spark.createDataFrame([(t,) for t in [*texts, "MULTIPOINT ((1 2), (3 4))", "GEOMETRYCOLLECTION (POINT (1 2))"]],
                               "t string")
    out = [r.w for r in df.select(G.geom_from_wkt(F.col("t")).alias("g")).select(G.to_wkt("g").alias("w")).collect()]
    assert out == [*texts, texts[0], None]
