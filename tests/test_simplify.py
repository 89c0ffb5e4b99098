"""Douglas-Peucker simplification (the one Arrow-batch operator)."""

import numpy as np
from pyspark.sql import functions as F

from terrane.functions import geom as G
from terrane.operators import simplify as SM


def test_dp_keep_mask():
    xs = np.array([0.0, 1.0, 2.0, 3.0, 4.0])
    ys = np.array([0.0, 0.001, 0.0, 2.0, 0.0])
    assert SM.dp_keep(xs, ys, 0.01).tolist() == [True, False, True, True, True]


def test_simplify_never_adds_vertices_and_keeps_rings(spark):
    ring = [(0, 0), (1, 0.00001), (2, 0), (2, 2), (1, 2.00001), (0, 2)]
    df = spark.range(1).select(F.lit(1).alias("feature_id"), G.literal_polygon(ring).alias("geom"))
    line = spark.range(1).select(F.lit(2).alias("feature_id"), G.line(F.array(*[
        F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (1, 0.00001), (2, 0)]])).alias("geom"))
    both = df.unionByName(line)
    out = {r.feature_id: r.n for r in SM.simplify(both, 0.001).select("feature_id", SM.vertex_count().alias("n")).collect()}
    assert out == {1: 5, 2: 2}
