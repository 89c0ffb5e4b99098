"""Spatial joins against brute force on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrane.config import BBox
from terrane.functions import geom as G
from terrane.operators import levels as L
from terrane.operators import spatial as S


def _pip(poly, x, y):
    inside = False
    n = len(poly)
    for i in range(n):
        (ax, ay), (bx, by) = poly[i], poly[(i + 1) % n]
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def _polys():
    return {1: [(0, 0), (4, 0), (4, 4), (0, 4)], 2: [(3, 3), (7, 3), (5, 6)],
            3: [(10, 10), (12, 10), (12, 11), (11, 11), (11, 12), (10, 12)]}


def _shapes_df(spark, polys, query_of=lambda k: 1):
    out = None
    for k, cs in polys.items():
        d = spark.range(1).select(F.lit(query_of(k)).alias("query_id"), F.lit(k).alias("shape_id"),
                                  G.literal_polygon(cs).alias("geom"))
        out = d if out is None else out.unionByName(d)
    return out


def _points(n=400, seed=3):
    rnd = random.Random(seed)
    pts = [(i, round(rnd.uniform(-1, 13), 1), round(rnd.uniform(-1, 13), 1)) for i in range(n)]
    pts += [(n, 4.0, 2.0), (n + 1, 0.0, 0.0), (n + 2, 11.0, 11.0)]  # edge, vertex, reflex vertex
    return pts


@pytest.mark.parametrize("force_shuffle", [False, True])
def test_intersects_join_matches_brute_force(spark, force_shuffle, monkeypatch):
    polys = _polys()
    pts = _points()
    if force_shuffle:
        monkeypatch.setattr(S, "BROADCAST_MAX_ROWS", 0)
    shapes = _shapes_df(spark, polys)
    feats = spark.createDataFrame(pts, "feature_id long, x double, y double").withColumn("geom", G.point("x", "y"))
    got = {(r.shape_id, r.feature_id) for r in
           S.intersects_join(shapes, feats, ["shape_id"], ["feature_id"]).collect()}
    want = {(k, i) for k, cs in polys.items() for i, x, y in pts if _pip(cs, x, y)}
    assert got == want


def test_count_intersecting_keeps_zero_layers(spark):
    polys = {1: [(0, 0), (1, 0), (1, 1), (0, 1)], 2: [(0.5, 0), (2, 0), (2, 1), (0.5, 1)]}
    shapes = _shapes_df(spark, polys)
    a = spark.createDataFrame([(1, 0.75, 0.5), (2, 5.0, 5.0)], "feature_id long, x double, y double") \
        .withColumn("geom", G.point("x", "y"))
    empty = a.where("feature_id < 0")
    out = {(r.layer, r.n) for r in S.count_intersecting(shapes, {"a": a, "b": empty}).collect()}
    # the point in the overlap counts once for the drawing
    assert out == {("a", 1), ("b", 0)}


def test_bbox_filter_lines_exact(spark):
    box = BBox(0, 0, 1, 1)
    lines = spark.createDataFrame([(1,), (2,), (3,)], "feature_id long")
    paths = {1: [(-1.0, 0.5), (2.0, 0.5)], 2: [(-1.0, 2.0), (2.0, 3.0)], 3: [(-1.0, 1.5), (1.5, -1.0)]}
    lines = lines.withColumn("geom", F.when(F.col("feature_id") == 1, G.line(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in paths[1]])))
                             .when(F.col("feature_id") == 2, G.line(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in paths[2]])))
                             .otherwise(G.line(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in paths[3]]))))
    got = sorted(r.feature_id for r in S.bbox_filter(lines, box).collect())
    # 1 crosses, 2 misses (envelope overlaps nothing), 3 cuts the corner region
    assert got == [1, 3]


def test_radius_filter_matches_haversine(spark):
    rnd = random.Random(5)
    pts = [(i, -71.538 + rnd.uniform(-0.5, 0.5), 43.207 + rnd.uniform(-0.4, 0.4)) for i in range(500)]
    df = spark.createDataFrame(pts, "id long, lon double, lat double")
    got = {r.id for r in S.radius_filter(df, (-71.538, 43.207), 25000).collect()}

    def hav(lon1, lat1, lon2, lat2):
        p1, p2 = math.radians(lat1), math.radians(lat2)
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
        return 2 * G.EARTH_RADIUS_M * math.asin(math.sqrt(h))
    want = {i for i, x, y in pts if hav(-71.538, 43.207, x, y) <= 25000}
    assert got == want and 0 < len(got) < 500


def test_nearest_within_matches_brute_force(spark):
    rnd = random.Random(11)
    pts = [(i, -71.6 + rnd.uniform(0, 0.02), 43.2 + rnd.uniform(0, 0.02)) for i in range(300)]
    clicks = [(i, -71.6 + rnd.uniform(0, 0.02), 43.2 + rnd.uniform(0, 0.02)) for i in range(80)]
    line_paths = {1000: [(-71.61, 43.205), (-71.57, 43.215)], 1001: [(-71.59, 43.19), (-71.59, 43.23)]}
    pf = spark.createDataFrame(pts, "feature_id long, x double, y double").withColumn("geom", G.point("x", "y"))
    lf = None
    for k, path in line_paths.items():
        d = spark.range(1).select(F.lit(k).cast("long").alias("feature_id"),
                                  G.line(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in path])).alias("geom"))
        lf = d if lf is None else lf.unionByName(d)
    cf = spark.createDataFrame(clicks, "click_id long, x double, y double")
    got = {r.click_id: (r.layer, r.feature_id) for r in
           S.nearest_within(cf, [("lines", lf), ("points", pf.select("feature_id", "geom"))], 200.0,
                            poly_layers=set()).collect()}

    def hav(x1, y1, x2, y2):
        p1, p2 = math.radians(y1), math.radians(y2)
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(x2 - x1) / 2) ** 2
        return 2 * G.EARTH_RADIUS_M * math.asin(math.sqrt(h))

    def seg(px, py, a, b, kx=1.0, ky=1.0):
        dx, dy = (b[0] - a[0]) * kx, (b[1] - a[1]) * ky
        wx, wy = (px - a[0]) * kx, (py - a[1]) * ky
        l2 = dx * dx + dy * dy
        t = 0.0 if l2 == 0 else max(0.0, min(1.0, (wx * dx + wy * dy) / l2))
        return math.hypot(wx - t * dx, wy - t * dy)

    want = {}
    for cid, x, y in clicks:
        ky = G.EARTH_RADIUS_M * math.pi / 180
        kx = ky * math.cos(math.radians(y))
        lines = sorted((min(seg(x, y, p[i], p[i + 1]) for i in range(len(p) - 1)), k) for k, p in line_paths.items())
        d, k = lines[0]
        p = line_paths[k]
        if min(seg(x, y, p[i], p[i + 1], kx, ky) for i in range(len(p) - 1)) < 200:
            want[cid] = ("lines", k)
            continue
        d, i = min((math.hypot(px - x, py - y), pid) for pid, px, py in pts)
        px, py = pts[i][1], pts[i][2]
        if hav(x, y, px, py) < 200:
            want[cid] = ("points", i)
    assert got == want and len(want) > 10


def _planar_nearest(px, py, segs):
    """(d, id) of the nearest of the segments (id, a, b)."""
    def dist(a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        l2 = dx * dx + dy * dy
        t = 0.0 if l2 == 0 else max(0.0, min(1.0, ((px - a[0]) * dx + (py - a[1]) * dy) / l2))
        return math.hypot(px - a[0] - t * dx, py - a[1] - t * dy)
    return min((dist(a, b), k) for k, a, b in segs)


def test_nearest_rings_in_a_dense_layer(spark, monkeypatch):
    """Thousands of crossing lines: the first rings are far smaller than the
    search radius, some clicks lie off the crowd and go on to the last ring,
    axis-parallel lines lie on cell borders, equal lines tie, and long lines
    pass by far from every click."""
    monkeypatch.setattr(S, "CROWD", 8)
    rnd = random.Random(5)
    paths = []
    for i in range(3000):
        x, y = -71.6 + rnd.uniform(0, 0.03), 43.2 + rnd.uniform(0, 0.03)
        paths.append((i, (x, y), (x + rnd.uniform(-0.02, 0.02), y + rnd.uniform(-0.02, 0.02))))
    paths += [(5000 + i, (-71.5 + i * 0.0001, 43.2), (-71.5 + i * 0.0001, 43.23)) for i in range(20)]
    paths += [(6000 + i, paths[i][1], paths[i][2]) for i in range(50)]
    paths += [(7000, (-75.0, 40.0), (-65.0, 41.0)), (7001, (-71.45, 42.0), (-71.45, 45.0))]
    clicks = [(i, -71.6 + rnd.uniform(0, 0.03), 43.2 + rnd.uniform(0, 0.03)) for i in range(150)]
    clicks += [(1000 + i, -71.4515 + i * 0.0001, 43.0 + i * 0.01) for i in range(20)]
    clicks += [(2000 + i, -71.5 + rnd.uniform(0, 0.002), 43.2 + rnd.uniform(0, 0.03)) for i in range(20)]
    lf = (spark.createDataFrame([(k, *a, *b) for k, a, b in paths], "feature_id long, ax double, ay double, bx double, by double")
          .select("feature_id", G.line(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")),
                                               F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("geom")))
    cf = spark.createDataFrame([*clicks, (9000, None, 43.2)], "click_id long, x double, y double")
    occupied = S._Occupied(cf.select("click_id", F.col("x").alias("px"), F.col("y").alias("py")).dropna(),
                           S.search_radius_deg(43.3, 200.0))
    pieces = occupied.pieces(S.segment_rows(lf))
    assert pieces.where("feature_id = 7000").count() == 0
    assert pieces.where("feature_id = 7001").count() < 20
    rings = S._Density(pieces, occupied).rings()
    assert len(rings) > 1 and rings[-1] == occupied.unit
    got = {r.click_id: (r.feature_id, r.dist_deg) for r in S.nearest_within(cf, [("lines", lf)], 200.0,
                                                                             poly_layers=set()).collect()}
    for cid, x, y in clicks:
        d, k = _planar_nearest(x, y, paths)
        metres = d * 111_195
        if cid in got:
            assert got[cid][0] == k and got[cid][1] == pytest.approx(d, abs=1e-12), cid
        else:
            assert metres > 140, cid         # beyond 200 m, a degree of longitude is 0.73 of one of latitude
    assert len(got) > 170 and 9000 not in got


def test_nearest_without_clicks_or_features(spark):
    cf = spark.createDataFrame([(1, -71.6, 43.2)], "click_id long, x double, y double")
    pf = cf.select(F.col("click_id").alias("feature_id"), G.point("x", "y").alias("geom"))
    assert S.nearest_within(cf.limit(0), [("points", pf), ("more", pf)]).count() == 0
    assert S.nearest_within(cf, [("points", pf.limit(0)), ("more", pf)]).first().layer == "more"


def test_union_boundary_length_overlap_and_shared_edges(spark):
    # A [0,2]x[0,2] and C [1,3]x[1,3] overlap: union perimeter = 2 * (3 + 3) = 12;
    # D [3,4]x[0,1] is disjoint: 4; E shares D's right edge: E [4,5]x[0,1] -> D+E = 6
    polys = {"A": [(0, 0), (2, 0), (2, 2), (0, 2)], "C": [(1, 1), (3, 1), (3, 3), (1, 3)]}
    g2 = {"D": [(3, 0), (4, 0), (4, 1), (3, 1)], "E": [(4, 0), (5, 0), (5, 1), (4, 1)]}
    shapes = _shapes_df(spark, polys, lambda k: 1).unionByName(_shapes_df(spark, g2, lambda k: 2))
    shapes = shapes.withColumn("shape_id", F.col("shape_id").cast("string"))
    out = {r.query_id: r.perimeter for r in S.union_boundary_length(shapes).collect()}
    assert out[1] == pytest.approx(12.0, abs=1e-6)
    assert out[2] == pytest.approx(6.0, abs=1e-6)


def test_union_boundary_length_any_winding(spark):
    import math

    def turned(ring, a):
        return [(x * math.cos(a) - y * math.sin(a), x * math.sin(a) + y * math.cos(a)) for x, y in ring]

    sq = [(0, 0), (10, 0), (10, 10), (0, 10)]
    groups = {
        1: ([sq, sq[::-1]], 40.0),                                                       # identical, other winding
        2: ([sq, [(5, 0), (15, 0), (15, 10), (5, 10)][::-1]], 50.0),                     # one baseline
        3: ([turned(sq, 0.3), turned([(3, 10), (7, 10), (7, 14), (3, 14)], 0.3)], 48.0),  # T-junction, slanted
        4: ([turned(sq, 0.7), turned([(4, 10), (13, 10), (13, 15), (4, 15)], 0.7)[::-1]], 56.0),  # sliding
        5: ([sq, [(2, 2), (4, 2), (4, 4), (2, 4)]], 40.0),                               # nested
    }
    shapes = None
    for q, (rings, _) in groups.items():
        for i, r in enumerate(rings):
            one = spark.range(1).select(F.lit(q).alias("query_id"), F.lit(i).alias("shape_id"),
                                        G.literal_polygon(r).alias("geom"))
            shapes = one if shapes is None else shapes.unionByName(one)
    got = {r.query_id: r.perimeter for r in S.union_boundary_length(shapes).collect()}
    for q, (_, want) in groups.items():
        assert got[q] == pytest.approx(want, abs=1e-3), q


def _seg_int(p1, p2, q1, q2):
    def o(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    if max(p1[0], p2[0]) < min(q1[0], q2[0]) or max(q1[0], q2[0]) < min(p1[0], p2[0]):
        return False
    if max(p1[1], p2[1]) < min(q1[1], q2[1]) or max(q1[1], q2[1]) < min(p1[1], p2[1]):
        return False
    return o(p1, p2, q1) * o(p1, p2, q2) <= 0 and o(q1, q2, p1) * o(q1, q2, p2) <= 0


def test_lines_vs_rectangles_and_polygons_brute_force(spark):
    """Lines against a rectangle (fast path) and a triangle (general path)."""
    polys = {1: [(0, 0), (4, 0), (4, 4), (0, 4)], 2: [(3, 3), (7, 3), (5, 6)]}
    rnd = random.Random(7)
    paths = {i: [(round(rnd.uniform(-2, 8), 1), round(rnd.uniform(-2, 8), 1)) for _ in range(rnd.randint(1, 4))]
             for i in range(300)}
    lines = _geoms(spark, paths.items(), "line")
    shapes = _shapes_df(spark, polys)
    got = {(r.shape_id, r.feature_id) for r in
           S.intersects_join(shapes, lines, ["shape_id"], ["feature_id"]).collect()}
    want = set()
    for k, cs in polys.items():
        ring = cs + [cs[0]]
        for i, path in paths.items():
            hit = any(_pip(cs, x, y) for x, y in path)
            for a, b in zip(path[:-1], path[1:]):
                hit = hit or any(_seg_int(a, b, p, q) for p, q in zip(ring[:-1], ring[1:]))
            if hit:
                want.add((k, i))
    assert got == want and len(want) > 20


def _geoms(spark, rows, kind):
    """(id, [(x, y), ...]) to feature_id, geom."""
    df = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in v]) for i, v in rows],
                               "feature_id long, v array<struct<x: double, y: double>>")
    return df.select("feature_id", (G.line(F.col("v")) if kind == "line" else G.polygon(F.array("v"))).alias("geom"))


def test_cells_are_bounded_and_cover(spark):
    """Whatever its size, a geometry has few cells, and every point of it lies
    in one of them."""
    from terrane.operators import levels as L
    rnd = random.Random(11)
    lines = [(0, [(-71.9, 42.1), (-70.1, 43.9)]), (1, [(-71.5, 42.1), (-71.5, 43.9)]), (2, [(-1e-7, 0), (1e-7, 1)]),
             (3, [(-170, -80), (170, 80), (-170, 80), (170, -80)]), (4, [(5, 5), (5, 5)]), (5, [(0.25, 0), (0.25, 8)])]
    lines += [(i, [(rnd.gauss(0, 1) * 10 ** rnd.randint(-4, 1), rnd.gauss(0, 1) * 10 ** rnd.randint(-4, 1))
                   for _ in range(rnd.randint(2, 30))]) for i in range(10, 150)]
    df = _geoms(spark, lines, "line").withColumn("edges", L.edges_of("geom"))
    for r in L.with_level_cells(df, "geom", "edges", L.Extent(df, "geom")).collect():
        cells, size = {(c.cx, c.cy) for c in r["cells"]}, 2.0 ** r.own
        assert 1 <= len(cells) == len(r["cells"]) <= L.MOST_CELLS
        path = dict(lines)[r.feature_id]
        for (ax, ay), (bx, by) in zip(path, path[1:]):
            for t in [0, 1] + [rnd.random() for _ in range(60)]:
                x, y = (ax + t * (bx - ax), ay + t * (by - ay)) if t < 1 else (bx, by)
                assert (math.floor(x / size), math.floor(y / size)) in cells
    boxes = [(i, [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)])
             for i, (x, y, w, h) in enumerate((rnd.uniform(-5, 5), rnd.uniform(-5, 5), 10 ** rnd.uniform(-6, 2),
                                               10 ** rnd.uniform(-6, 2)) for _ in range(80))]
    df = _geoms(spark, boxes, "poly").withColumn("edges", L.edges_of("geom"))
    assert max(len(r["cells"]) for r in L.with_level_cells(df, "geom", "edges", L.Extent(df, "geom")).collect()) <= (L.POLY_CELLS + 1) ** 2


@pytest.mark.parametrize("force_shuffle", [False, True])
def test_sizes_of_all_orders_meet(spark, force_shuffle, monkeypatch):
    """Boxes and lines from metres to the whole region on both sides: each
    intersecting pair is found once."""
    if force_shuffle:
        monkeypatch.setattr(S, "BROADCAST_MAX_ROWS", 0)
    rnd = random.Random(5)
    size = lambda: 2.0 ** rnd.randint(-16, 3)
    boxes, lines = [], []
    for i in range(160):
        x, y, w, h = rnd.randint(-64, 64) / 16, rnd.randint(-64, 64) / 16, size(), size()
        boxes.append((i, [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]))
        path = [(x, y)] if i % 9 else [(x, y), (x + w, y)]
        lines.append((i, path + [(x + rnd.choice([-1, 1]) * size(), y + rnd.choice([-1, 1]) * size())
                                 for _ in range(rnd.randint(0, 3))]))
    got = [(r.shape_id, r.feature_id) for r in S.intersects_join(
        _geoms(spark, boxes, "poly").withColumnRenamed("feature_id", "shape_id"), _geoms(spark, lines, "line"),
        ["shape_id"], ["feature_id"]).collect()]
    want = set()
    for k, ring in boxes:
        for i, path in lines:
            hit = any(_pip(ring[:-1], x, y) for x, y in path)
            hit = hit or any(_seg_int(a, b, p, q) for a, b in zip(path, path[1:]) for p, q in zip(ring, ring[1:]))
            if hit:
                want.add((k, i))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def _rows_of_boxes(spark, n=6):
    """Per group a row of n boxes, each turned a little and over the next one;
    the union's perimeter is that of the boxes less what lies inside."""
    rows = [(q, i, i * 3.0, 4.0 + q) for q in range(3) for i in range(n)]
    return spark.createDataFrame(rows, "query_id int, shape_id int, x double, w double").select(
        "query_id", "shape_id", G.rect("x", F.lit(0.0), F.col("x") + F.col("w"), F.lit(2.0)).alias("geom"))


def test_union_boundary_by_groups_and_by_cells(spark, monkeypatch):
    """Edges that meet in their group and edges that meet in grid cells give the
    same lengths; no side of a join is sent to every executor by way of the driver."""
    plans = []
    real = S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, *a, **k: (plans.append(df), real(df, *a, **k))[1])
    want = {q: 2 * (5 * 3.0 + 4 + q) + 4 for q in range(3)}
    for few in (64, 0):
        plans.clear()
        monkeypatch.setattr(S, "FEW_EDGES", few)
        out = S.union_boundary_length(_rows_of_boxes(spark))
        assert {r.query_id: r.perimeter for r in out.collect()} == pytest.approx(want, abs=1e-6)
        text = "\n".join(d._jdf.queryExecution().executedPlan().toString() for d in [*plans, out])
        assert "SortMergeJoin" in text and "Broadcast" not in text
        assert ("cx" in text) == (few == 0)


def test_measures_project_every_shape_once(spark, monkeypatch):
    """The area and the perimeter read shapes that are projected and stored once."""
    from terrane.plans import measure as M
    plans = []
    real = S.materialize
    keep = lambda df, *a, **k: (plans.append(df), real(df, *a, **k))[1]
    monkeypatch.setattr(S, "materialize", keep)
    monkeypatch.setattr(M, "materialize", keep, raising=False)
    shapes = spark.createDataFrame([(1, i, -71.5 + i / 1000) for i in range(3)], "query_id int, shape_id int, x double")
    shapes = shapes.select("query_id", "shape_id", G.rect("x", F.lit(43.0), F.col("x") + 0.001, F.lit(43.001)).alias("geom"))
    out = M.measure_shapes(shapes)
    r = out.first()
    assert 2 * (r.area_m2 / r.perim_m) < r.perim_m and r.perim_ft == pytest.approx(r.perim_m * G.FT_PER_M)
    projected = [d for d in [*plans, out] if "sinh" in d._jdf.queryExecution().executedPlan().toString().lower()]
    assert len(projected) == 1


def test_nearest_searches_later_layers_for_clicks_that_are_left(spark, monkeypatch):
    """A layer is cut only around the clicks that no earlier layer has answered,
    and not at all if there are none."""
    cut, around = [], []
    real, occupied = S.segment_rows, S._Occupied
    monkeypatch.setattr(S, "segment_rows", lambda layer, *a: (cut.append(1), real(layer, *a))[1])
    monkeypatch.setattr(S, "_Occupied", lambda clicks, r: (around.append(clicks.count()), occupied(clicks, r))[1])
    first = _geoms(spark, [(1, [(-71.5, 43.2)]), (2, [(-71.4, 43.2)])], "point")
    second = _geoms(spark, [(3, [(-71.3, 43.2), (-71.3, 43.3)])], "line")
    clicks = spark.createDataFrame([(1, -71.5, 43.2005), (2, -71.4, 43.2005), (3, -71.3005, 43.25)],
                                   "click_id long, x double, y double")
    layers = [("first", first), ("second", second)]
    got = {r.click_id: (r.layer, r.feature_id) for r in S.nearest_within(clicks, layers, poly_layers=set()).collect()}
    assert got == {1: ("first", 1), 2: ("first", 2), 3: ("second", 3)} and around == [3, 1] and len(cut) == 2
    cut.clear(), around.clear()
    got = {r.click_id for r in S.nearest_within(clicks.where("click_id < 3"), layers, poly_layers=set()).collect()}
    assert got == {1, 2} and around == [2] and len(cut) == 1


@pytest.mark.parametrize("force_shuffle", [False, True])
def test_long_lines_meet_small_parcels_near_their_path_only(spark, force_shuffle, monkeypatch):
    """Region-wide lines against many small parcels: pairs as by brute force,
    each once, and the candidates of a line are those along its path, not those
    of the line's own large cells."""
    if force_shuffle:
        monkeypatch.setattr(S, "BROADCAST_MAX_ROWS", 0)
    rnd = random.Random(11)
    boxes, lines = [], []
    for i in range(400):
        x, y, w = rnd.uniform(0, 10), rnd.uniform(0, 10), rnd.uniform(0.02, 0.06)
        boxes.append((i, [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]))
    for i in range(40):
        lines.append((i, [(rnd.uniform(0, 10), rnd.uniform(0, 10)) for _ in range(rnd.randint(2, 5))]))
    lines.append((40, [(boxes[0][1][0][0], 0.0), (boxes[0][1][0][0], 10.0), (boxes[0][1][0][0], 0.0)]))
    polys = _geoms(spark, boxes, "poly").withColumnRenamed("feature_id", "shape_id")
    feats = _geoms(spark, lines, "line")
    got = [(r.shape_id, r.feature_id) for r in S.intersects_join(polys, feats, ["shape_id"], ["feature_id"]).collect()]
    want = {(k, i) for k, ring in boxes for i, path in lines
            if any(_pip(ring[:-1], x, y) for x, y in path)
            or any(_seg_int(a, b, p, q) for a, b in zip(path, path[1:]) for p, q in zip(ring, ring[1:]))}
    assert len(got) == len(set(got))
    assert set(got) == want
    assert len(want) > 50
    # cells of the edges: each once, and every point of an edge lies in one
    extent = L.Extent(polys, "geom")
    level = extent.finest(400, 0.04, 1.0)
    size = 2.0 ** level
    edges = feats.select("feature_id", F.explode(L.edges_of("geom")).alias("e")).select("feature_id", "e.*")
    rows = L.edge_cells(edges, [level], extent).collect()
    cells = {}
    for r in rows:
        cells.setdefault((r.feature_id, r.ax, r.ay, r.bx, r.by), []).append((r.cx, r.cy))
    x0, y0, x1, y1 = extent.box
    for (_, ax, ay, bx, by), c in cells.items():
        assert len(c) == len(set(c))
        for t in range(201):
            x, y = ax + (bx - ax) * t / 200, ay + (by - ay) * t / 200
            if x0 <= x <= x1 and y0 <= y <= y1:
                assert (math.floor(x / size), math.floor(y / size)) in set(c)
    assert size <= 0.5 and len(rows) * 400 * (0.04 + size) ** 2 / 100 < 0.1 * 400 * sum(len(p) - 1 for _, p in lines)


def test_a_layer_that_lies_by_feature_is_not_dealt_again(spark):
    """Lines gathered from vertices lie by feature already: counting them in
    shapes moves no line and no pair once more."""
    v = spark.range(60).select((F.col("id") % 20).alias("feature_id"), F.col("id").alias("at"),
                               ((F.col("id") * 7 % 60) / 10).alias("x"), ((F.col("id") * 11 % 60) / 10).alias("y"))
    vs = F.sort_array(F.collect_list(F.struct("at", "x", "y")))
    lines = v.repartition(4, "feature_id").groupBy("feature_id").agg(vs.alias("vs")).select(
        "feature_id", G.line(F.transform("vs", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))).alias("geom"))
    out = S.count_intersecting(_shapes_df(spark, _polys()), {"lines": lines})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(feature_id") == 1
    assert {r.layer: r.n for r in out.collect()} == {"lines": 20}


def _counts(df, key="shape_id"):
    out = {}
    for r in df.collect():
        out[r[key]] = out.get(r[key], 0) + r.n
    return out


def test_counts_of_pairs_equal_the_pairs(spark, monkeypatch):
    """Counted in rounds, of every kind of polygon and feature: rectangles of all
    sizes, twice, without a key, other polygons; points, lines that end in, touch
    and cross rectangles with several edges, lines with unknown and far
    places, polygons."""
    monkeypatch.setattr(S, "ROUND_BOXES", 60)
    monkeypatch.setattr(S.B, "CHUNK", 50)
    monkeypatch.setattr(S.B, "BAND_VISITS", 40)
    rnd = random.Random(3)
    on = lambda: rnd.randint(-40, 40) / 10
    boxes, lines = [], []
    for i in range(200):
        x, y, w, h = on(), on(), rnd.choice([0.1, 0.2, 0.5, 3.0, 2.0 ** -12]), rnd.choice([0.1, 0.3, 1.0])
        boxes.append((i % 190 or None, [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]))
    boxes += [(500, [(0, 0), (3, 1), (1, 3), (0, 0)]), (501, [(-1, -1), (1, -1), (0.5, 0), (1, 1), (-1, 1), (-1, -1)])]
    for i in range(120):
        x, y = on(), on()
        path = [(x, y)] + [(x + rnd.choice([-1, 0, 0.1, 2]), y + rnd.choice([-1, 0, 1e-9, 0.3])) for _ in range(i % 5)]
        lines.append((i, path + [(on(), on())] * (i % 2)))
    nan = float("nan")
    polys = _geoms(spark, boxes, "poly").withColumnRenamed("feature_id", "shape_id")
    feats = _geoms(spark, lines, "line").unionByName(_geoms(spark, [(900 + i, [(on(), on())]) for i in range(20)], "line"))
    rows = [(700, [(0.0, 0.0), (None, 1.0), (1.0, 1.0)]), (701, [(0.0, 0.0), (nan, 1.0)]),
            (703, [(-3.0, 1.0), (3.0, None)]), (704, []), (705, [(0.0, 0.0), (2e9, 1e9)])]
    odd = spark.createDataFrame(rows, "feature_id long, v array<struct<x: double, y: double>>").select(
        "feature_id", G.line(F.col("v")).alias("geom"))
    points = spark.createDataFrame([(800 + i, on(), on()) for i in range(40)], "feature_id long, x double, y double").select(
        "feature_id", G.point("x", "y").alias("geom"))
    areas = _geoms(spark, boxes[:20], "poly").withColumn("feature_id", F.lit(1000).cast("long"))
    feats = feats.unionByName(odd).unionByName(points).unionByName(areas)
    pairs = S.intersects_join(polys, feats, ["shape_id"], ["feature_id"]).withColumn("n", F.lit(1))
    got = S.intersects_join(polys, feats, ["shape_id"], ["feature_id"], count="n")
    assert got.columns == ["shape_id", "n"]
    want = _counts(pairs)
    assert _counts(got) == want and sum(want.values()) > 1000 and None in want
    none = S.intersects_join(polys.limit(0), feats, ["shape_id"], ["feature_id"], count="n")
    assert none.count() == 0
    assert S.intersects_join(polys, feats.limit(0), ["shape_id"], ["feature_id"], count="n").count() == 0


def test_parcel_line_counts_makes_no_row_for_a_pair(spark, tmp, monkeypatch):
    """The query counts lines across parcels where the lines lie, without rows of
    (parcel, line) or (edge, cell)."""
    from terrane.suite.spatial import parcel_line_counts
    rnd = random.Random(2)
    spark.createDataFrame([(i, f"c{i}", "x", 1.0) for i in range(1, 300)],
                          "c_custkey long, c_name string, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp}/customer.parquet")
    items = [(k, n, rnd.randint(1, 20000), rnd.randint(1, 1000)) for k in range(80) for n in range(1, 2 + k % 5)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp}/lineitem.parquet")
    from terrane.sources import fixtures as X
    squares = [(r.id, r.x0, r.y0, r.x1, r.y1) for r in X.fx_squares(spark, tmp).collect()]
    paths = {}
    for r in sorted(X.fx_vertices(spark, tmp).collect(), key=lambda r: (r.line_id, r.l_linenumber)):
        paths.setdefault(r.line_id, []).append((r.x, r.y))
    want = {}
    for k, x0, y0, x1, y1 in squares:
        ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
        n = sum(any(_pip(ring[:-1], x, y) for x, y in p) or any(
            _seg_int(a, b, c, d) for a, b in zip(p, p[1:]) for c, d in zip(ring, ring[1:])) for p in paths.values())
        if n:
            want[k] = n

    def no_pairs(*a, **k):
        raise AssertionError("rows of pairs")

    monkeypatch.setattr(S, "_paths_join", no_pairs)
    got = {r.parcel_id: r.n_lines for r in parcel_line_counts(spark, tmp).collect()}
    assert got == want and sum(want.values()) > 50
