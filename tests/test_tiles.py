"""K11 tile keys and per-tile thinning against a pure-Python computation."""

import math
import random

from pyspark.sql import functions as F

from terrane.functions import geom as G
from terrane.operators import tiles as TL


def _tile(lon, lat, z):
    n = 2.0 ** z
    lat = max(min(lat, 85.0511287798), -85.0511287798)
    r = math.radians(lat)
    x = math.floor((lon + 180.0) / 360.0 * n)
    y = math.floor((1.0 - math.log(math.tan(r) + 1.0 / math.cos(r)) / math.pi) / 2.0 * n)
    return int(min(max(x, 0), n - 1)), int(min(max(y, 0), n - 1))


def test_tile_keys_and_thinning(spark):
    rnd = random.Random(3)
    # a hot tile: a third of the points in one small area
    pts = [(i, -71.5 + rnd.uniform(0, 0.001), 43.2 + rnd.uniform(0, 0.001)) for i in range(300)]
    pts += [(300 + i, rnd.uniform(-72, -71), rnd.uniform(42.9, 43.6)) for i in range(600)]
    df = spark.createDataFrame(pts, "feature_id long, lon double, lat double")
    kept, counts = TL.thin_tiles(df, 10, 12, cap=7)
    got = {(r.z, r.tx, r.ty): (r.n, r.n_kept) for r in counts.collect()}
    want = {}
    members = {}
    for i, lon, lat in pts:
        for z in range(10, 13):
            members.setdefault((z,) + _tile(lon, lat, z), []).append(i)
    for k, ids in members.items():
        want[k] = (len(ids), min(len(ids), 7))
    assert got == want
    kept_ids = {(r.z, r.tx, r.ty, r.feature_id) for r in kept.collect()}
    assert kept_ids == {k + (i,) for k, ids in members.items() for i in sorted(ids)[:7]}


def _world(lon, lat, z):
    r = math.radians(lat)
    return ((lon + 180.0) / 360.0 * 2 ** z,
            (1.0 - math.log(math.tan(r) + 1.0 / math.cos(r)) / math.pi) / 2.0 * 2 ** z)


def test_lines_cut_to_tiles(spark):
    """Parts of all segments, found by cutting at every border crossed and
    looking where each piece's middle lies."""
    rnd = random.Random(9)
    lines = {i: [(rnd.uniform(-72, -71), rnd.uniform(42.5, 43.5)) for _ in range(rnd.randint(2, 4))] for i in range(60)}
    lines[100] = [(-72.0, 43.0)]                                    # one vertex
    lines[101] = [(-71.71875, 42.6), (-71.71875, 43.4)]             # along a border of zoom 8 and finer
    lines[102] = [(-71.5, 43.0), (-71.5, 43.0), (-71.4, 43.0)]      # a repeated vertex
    lines[103] = [(179.9, 10.0), (180.0, 10.0), (180.0, 10.4)]      # the end of the world
    rows = [(k, [(x, y) for x, y in p]) for k, p in lines.items()]
    df = (spark.createDataFrame(rows, "line long, p array<struct<x: double, y: double>>")
          .select("line", G.line(F.col("p")).alias("shape"), F.lit("x").alias("z_name")))
    want = {}
    for k, p in lines.items():
        for z in (8, 10):
            w = [_world(x, y, z) for x, y in p]
            for a, b in zip(w, w[1:] or w):
                ts = {0.0, 1.0}
                for u, v in zip(a, b):
                    if u != v:
                        ts |= {(m - u) / (v - u) for m in range(math.floor(min(u, v)), math.ceil(max(u, v)) + 1)
                               if 0 < (m - u) / (v - u) < 1}
                ts = sorted(ts)
                for t, s in zip(ts, ts[1:]):
                    if s - t > 1e-9:
                        mid = [min(math.floor(u + (v - u) * (t + s) / 2), 2 ** z - 1) for u, v in zip(a, b)]
                        at = (z, *mid, k)
                        want[at] = want.get(at, 0.0) + (s - t) * math.dist(a, b)
    kept, counts = TL.thin_line_tiles(df, 8, 10, 5, "line", "shape")
    parts = {}
    for r in TL.cut_lines(df, 8, 10, "line", "shape").collect():
        at = (r.z, r.tx, r.ty, r.line)
        assert r.tx - 1e-6 <= min(r.ax, r.bx) and max(r.ax, r.bx) <= r.tx + 1 + 1e-6
        assert r.ty - 1e-6 <= min(r.ay, r.by) and max(r.ay, r.by) <= r.ty + 1 + 1e-6
        parts[at] = parts.get(at, 0.0) + math.dist((r.ax, r.ay), (r.bx, r.by))
    parts = {k: v for k, v in parts.items() if k[0] != 9}
    assert parts.keys() == want.keys()
    assert all(abs(parts[k] - v) < 1e-6 for k, v in want.items())
    by_tile = {}
    for (z, x, y, k), v in want.items():
        by_tile.setdefault((z, x, y), []).append((-round(v, 6), k))
    got = {(r.z, r.tx, r.ty): (r.n, r.n_kept) for r in counts.collect() if r.z != 9}
    assert got == {t: (len(v), min(len(v), 5)) for t, v in by_tile.items()}
    top = {(r.z, r.tx, r.ty, r.line) for r in kept.collect() if r.z != 9}
    assert top == {(*t, k) for t, v in by_tile.items() for _, k in sorted(v)[:5]}
    assert TL.cut_lines(df.limit(0), 8, 10, "line", "shape").count() == 0
