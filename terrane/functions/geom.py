"""Geometry as a plain struct column, and G1-G16 as Column expressions.

    geom STRUCT<kind STRING,                 'point' | 'line' | 'poly'
                parts ARRAY<ARRAY<ARRAY<STRUCT<x DOUBLE, y DOUBLE>>>>,
                xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE,
                srid INT>

``parts`` is part > ring > vertex. A point part holds one one-vertex ring, a line
part one open vertex path, a polygon part a shell followed by its holes (closed
rings). The envelope is stored beside the vertices so that a bbox test is a
plain comparison the Parquet reader can prune on.

Everything here returns a :class:`Column` built from Spark SQL higher-order
functions (``transform``, ``aggregate``, ``exists``, ``filter``, ``sequence``),
so it runs inside the JVM next to the scan; nothing here calls Python per row.
The SQL builders (``*_sql``) take the SQL text of their inputs so predicates can
be composed inside one expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(VERTEX)
PART = T.ArrayType(RING)
GEOM = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("parts", T.ArrayType(PART)),
    T.StructField("xmin", T.DoubleType()),
    T.StructField("ymin", T.DoubleType()),
    T.StructField("xmax", T.DoubleType()),
    T.StructField("ymax", T.DoubleType()),
    T.StructField("srid", T.IntegerType()),
])

# Sphere radius used for geodesic distance (metres) and metric
# unit conversions of the measure report.
EARTH_RADIUS_M = 6371010.0
M2_PER_ACRE = 4046.86
FT_PER_M = 3.28084


def num(v: float) -> str:
    """A double literal both Spark SQL and DuckDB read as DOUBLE."""
    return format(float(v), ".17e")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --------------------------------------------------------------------------- #
# constructors (G1, G16, line / polygon builders)
# --------------------------------------------------------------------------- #

def make_geom(kind: str, parts: Column, srid: int = 4326) -> Column:
    """Geometry from a parts array; the envelope is computed from the vertices."""
    return _geom_from_parts(kind, parts, srid)


def _geom_from_parts(kind: str, parts: Column, srid: int) -> Column:
    verts = F.flatten(F.flatten(parts))
    xs = F.transform(verts, lambda v: v["x"])
    ys = F.transform(verts, lambda v: v["y"])
    return F.struct(
        F.lit(kind).alias("kind"), parts.cast(T.ArrayType(PART)).alias("parts"),
        F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"),
        F.lit(srid).cast("int").alias("srid"))


def point(x, y, srid: int = 4326) -> Column:
    """G1: point geometry from lon/lat columns; null when either is null."""
    x, y = _c(x).cast("double"), _c(y).cast("double")
    v = F.struct(x.alias("x"), y.alias("y"))
    g = F.struct(
        F.lit("point").alias("kind"),
        F.array(F.array(F.array(v))).alias("parts"),
        x.alias("xmin"), y.alias("ymin"), x.alias("xmax"), y.alias("ymax"),
        F.lit(srid).cast("int").alias("srid"))
    return F.when(x.isNotNull() & y.isNotNull(), g)


def line(vertices: Column, srid: int = 4326) -> Column:
    """One-part line from an ordered ``array<struct<x,y>>``."""
    return _geom_from_parts("line", F.array(F.array(vertices)), srid)


def polygon(rings: Column, srid: int = 4326) -> Column:
    """One-part polygon from ``array<ring>`` (shell first, then holes).
    Rings are closed if their last vertex differs from the first."""
    closed = F.transform(rings, lambda r: F.when(
        (F.element_at(r, 1)["x"] != F.element_at(r, -1)["x"])
        | (F.element_at(r, 1)["y"] != F.element_at(r, -1)["y"]),
        F.concat(r, F.array(F.element_at(r, 1)))).otherwise(r))
    return _geom_from_parts("poly", F.array(closed), srid)


def rect(xmin, ymin, xmax, ymax, srid: int = 4326) -> Column:
    """Bbox -> closed counter-clockwise rectangle polygon."""
    xmin, ymin, xmax, ymax = (_c(v) if not isinstance(v, (int, float)) else F.lit(float(v))
                              for v in (xmin, ymin, xmax, ymax))
    ring = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in
                     ((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin))])
    return F.struct(
        F.lit("poly").alias("kind"), F.array(F.array(ring)).alias("parts"),
        xmin.alias("xmin"), ymin.alias("ymin"), xmax.alias("xmax"), ymax.alias("ymax"),
        F.lit(srid).cast("int").alias("srid"))


def literal_polygon(coords: list[tuple[float, float]], holes=(), srid: int = 4326) -> Column:
    """Polygon literal from Python coordinates (drawn shapes, bbox polygons)."""
    def ring(cs):
        cs = list(cs)
        if cs[0] != cs[-1]:
            cs.append(cs[0])
        return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
                         for x, y in cs])
    rings = [ring(coords)] + [ring(h) for h in holes]
    xs = [c[0] for c in coords]
    ys = [c[1] for c in coords]
    return F.struct(
        F.lit("poly").alias("kind"), F.array(F.array(*rings)).alias("parts"),
        F.lit(min(xs)).alias("xmin"), F.lit(min(ys)).alias("ymin"),
        F.lit(max(xs)).alias("xmax"), F.lit(max(ys)).alias("ymax"),
        F.lit(srid).cast("int").alias("srid"))


# --------------------------------------------------------------------------- #
# SQL builders for predicates and measures
# --------------------------------------------------------------------------- #

def edge_idx_sql(r: str) -> str:
    """0..size(r)-2 as an array, empty for rings/paths with fewer than two
    vertices (``sequence(0, -1)`` would count down)."""
    return f"slice(sequence(0, greatest(size({r})-2, 0)), 1, greatest(size({r})-1, 0))"


def _edge_sql(r: str, i: str):
    """Coordinates of edge i of ring r (0-based Spark indexing)."""
    return (f"{r}[{i}].x", f"{r}[{i}].y", f"{r}[{i}+1].x", f"{r}[{i}+1].y")


def ring_crossings_sql(r: str, px: str, py: str, i: str = "i") -> str:
    """Number of ring edges a ray from (px,py) towards +x crosses (half-open rule)."""
    ax, ay, bx, by = _edge_sql(r, i)
    # px < ax + (bx-ax)(py-ay)/(by-ay), multiplied through by (by-ay) so no
    # division is evaluated
    return (f"size(filter({edge_idx_sql(r)}, {i} -> (({ay} > {py}) != ({by} > {py})) "
            f"AND ((({px}) - {ax}) * ({by} - {ay}) - ({bx} - {ax}) * (({py}) - {ay})) "
            f"* sign({by} - {ay}) < 0))")


def ring_on_edge_sql(r: str, px: str, py: str, i: str = "i") -> str:
    """True when (px,py) lies exactly on an edge of ring r."""
    ax, ay, bx, by = _edge_sql(r, i)
    return (f"exists({edge_idx_sql(r)}, {i} -> "
            f"(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}) = 0) "
            f"AND {px} BETWEEN least({ax}, {bx}) AND greatest({ax}, {bx}) "
            f"AND {py} BETWEEN least({ay}, {by}) AND greatest({ay}, {by}))")


def covers_point_sql(g: str, px: str, py: str, sfx: str = "") -> str:
    """G9 for a point against a polygon geometry: boundary inclusive, even-odd
    over every ring of every part (holes and multipolygons included)."""
    rings = f"flatten({g}.parts)"
    r, acc, i = f"r{sfx}", f"acc{sfx}", f"i{sfx}"
    on_edge = f"exists({rings}, {r} -> {ring_on_edge_sql(r, px, py, i)})"
    odd = (f"(aggregate({rings}, 0, ({acc}, {r}) -> {acc} + "
           f"{ring_crossings_sql(r, px, py, i)}) % 2 = 1)")
    env = f"({px} BETWEEN {g}.xmin AND {g}.xmax AND {py} BETWEEN {g}.ymin AND {g}.ymax)"
    return f"({env} AND ({on_edge} OR {odd}))"


def _orient(ax, ay, bx, by, cx, cy) -> str:
    return f"(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"


def segments_intersect_sql(p1x, p1y, p2x, p2y, q1x, q1y, q2x, q2y) -> str:
    """Closed segments p1p2 and q1q2 share at least one point."""
    o1 = _orient(p1x, p1y, p2x, p2y, q1x, q1y)
    o2 = _orient(p1x, p1y, p2x, p2y, q2x, q2y)
    o3 = _orient(q1x, q1y, q2x, q2y, p1x, p1y)
    o4 = _orient(q1x, q1y, q2x, q2y, p2x, p2y)
    env = (f"(greatest({p1x}, {p2x}) >= least({q1x}, {q2x}) AND greatest({q1x}, {q2x}) >= least({p1x}, {p2x}) "
           f"AND greatest({p1y}, {p2y}) >= least({q1y}, {q2y}) AND greatest({q1y}, {q2y}) >= least({p1y}, {p2y}))")
    return (f"({env} AND ({o1} * {o2} <= 0) AND ({o3} * {o4} <= 0))")


def edges_cross_sql(ga: str, gb: str) -> str:
    """Some edge of ``ga`` touches some edge of ``gb`` (paths of lines, rings of
    polygons)."""
    ra, rb = f"flatten({ga}.parts)", f"flatten({gb}.parts)"
    inner = segments_intersect_sql("ra[ia].x", "ra[ia].y", "ra[ia+1].x", "ra[ia+1].y",
                                   "rb[ib].x", "rb[ib].y", "rb[ib+1].x", "rb[ib+1].y")
    return (f"exists({ra}, ra -> exists({edge_idx_sql('ra')}, ia -> "
            f"exists({rb}, rb -> exists({edge_idx_sql('rb')}, ib -> {inner}))))")


def envelopes_overlap_sql(a: str, b: str) -> str:
    return (f"({a}.xmin <= {b}.xmax AND {a}.xmax >= {b}.xmin "
            f"AND {a}.ymin <= {b}.ymax AND {a}.ymax >= {b}.ymin)")


def intersects_polygon_sql(g: str, poly: str) -> str:
    """Does geometry ``g`` (point, line or polygon) intersect polygon ``poly``?
    Boundary inclusive. Envelope test first, exact test after."""
    any_vertex_in = (f"exists(flatten(flatten({g}.parts)), gv -> "
                     f"{covers_point_sql(poly, 'gv.x', 'gv.y', 'p')})")
    poly_vertex_in = (f"exists(flatten(flatten({poly}.parts)), pv -> "
                      f"{covers_point_sql(g, 'pv.x', 'pv.y', 'g')})")
    one_point = covers_point_sql(poly, f"{g}.xmin", f"{g}.ymin", "q")
    exact = (f"CASE {g}.kind WHEN 'point' THEN (CASE WHEN size({g}.parts) = 1 THEN {one_point} "
             f"ELSE {any_vertex_in} END) "
             f"WHEN 'line' THEN ({any_vertex_in} OR {edges_cross_sql(g, poly)}) "
             f"ELSE ({any_vertex_in} OR {poly_vertex_in} OR {edges_cross_sql(g, poly)}) END")
    return f"({envelopes_overlap_sql(g, poly)} AND {exact})"


def intersects_polygon(g, poly) -> Column:
    return F.expr(intersects_polygon_sql(g, poly))


def covers_point(poly: str, px: str, py: str) -> Column:
    return F.expr(covers_point_sql(poly, px, py))


# ----- distances (G10 planar degrees, G11 metres) ---------------------------

def _seg_dist_sql(ax, ay, bx, by, px, py, kx="1", ky="1") -> str:
    """Distance from (px,py) to segment ab after scaling x by kx and y by ky."""
    dx, dy = f"(({bx}) - ({ax})) * {kx}", f"(({by}) - ({ay})) * {ky}"
    wx, wy = f"(({px}) - ({ax})) * {kx}", f"(({py}) - ({ay})) * {ky}"
    l2 = f"({dx} * {dx} + {dy} * {dy})"
    t = f"(CASE WHEN {l2} = 0 THEN CAST(0 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), ({wx} * {dx} + {wy} * {dy}) / {l2})) END)"
    ex, ey = f"({wx} - {t} * {dx})", f"({wy} - {t} * {dy})"
    return f"sqrt({ex} * {ex} + {ey} * {ey})"


def _min_edge_dist_sql(g: str, px: str, py: str, kx="1", ky="1") -> str:
    seg = _seg_dist_sql("dr[di].x", "dr[di].y", "dr[di+1].x", "dr[di+1].y", px, py, kx, ky)
    vtx = _seg_dist_sql("dr[0].x", "dr[0].y", "dr[0].x", "dr[0].y", px, py, kx, ky)
    return (f"array_min(transform(flatten({g}.parts), dr -> CASE WHEN size(dr) = 1 THEN {vtx} "
            f"ELSE array_min(transform({edge_idx_sql('dr')}, di -> {seg})) END))")


def distance_deg_sql(g: str, px: str, py: str) -> str:
    """Planar distance in degrees from (px,py) to g; 0 inside a polygon."""
    inside = covers_point_sql(g, px, py, "d")
    return (f"(CASE WHEN {g}.kind = 'poly' AND {inside} THEN CAST(0 AS DOUBLE) "
            f"ELSE {_min_edge_dist_sql(g, px, py)} END)")


def haversine_sql(x1: str, y1: str, x2: str, y2: str) -> str:
    """Great-circle metres on the sphere of radius EARTH_RADIUS_M."""
    r = num(EARTH_RADIUS_M)
    return (f"(2 * {r} * asin(sqrt(least(CAST(1 AS DOUBLE), power(sin(radians(({y2}) - ({y1})) / 2), 2) + "
            f"cos(radians({y1})) * cos(radians({y2})) * power(sin(radians(({x2}) - ({x1})) / 2), 2)))))")


def distance_m_sql(g: str, px: str, py: str) -> str:
    """Metres from (px,py) to g. Points: haversine to the nearest vertex.
    Lines/polygons: point-segment distance in a local equirectangular frame at
    the query latitude; 0 inside a polygon."""
    ky = f"({num(EARTH_RADIUS_M)} * pi() / 180)"
    kx = f"({ky} * cos(radians({py})))"
    pts = f"array_min(transform(flatten(flatten({g}.parts)), hv -> {haversine_sql(px, py, 'hv.x', 'hv.y')}))"
    inside = covers_point_sql(g, px, py, "m")
    return (f"(CASE WHEN {g}.kind = 'point' THEN {pts} "
            f"WHEN {g}.kind = 'poly' AND {inside} THEN CAST(0 AS DOUBLE) "
            f"ELSE {_min_edge_dist_sql(g, px, py, kx, ky)} END)")


# ----- measures (G3-G5, G7) ---------------------------------------------------

def _ring_area2_sql(r: str, i: str = "ai") -> str:
    """Twice the signed shoelace area of ring r, computed about its first vertex
    (keeps products small in projected metres)."""
    x0, y0 = f"{r}[0].x", f"{r}[0].y"
    term = (f"(({r}[{i}].x - {x0}) * ({r}[{i}+1].y - {y0}) - "
            f"({r}[{i}+1].x - {x0}) * ({r}[{i}].y - {y0}))")
    return f"aggregate({edge_idx_sql(r)}, CAST(0 AS DOUBLE), (s, {i}) -> s + {term})"


def area_sql(g: str) -> str:
    """Planar polygon area, holes subtracted (0 for points and lines)."""
    part = (f"aggregate(slice(sequence(0, greatest(size(pp)-1, 0)), 1, size(pp)), CAST(0 AS DOUBLE), (s2, k) -> s2 + "
            f"CASE WHEN k = 0 THEN abs({_ring_area2_sql('pp[k]')}) "
            f"ELSE -abs({_ring_area2_sql('pp[k]')}) END)")
    return (f"(CASE WHEN {g}.kind = 'poly' THEN "
            f"aggregate({g}.parts, CAST(0 AS DOUBLE), (acc, pp) -> acc + {part}) / 2 ELSE CAST(0 AS DOUBLE) END)")


def length_sql(g: str) -> str:
    """Planar length of line paths, or boundary length of polygon rings."""
    seg = "sqrt(power(lr[li+1].x - lr[li].x, 2) + power(lr[li+1].y - lr[li].y, 2))"
    return (f"(CASE WHEN {g}.kind = 'point' THEN CAST(0 AS DOUBLE) ELSE aggregate(flatten({g}.parts), CAST(0 AS DOUBLE), "
            f"(acc, lr) -> acc + aggregate({edge_idx_sql('lr')}, CAST(0 AS DOUBLE), (s, li) -> s + {seg})) END)")


def area(g: str) -> Column:
    return F.expr(area_sql(g))


def length(g: str) -> Column:
    return F.expr(length_sql(g))


# UTM zone 19N (EPSG:32619) by the Krueger series to fourth order in n
# (Karney 2011, "Transverse Mercator with an accuracy of a few nanometers").
# WGS84 ellipsoid and the zone's projection parameters.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM19_LON0 = -69.0


def _utm_constants():
    n = WGS84_F / (2 - WGS84_F)
    a_rect = WGS84_A / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    alpha = (n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180,
             13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440,
             61 * n ** 3 / 240 - 103 * n ** 4 / 140,
             49561 * n ** 4 / 161280)
    e = 2 * math.sqrt(n) / (1 + n)
    return a_rect, alpha, e


def utm_sql(lon: str, lat: str, lon0: float = UTM19_LON0):
    """SQL for (easting, northing) of (lon, lat) degrees in a northern UTM
    zone; plain arithmetic and trig, so the same text runs in DuckDB."""
    a_rect, alpha, e = _utm_constants()
    phi = f"radians({lat})"
    lam = f"radians(({lon}) - ({num(lon0)}))"
    t = f"sinh(atanh(sin({phi})) - {num(e)} * atanh({num(e)} * sin({phi})))"
    xi = f"atan({t} / cos({lam}))"
    eta = f"atanh(sin({lam}) / sqrt(1 + {t} * {t}))"
    ka = num(UTM_K0 * a_rect)
    e_terms = " + ".join(f"{num(a)} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})"
                         for j, a in enumerate(alpha, start=1))
    n_terms = " + ".join(f"{num(a)} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})"
                         for j, a in enumerate(alpha, start=1))
    easting = f"({num(UTM_FALSE_EASTING)} + {ka} * ({eta} + {e_terms}))"
    northing = f"({ka} * ({xi} + {n_terms}))"
    return easting, northing


def _utm_vertex_stages(verts: str, lon0: float) -> str:
    """Project an array of vertices with chained transforms so t, xi' and
    eta' are computed once per vertex (a single lambda would repeat them)."""
    a_rect, alpha, e = _utm_constants()
    ka = num(UTM_K0 * a_rect)
    s1 = (f"transform({verts}, uv -> named_struct('phi', radians(uv.y), "
          f"'lam', radians(uv.x - ({num(lon0)}))))")
    s2 = (f"transform({s1}, u1 -> named_struct('t', sinh(atanh(sin(u1.phi)) - {num(e)} * "
          f"atanh({num(e)} * sin(u1.phi))), 'lam', u1.lam))")
    s3 = (f"transform({s2}, u2 -> named_struct('xi', atan(u2.t / cos(u2.lam)), "
          f"'eta', atanh(sin(u2.lam) / sqrt(1 + u2.t * u2.t))))")
    e_terms = " + ".join(f"{num(a)} * cos({2 * j} * u3.xi) * sinh({2 * j} * u3.eta)"
                         for j, a in enumerate(alpha, start=1))
    n_terms = " + ".join(f"{num(a)} * sin({2 * j} * u3.xi) * cosh({2 * j} * u3.eta)"
                         for j, a in enumerate(alpha, start=1))
    return (f"transform({s3}, u3 -> named_struct('x', {num(UTM_FALSE_EASTING)} + {ka} * (u3.eta + {e_terms}), "
            f"'y', {ka} * (u3.xi + {n_terms})))")


def to_utm_sql(g: str, lon0: float = UTM19_LON0, srid: int = 32619) -> str:
    """Reproject every vertex of a 4326 geometry to UTM metres."""
    parts = (f"transform({g}.parts, up -> transform(up, ur -> {_utm_vertex_stages('ur', lon0)}))")
    return (f"(CASE WHEN {g} IS NULL THEN NULL ELSE "
            f"named_struct('kind', {g}.kind, 'parts', {parts}, "
            f"'xmin', CAST(NULL AS DOUBLE), 'ymin', CAST(NULL AS DOUBLE), "
            f"'xmax', CAST(NULL AS DOUBLE), 'ymax', CAST(NULL AS DOUBLE), 'srid', {srid}) END)")


def to_utm(g: str, lon0: float = UTM19_LON0) -> Column:
    """G3 as a Column; the envelope is recomputed in projected units."""
    return refresh_envelope(F.expr(to_utm_sql(g, lon0)))


def refresh_envelope(g: Column) -> Column:
    verts = F.flatten(F.flatten(g["parts"]))
    xs = F.transform(verts, lambda v: v["x"])
    ys = F.transform(verts, lambda v: v["y"])
    return F.struct(g["kind"].alias("kind"), g["parts"].alias("parts"),
                    F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
                    F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"),
                    g["srid"].alias("srid"))


def centroid_sql(g: str) -> tuple[str, str]:
    """Planar centroid. Polygons: area-weighted over all rings (holes have
    negative weight); lines: length-weighted segment midpoints; points: mean.
    Moments are taken about the envelope's lower-left corner, so small shapes
    far from the origin keep their precision."""
    rings = f"flatten({g}.parts)"
    ox, oy = f"{g}.xmin", f"{g}.ymin"
    X = lambda v: f"({v}.x - {ox})"
    Y = lambda v: f"({v}.y - {oy})"

    def cross(r):
        a, b = f"{r}[ci]", f"{r}[ci+1]"
        return f"({X(a)} * {Y(b)} - {X(b)} * {Y(a)})"

    def ring_moment(r, axis):
        a, b = f"{r}[ci]", f"{r}[ci+1]"
        s = f"({X(a)} + {X(b)})" if axis == "x" else f"({Y(a)} + {Y(b)})"
        return f"aggregate({edge_idx_sql(r)}, CAST(0 AS DOUBLE), (cs, ci) -> cs + {s} * {cross(r)})"

    def ring_a2(r):
        return f"aggregate({edge_idx_sql(r)}, CAST(0 AS DOUBLE), (cs, ci) -> cs + {cross(r)})"

    # shells counted positive, holes negative, regardless of winding
    def signed(expr, r, k):
        return (f"(CASE WHEN {k} = 0 THEN 1 ELSE -1 END) * "
                f"(CASE WHEN {ring_a2(r)} < 0 THEN -1 ELSE 1 END) * {expr}")

    def poly_sum(expr_fn):
        return (f"aggregate({g}.parts, CAST(0 AS DOUBLE), (pa, pp) -> pa + "
                f"aggregate(slice(sequence(0, greatest(size(pp)-1, 0)), 1, size(pp)), CAST(0 AS DOUBLE), "
                f"(pk, k) -> pk + {signed(expr_fn('pp[k]'), 'pp[k]', 'k')}))")

    a2 = poly_sum(ring_a2)
    mx = poly_sum(lambda r: ring_moment(r, "x"))
    my = poly_sum(lambda r: ring_moment(r, "y"))
    seg_len = "sqrt(power(lr[li+1].x - lr[li].x, 2) + power(lr[li+1].y - lr[li].y, 2))"

    def line_sum(expr):
        return (f"aggregate({rings}, CAST(0 AS DOUBLE), (la, lr) -> la + aggregate({edge_idx_sql('lr')}, "
                f"CAST(0 AS DOUBLE), (ls, li) -> ls + {expr}))")
    llen = line_sum(seg_len)
    lmx = line_sum(f"{seg_len} * ({X('lr[li]')} + {X('lr[li+1]')}) / 2")
    lmy = line_sum(f"{seg_len} * ({Y('lr[li]')} + {Y('lr[li+1]')}) / 2")
    verts = f"flatten({rings})"
    px = f"aggregate({verts}, CAST(0 AS DOUBLE), (s, v) -> s + {X('v')}) / greatest(size({verts}), 1)"
    py = f"aggregate({verts}, CAST(0 AS DOUBLE), (s, v) -> s + {Y('v')}) / greatest(size({verts}), 1)"
    cx = (f"({ox} + (CASE WHEN {g}.kind = 'poly' AND {a2} != 0 THEN {mx} / (3 * {a2}) "
          f"WHEN {g}.kind = 'line' AND {llen} > 0 THEN {lmx} / {llen} ELSE {px} END))")
    cy = (f"({oy} + (CASE WHEN {g}.kind = 'poly' AND {a2} != 0 THEN {my} / (3 * {a2}) "
          f"WHEN {g}.kind = 'line' AND {llen} > 0 THEN {lmy} / {llen} ELSE {py} END))")
    return cx, cy


def centroid(g: str) -> Column:
    cx, cy = centroid_sql(g)
    return point(F.expr(cx), F.expr(cy))


# ----- text forms (G14, S12) ----------------------------------------------

def to_wkt_sql(g: str, digits: int = 6) -> str:
    """WKT text (POINT / LINESTRING / POLYGON and their MULTI forms)."""
    vtx = lambda v: (f"concat(cast(round({v}.x, {digits}) as string), ' ', "
                     f"cast(round({v}.y, {digits}) as string))")
    ring = lambda r: f"concat('(', array_join(transform({r}, wv -> {vtx('wv')}), ', '), ')')"
    part_poly = lambda p: f"concat('(', array_join(transform({p}, wr -> {ring('wr')}), ', '), ')')"
    n = f"size({g}.parts)"
    point1 = f"concat('POINT (', {vtx(f'{g}.parts[0][0][0]')}, ')')"
    mpoint = f"concat('MULTIPOINT (', array_join(transform({g}.parts, wp -> {vtx('wp[0][0]')}), ', '), ')')"
    line1 = f"concat('LINESTRING ', {ring(f'{g}.parts[0][0]')})"
    mline = f"concat('MULTILINESTRING (', array_join(transform({g}.parts, wp -> {ring('wp[0]')}), ', '), ')')"
    poly1 = f"concat('POLYGON ', {part_poly(f'{g}.parts[0]')})"
    mpoly = f"concat('MULTIPOLYGON (', array_join(transform({g}.parts, wp -> {part_poly('wp')}), ', '), ')')"
    return (f"(CASE WHEN {g} IS NULL THEN NULL "
            f"WHEN {g}.kind = 'point' THEN (CASE WHEN {n} = 1 THEN {point1} ELSE {mpoint} END) "
            f"WHEN {g}.kind = 'line' THEN (CASE WHEN {n} = 1 THEN {line1} ELSE {mline} END) "
            f"ELSE (CASE WHEN {n} = 1 THEN {poly1} ELSE {mpoly} END) END)")


def to_wkt(g: str, digits: int = 6) -> Column:
    return F.expr(to_wkt_sql(g, digits))


_NUM = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"


def point_from_wkt(text) -> Column:
    """``Point(lon lat)`` text to a point; non-matching text -> null."""
    t = _c(text)
    pat = rf"(?i)^\s*POINT\s*\(\s*({_NUM})\s+({_NUM})\s*\)\s*$"
    x = F.regexp_extract(t, pat, 1)
    y = F.regexp_extract(t, pat, 2)
    xd = F.when(x != "", x).try_cast("double")
    yd = F.when(y != "", y).try_cast("double")
    return point(xd, yd)


def geom_from_wkt(text) -> Column:
    """WKT text of POINT / LINESTRING / POLYGON and their MULTI forms to
    geometry (other types -> null). Rings are parsed with split/transform, all
    inside the JVM."""
    t = F.upper(F.trim(_c(text)))
    body = F.regexp_extract(t, r"^[A-Z]+\s*\((.*)\)$", 1)

    def parse_path(s):
        pts = F.split(F.regexp_replace(s, r"[()]", ""), r"\s*,\s*")
        return F.transform(pts, lambda p: F.struct(
            F.get(F.split(F.trim(p), r"\s+"), 0).try_cast("double").alias("x"),
            F.get(F.split(F.trim(p), r"\s+"), 1).try_cast("double").alias("y")))

    kind = F.regexp_extract(t, r"^([A-Z]+)", 1)
    def parse_paths(s):
        return F.transform(F.split(F.regexp_replace(s, r"^\s*\(|\)\s*$", ""), r"\)\s*,\s*\("), parse_path)

    rings = parse_paths(body)
    pt = point_from_wkt(_c(text))
    ln = line(parse_path(body))
    pg = _geom_from_parts("poly", F.array(rings), 4326)
    return (F.when(kind == "POINT", pt)
            .when(kind == "LINESTRING", ln)
            .when(kind == "POLYGON", pg)
            .when(kind == "MULTIPOINT", _geom_from_parts(
                "point", F.transform(parse_path(body), lambda v: F.array(F.array(v))), 4326))
            .when(kind == "MULTILINESTRING", _geom_from_parts(
                "line", F.transform(rings, lambda p: F.array(p)), 4326))
            .when(kind == "MULTIPOLYGON", _geom_from_parts(
                "poly", F.transform(F.split(body, r"\)\s*\)\s*,\s*\(\s*\("), parse_paths), 4326)))


def kind_of_layer(kinds: Column) -> Column:
    """A layer's kind is its single distinct kind, else 'point'."""
    return F.when(F.size(kinds) == 1, F.element_at(kinds, 1)).otherwise(F.lit("point"))


# --------------------------------------------------------------------------- #
# flat edge / vertex arrays: computed once per geometry, used by join refines
# --------------------------------------------------------------------------- #

def edges_array_sql(g: str) -> str:
    """Every path / ring edge of ``g`` as array<struct<ax, ay, bx, by>> (a
    one-vertex path gives a zero-length edge)."""
    return (f"flatten(transform(flatten({g}.parts), er -> transform("
            f"IF(size(er) = 1, array(0), {edge_idx_sql('er')}), ei -> named_struct("
            f"'ax', er[ei].x, 'ay', er[ei].y, 'bx', er[least(ei + 1, size(er) - 1)].x, "
            f"'by', er[least(ei + 1, size(er) - 1)].y))))")


def vertices_array_sql(g: str) -> str:
    return f"flatten(flatten({g}.parts))"


def pip_edges_sql(edges: str, px: str, py: str, v: str = "e") -> str:
    """Boundary-inclusive even-odd point-in-polygon over a flat edge array
    (all rings of all parts; holes fall out of the even-odd rule)."""
    on_edge = (f"exists({edges}, {v} -> (({v}.bx - {v}.ax) * ({py} - {v}.ay) - ({v}.by - {v}.ay) * ({px} - {v}.ax) = 0) "
               f"AND {px} BETWEEN least({v}.ax, {v}.bx) AND greatest({v}.ax, {v}.bx) "
               f"AND {py} BETWEEN least({v}.ay, {v}.by) AND greatest({v}.ay, {v}.by))")
    odd = (f"(size(filter({edges}, {v} -> (({v}.ay > {py}) != ({v}.by > {py})) "
           f"AND ((({px}) - {v}.ax) * ({v}.by - {v}.ay) - ({v}.bx - {v}.ax) * (({py}) - {v}.ay)) "
           f"* sign({v}.by - {v}.ay) < 0)) % 2 = 1)")
    return f"({on_edge} OR {odd})"


def intersects_arrays_sql(f_geom: str, f_edges: str, f_verts: str,
                          p_geom: str, p_edges: str, p_verts: str) -> str:
    """G9 refine with precomputed arrays: feature (point / line / polygon) vs
    polygon, boundary inclusive, envelope test first."""
    one_point = f"({f_geom}.xmin BETWEEN {p_geom}.xmin AND {p_geom}.xmax AND {f_geom}.ymin BETWEEN {p_geom}.ymin AND {p_geom}.ymax AND {pip_edges_sql(p_edges, f'{f_geom}.xmin', f'{f_geom}.ymin')})"
    vin = f"exists({f_verts}, fv -> {pip_edges_sql(p_edges, 'fv.x', 'fv.y', 'pe')})"
    pin = f"exists({p_verts}, pv -> {pip_edges_sql(f_edges, 'pv.x', 'pv.y', 'fe')})"
    cross = ("exists(" + f_edges + ", a -> exists(" + p_edges + ", b -> "
             + segments_intersect_sql("a.ax", "a.ay", "a.bx", "a.by", "b.ax", "b.ay", "b.bx", "b.by") + "))")
    exact = (f"CASE {f_geom}.kind WHEN 'point' THEN (CASE WHEN size({f_geom}.parts) = 1 THEN {one_point} "
             f"ELSE {vin} END) WHEN 'line' THEN ({cross} OR {vin}) ELSE ({cross} OR {vin} OR {pin}) END")
    return f"({envelopes_overlap_sql(f_geom, p_geom)} AND {exact})"


def is_rect_sql(g: str) -> str:
    """True for a one-ring axis-aligned rectangle (closed, 5 vertices, every
    edge horizontal or vertical, every vertex on the envelope's corners)."""
    r = f"{g}.parts[0][0]"
    return (f"(size({g}.parts) = 1 AND size({g}.parts[0]) = 1 AND size({r}) = 5 "
            f"AND forall({r}, rv -> (rv.x = {g}.xmin OR rv.x = {g}.xmax) AND (rv.y = {g}.ymin OR rv.y = {g}.ymax)) "
            f"AND forall(sequence(0, 3), ri -> {r}[ri].x = {r}[ri + 1].x OR {r}[ri].y = {r}[ri + 1].y) "
            f"AND {g}.xmin < {g}.xmax AND {g}.ymin < {g}.ymax)")


def seg_hits_rect_sql(a: str, g: str) -> str:
    """Closed segment ``a`` (ax, ay, bx, by) meets the axis-aligned box of
    ``g``: the envelopes overlap and the box's corners are not all strictly on
    one side of the segment's line (separating-axis test)."""
    env = (f"(greatest({a}.ax, {a}.bx) >= {g}.xmin AND least({a}.ax, {a}.bx) <= {g}.xmax "
           f"AND greatest({a}.ay, {a}.by) >= {g}.ymin AND least({a}.ay, {a}.by) <= {g}.ymax)")
    corners = [(f"{g}.xmin", f"{g}.ymin"), (f"{g}.xmax", f"{g}.ymin"),
               (f"{g}.xmax", f"{g}.ymax"), (f"{g}.xmin", f"{g}.ymax")]
    o = [f"(({a}.bx - {a}.ax) * ({cy} - {a}.ay) - ({a}.by - {a}.ay) * ({cx} - {a}.ax))" for cx, cy in corners]
    all_pos = " AND ".join(f"{x} > 0" for x in o)
    all_neg = " AND ".join(f"{x} < 0" for x in o)
    return f"({env} AND NOT (({all_pos}) OR ({all_neg})))"


def intersects_rect_sql(f_geom: str, f_edges: str, p_geom: str) -> str:
    """G9 against an axis-aligned rectangle polygon: points by comparison,
    lines by the separating-axis test per edge, polygons additionally by the
    rectangle's corner lying inside them (rectangle within the polygon)."""
    inside_pt = (f"({f_geom}.xmin BETWEEN {p_geom}.xmin AND {p_geom}.xmax "
                 f"AND {f_geom}.ymin BETWEEN {p_geom}.ymin AND {p_geom}.ymax)")
    edges_hit = f"exists({f_edges}, ra -> {seg_hits_rect_sql('ra', p_geom)})"
    corner_in = pip_edges_sql(f_edges, f"{p_geom}.xmin", f"{p_geom}.ymin", "rc")
    return (f"(CASE {f_geom}.kind WHEN 'point' THEN (CASE WHEN size({f_geom}.parts) = 1 THEN {inside_pt} "
            f"ELSE {edges_hit} END) WHEN 'line' THEN {edges_hit} ELSE ({edges_hit} OR {corner_in}) END)")
