"""Registered spatial queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import geom as G
from terrane.operators import spatial as S
from terrane.plans import measure as M
from terrane.registry import query, rounded
from terrane.sources import fixtures as X
from terrane.sources.fixtures import with_fixtures

# ---------------------------------------------------------------------------
# SQL helpers for the oracle (plain arithmetic; DuckDB reads it as written)
# ---------------------------------------------------------------------------


def _utm(x: str, y: str) -> tuple[str, str]:
    return G.utm_sql(x, y)


def _seg_len_utm(ax, ay, bx, by) -> str:
    e1, n1 = _utm(ax, ay)
    e2, n2 = _utm(bx, by)
    return f"sqrt(power({e2} - {e1}, 2) + power({n2} - {n1}, 2))"


def _rect_edges_sql(src: str, key: str) -> str:
    """The four edges of every rectangle in ``src`` as (key, ax, ay, bx, by)."""
    corners = [("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax")]
    parts = []
    for i in range(4):
        (ax, ay), (bx, by) = corners[i], corners[(i + 1) % 4]
        parts.append(f"select {key} as q, {ax} as x1, {ay} as y1, {bx} as x2, {by} as y2 from {src}")
    return " union all ".join(parts)


def _pt_in_rect(px, py, t="t") -> str:
    return f"({px} between {t}.xmin and {t}.xmax and {py} between {t}.ymin and {t}.ymax)"


def _seg_hits_rect(ax, ay, bx, by, t="t") -> str:
    corners = [(f"{t}.xmin", f"{t}.ymin"), (f"{t}.xmax", f"{t}.ymin"),
               (f"{t}.xmax", f"{t}.ymax"), (f"{t}.xmin", f"{t}.ymax")]
    tests = []
    for i in range(4):
        (cx1, cy1), (cx2, cy2) = corners[i], corners[(i + 1) % 4]
        tests.append(G.segments_intersect_sql(ax, ay, bx, by, cx1, cy1, cx2, cy2))
    return "(" + " or ".join(tests) + ")"


# ---------------------------------------------------------------------------
# Draw-to-measure, batch over groups of shapes
# ---------------------------------------------------------------------------


def _region_shapes(spark, sf_dir):
    """Query shapes: each region's tracts form one drawing (query_id = region)."""
    t = X.tracts_layer(spark, sf_dir)
    return t.select(F.col("regionkey").alias("query_id"), F.col("geoid").alias("shape_id"), "geom")


def _corner_utm_cols():
    cols = []
    for i, (x, y) in enumerate([("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax")]):
        e, n = _utm(x, y)
        cols.append(f"{e} as e{i}, {n} as n{i}")
    return ", ".join(cols)


_MEASURE_SQL = with_fixtures(f"""
, corners as (
  select regionkey as query_id, {_corner_utm_cols()} from fx_tracts
), areas as (
  select query_id,
    sum(abs(((e1 - e0) * (n2 - n0) - (e2 - e0) * (n1 - n0)) + ((e2 - e0) * (n3 - n0) - (e3 - e0) * (n2 - n0))) / 2) as area_m2
  from corners group by query_id
), edges as (
  {_rect_edges_sql('fx_tracts', 'regionkey')}
), canon as (
  select q, least(struct_pack(x := x1, y := y1), struct_pack(x := x2, y := y2)) as a,
            greatest(struct_pack(x := x1, y := y1), struct_pack(x := x2, y := y2)) as b
  from edges
), outer_edges as (
  select q, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from canon group by q, a, b having count(*) = 1
), perim as (
  select q as query_id, sum({_seg_len_utm('x1', 'y1', 'x2', 'y2')}) as perim_m from outer_edges group by q
)
select a.query_id, round(a.area_m2, 3) as area_m2, round(a.area_m2 / {G.num(G.M2_PER_ACRE)}, 3) as area_acres,
       round(p.perim_m, 3) as perim_m, round(p.perim_m * {G.num(G.FT_PER_M)}, 3) as perim_ft
from areas a join perim p on a.query_id = p.query_id
""", "fx_tracts")


@query("draw_measure_regions", "P8 A6 A7 G3 G4 G5 G6 X11", _MEASURE_SQL)
def draw_measure_regions(spark, sf_dir):
    """Area (sum) and union perimeter of each region's tract polygons in UTM 19N."""
    return rounded(M.measure_shapes(_region_shapes(spark, sf_dir)), 3)


_COUNTS_SQL = with_fixtures(f"""
, pts as (select id, lon, lat from fx_points where lon is not null and lat is not null)
, pc as (
  select t.regionkey as query_id, count(distinct p.id) as n
  from pts p join fx_tracts t on {_pt_in_rect('p.lon', 'p.lat')} group by 1
), v as (
  select line_id, x, y,
    lead(x) over (partition by line_id order by l_linenumber, l_partkey, l_suppkey) as nx,
    lead(y) over (partition by line_id order by l_linenumber, l_partkey, l_suppkey) as ny
  from fx_vertices
), lc as (
  select t.regionkey as query_id, count(distinct v.line_id) as n
  from v join fx_tracts t on ({_pt_in_rect('v.x', 'v.y')}
       or (v.nx is not null and {_seg_hits_rect('v.x', 'v.y', 'v.nx', 'v.ny')}))
  group by 1
), frame as (
  select distinct t.regionkey as query_id, l.layer from fx_tracts t,
    (select 'points' as layer union all select 'lines') l
)
select f.query_id, f.layer,
  cast(coalesce(case f.layer when 'points' then pc.n else lc.n end, 0) as bigint) as n
from frame f left join pc on f.query_id = pc.query_id left join lc on f.query_id = lc.query_id
""", "fx_tracts", "fx_points", "fx_vertices")


@query("draw_counts_regions", "P8 J3 A4 G9 F5", _COUNTS_SQL)
def draw_counts_regions(spark, sf_dir):
    """Per region drawing and layer, features intersecting the union of the
    region's tracts (grid-cell join, exact boundary-inclusive test)."""
    shapes = _region_shapes(spark, sf_dir)
    layers = {"points": X.points_layer(spark, sf_dir).select("feature_id", "geom"),
              "lines": X.lines_layer(spark, sf_dir)}
    return M.count_in_shapes(shapes, layers)


_PARCEL_LINES_SQL = with_fixtures(f"""
, v as (
  select line_id, x, y,
    coalesce(lead(x) over w, x) as nx, coalesce(lead(y) over w, y) as ny,
  from fx_vertices window w as (partition by line_id order by l_linenumber, l_partkey, l_suppkey)
), t as (
  select id, x0 as xmin, y0 as ymin, x1 as xmax, y1 as ymax from fx_squares
)
select t.id as parcel_id, count(distinct v.line_id) as n_lines
from t join v on least(v.x, v.nx) <= t.xmax and greatest(v.x, v.nx) >= t.xmin
  and least(v.y, v.ny) <= t.ymax and greatest(v.y, v.ny) >= t.ymin
  and ({_pt_in_rect('v.x', 'v.y')} or {_seg_hits_rect('v.x', 'v.y', 'v.nx', 'v.ny')})
group by 1
""", "fx_points", "fx_squares", "fx_vertices")


@query("parcel_line_counts", "J3 A4 J2 G9", _PARCEL_LINES_SQL)
def parcel_line_counts(spark, sf_dir):
    """Lines across every parcel: region-wide lines against small polygons,
    each with a bounded number of cells of its own level."""
    q = X.fx_squares(spark, sf_dir)
    parcels = q.select(F.col("id").alias("parcel_id"), G.rect("x0", "y0", "x1", "y1").alias("geom"))
    met = S.intersects_join(parcels, X.lines_layer(spark, sf_dir), ["parcel_id"], ["feature_id"], count="n_lines")
    return met.groupBy("parcel_id").agg(F.sum("n_lines").alias("n_lines"))


# ---------------------------------------------------------------------------
# oracle helpers for literal polygons (edges unrolled into plain SQL)
# ---------------------------------------------------------------------------

from terrane.config import CENTROID, CITY_BBOX  # noqa: E402
from terrane.functions import style as ST  # noqa: E402
from terrane.operators import filters as FL  # noqa: E402
from terrane.operators import relational as R  # noqa: E402
from terrane.operators import simplify as SM  # noqa: E402
from terrane.operators import tiles as TL  # noqa: E402
from terrane.plans import filter_report as FR  # noqa: E402
from terrane.plans import inspect as IN  # noqa: E402

n_ = G.num
_PTS = "pts as (select id, name, category, val, lon, lat from fx_points where lon is not null and lat is not null)"
_SEGS = """v as (
  select line_id, x, y,
    lead(x) over (partition by line_id order by l_linenumber, l_partkey, l_suppkey) as nx,
    lead(y) over (partition by line_id order by l_linenumber, l_partkey, l_suppkey) as ny
  from fx_vertices
)"""


def _closed(coords):
    cs = list(coords)
    return cs if cs[0] == cs[-1] else cs + [cs[0]]


def _pip_literal(coords, px, py) -> str:
    """Boundary-inclusive point-in-polygon for a literal ring, as plain SQL."""
    cs = _closed(coords)
    on_edge, cross = [], []
    for (ax, ay), (bx, by) in zip(cs[:-1], cs[1:]):
        ax_, ay_, bx_, by_ = n_(ax), n_(ay), n_(bx), n_(by)
        on_edge.append(f"(({bx_} - {ax_}) * ({py} - {ay_}) - ({by_} - {ay_}) * ({px} - {ax_}) = 0 "
                       f"and {px} between {n_(min(ax, bx))} and {n_(max(ax, bx))} "
                       f"and {py} between {n_(min(ay, by))} and {n_(max(ay, by))})")
        cross.append(f"(case when (({ay_} > {py}) <> ({by_} > {py})) and "
                     f"((({px}) - {ax_}) * ({by_} - {ay_}) - ({bx_} - {ax_}) * (({py}) - {ay_})) "
                     f"* sign({by_} - {ay_}) < 0 then 1 else 0 end)")
    return f"(({' or '.join(on_edge)}) or (({' + '.join(cross)}) % 2 = 1))"


def _seg_hits_literal(coords, ax, ay, bx, by) -> str:
    cs = _closed(coords)
    return "(" + " or ".join(G.segments_intersect_sql(ax, ay, bx, by, n_(p[0]), n_(p[1]), n_(q[0]), n_(q[1]))
                             for p, q in zip(cs[:-1], cs[1:])) + ")"


# Literal drawn shapes: A a rectangle, B a concave pentagon with one vertex on
# a tract corner, C a rectangle overlapping A.
SHAPE_A = [(-71.60, 43.15), (-71.45, 43.15), (-71.45, 43.30), (-71.60, 43.30)]
SHAPE_B = [(-71.70, 43.20), (-71.62, 43.17), (-71.56, 43.28), (-71.63, 43.24), (-71.68, 43.30)]
SHAPE_C = [(-71.52, 43.22), (-71.40, 43.22), (-71.40, 43.35), (-71.52, 43.35)]
DRAWN = {"A": SHAPE_A, "B": SHAPE_B, "C": SHAPE_C}


def drawn_shapes(spark):
    """The literal drawing as a (query_id, shape_id, geom) DataFrame."""
    rows = spark.range(1).select(F.lit(1).alias("query_id"))
    out = None
    for sid, cs in DRAWN.items():
        d = rows.select("query_id", F.lit(sid).alias("shape_id"), G.literal_polygon(cs).alias("geom"))
        out = d if out is None else out.unionByName(d)
    return out


def _any_shape_pip(px, py):
    return "(" + " or ".join(_pip_literal(cs, px, py) for cs in DRAWN.values()) + ")"


def _any_shape_seg(ax, ay, bx, by):
    return "(" + " or ".join(_seg_hits_literal(cs, ax, ay, bx, by) for cs in DRAWN.values()) + ")"


@query("draw_counts_literal", "J3 A4 G9 G16 P8", with_fixtures(f"""
, {_PTS}, {_SEGS}
select 1 as query_id, 'points' as layer,
  (select count(*) from pts where {_any_shape_pip('lon', 'lat')}) as n
union all
select 1, 'lines', (select count(distinct line_id) from v where {_any_shape_pip('x', 'y')}
  or (nx is not null and {_any_shape_seg('x', 'y', 'nx', 'ny')}))
""", "fx_points", "fx_vertices"))
def draw_counts_literal(spark, sf_dir):
    """Features of each layer intersecting the union of three drawn shapes
    (rectangle, concave pentagon, overlapping rectangle)."""
    layers = {"points": X.points_layer(spark, sf_dir).select("feature_id", "geom"),
              "lines": X.lines_layer(spark, sf_dir)}
    return M.count_in_shapes(drawn_shapes(spark), layers)


# ---------------------------------------------------------------------------
# F1 / F3 / F5 / S2 / S17 / J2
# ---------------------------------------------------------------------------

_CITY = (f"lon between {n_(CITY_BBOX.xmin)} and {n_(CITY_BBOX.xmax)} "
         f"and lat between {n_(CITY_BBOX.ymin)} and {n_(CITY_BBOX.ymax)}")


@query("bbox_points_city", "F1 F3 F5 S2 S23", with_fixtures(f"""
, {_PTS}
select id as feature_id, name, round(lon, 6) as lon, round(lat, 6) as lat from pts
where {_CITY} and val > 0
""", "fx_points"))
def bbox_points_city(spark, sf_dir):
    """Point layer clipped to the city bbox plus a free-form WHERE."""
    lay = FL.where_sql(S.bbox_filter(X.points_layer(spark, sf_dir), CITY_BBOX), "val > 0")
    return rounded(lay.select("feature_id", "name", "lon", "lat"), 6)


_CITY_RING = CITY_BBOX.ring()[:-1]


@query("bbox_lines_city", "F1 G9", with_fixtures(f"""
, {_SEGS}
select distinct line_id as feature_id from v
where {_pip_literal(_CITY_RING, 'x', 'y')} or (nx is not null and {_seg_hits_literal(_CITY_RING, 'x', 'y', 'nx', 'ny')})
""", "fx_vertices"))
def bbox_lines_city(spark, sf_dir):
    """Line features intersecting the city bbox (envelope prune + exact test)."""
    return S.bbox_filter(X.lines_layer(spark, sf_dir), CITY_BBOX).select("feature_id")


@query("occurrences_city", "S17 S12 G16 F5 W5", with_fixtures(f"""
, {_PTS}
select id as feature_id, round(lon, 6) as lon, round(lat, 6) as lat from pts
where {_pip_literal(_CITY_RING, 'lon', 'lat')}
""", "fx_points"))
def occurrences_city(spark, sf_dir):
    """Occurrences inside the city polygon given as WKT text: envelope filter,
    then the exact test against the literal polygon."""
    pts = S.bbox_filter(X.points_layer(spark, sf_dir), CITY_BBOX)
    hits = (pts.withColumn("area", G.geom_from_wkt(F.lit(CITY_BBOX.wkt())))
            .where(F.expr(G.intersects_polygon_sql("geom", "area"))))
    return rounded(hits.select("feature_id", "lon", "lat"), 6)


@query("districts_city", "J2 F8", with_fixtures(f"""
select geoid from fx_tracts
where xmin <= {n_(CITY_BBOX.xmax)} and xmax >= {n_(CITY_BBOX.xmin)}
  and ymin <= {n_(CITY_BBOX.ymax)} and ymax >= {n_(CITY_BBOX.ymin)}
""", "fx_tracts"))
def districts_city(spark, sf_dir):
    """Tract polygons intersecting the city polygon (spatial semi join)."""
    t = X.tracts_layer(spark, sf_dir)
    city = spark.range(1).select(F.lit(1).alias("query_id"), F.lit("city").alias("shape_id"),
                                 G.rect(CITY_BBOX.xmin, CITY_BBOX.ymin, CITY_BBOX.xmax, CITY_BBOX.ymax).alias("geom"))
    pairs = S.intersects_join(city, t.select(F.col("geoid"), "geom"), ["query_id"], ["geoid"])
    return t.join(pairs.select("geoid").distinct(), "geoid", "left_semi").select("geoid")


# ---------------------------------------------------------------------------
# F2 / S18 radius feeds
# ---------------------------------------------------------------------------


def _hav_sql(lon, lat):
    return G.haversine_sql(n_(CENTROID[0]), n_(CENTROID[1]), lon, lat)


@query("quakes_radius", "S18 F2 F4 S1", with_fixtures(f"""
select event_id, round(magnitude, 6) as magnitude, round({_hav_sql('lon', 'lat')} / 1000, 3) as dist_km
from fx_quakes where magnitude >= 2 and ts >= timestamp '1900-01-01' and {_hav_sql('lon', 'lat')} <= 100000
""", "fx_quakes"))
def quakes_radius(spark, sf_dir):
    """Events within 100 km of the centroid, magnitude >= 2, since 1900."""
    q = X.fx_quakes(spark, sf_dir).where((F.col("magnitude") >= 2) & (F.col("ts") >= F.lit("1900-01-01").cast("timestamp")))
    q = S.radius_filter(q, CENTROID, 100_000, dist_col="d")
    return rounded(q.select("event_id", "magnitude", (F.col("d") / 1000).alias("dist_km")), 6) \
        .withColumn("dist_km", F.round("dist_km", 3))


@query("stations_nearest", "S18 F2 W4 W5", with_fixtures(f"""
, {_PTS}
select id as feature_id, round({_hav_sql('lon', 'lat')}, 3) as dist_m from pts
where {_hav_sql('lon', 'lat')} <= 40233.6e0
order by {_hav_sql('lon', 'lat')}, id limit 200
""", "fx_points"))
def stations_nearest(spark, sf_dir):
    """The 200 nearest stations within 25 miles of the centroid."""
    p = S.radius_filter(X.points_layer(spark, sf_dir), CENTROID, 40233.6, dist_col="d")
    top = p.orderBy("d", "feature_id").limit(200)
    return top.select("feature_id", F.round("d", 3).alias("dist_m"))


# ---------------------------------------------------------------------------
# J4 / P10 nearest feature at clicks
# ---------------------------------------------------------------------------


def _clicks(spark, sf_dir):
    """Clicks: every point shifted ~98 m (usually a hit) and ~325 m east."""
    p = X.points_layer(spark, sf_dir)
    a = p.select((F.col("feature_id") * 2).alias("click_id"), (F.col("lon") + 0.001).alias("x"),
                 (F.col("lat") + 0.0005).alias("y"))
    b = p.select((F.col("feature_id") * 2 + 1).alias("click_id"), (F.col("lon") + 0.004).alias("x"),
                 F.col("lat").alias("y"))
    return a.unionByName(b)


def _clicks_sql():
    return ("clicks as (select id * 2 as click_id, lon + 0.001e0 as x, lat + 0.0005e0 as y from pts "
            "union all select id * 2 + 1, lon + 0.004e0, lat from pts)")


def _nearest_sql():
    ky = f"({n_(G.EARTH_RADIUS_M)} * pi() / 180)"
    kx = f"({ky} * cos(radians(c.y)))"
    seg_deg = G._seg_dist_sql("v.x", "v.y", "coalesce(v.nx, v.x)", "coalesce(v.ny, v.y)", "c.x", "c.y")
    seg_m = G._seg_dist_sql("v.x", "v.y", "coalesce(v.nx, v.x)", "coalesce(v.ny, v.y)", "c.x", "c.y", kx, ky)
    corners = [("t.xmin", "t.ymin"), ("t.xmax", "t.ymin"), ("t.xmax", "t.ymax"), ("t.xmin", "t.ymax")]
    edges = list(zip(corners, corners[1:] + corners[:1]))
    rect_deg = "least(" + ", ".join(G._seg_dist_sql(a[0], a[1], b[0], b[1], "c.x", "c.y") for a, b in edges) + ")"
    rect_m = "least(" + ", ".join(G._seg_dist_sql(a[0], a[1], b[0], b[1], "c.x", "c.y", kx, ky) for a, b in edges) + ")"
    inside = "(c.x between t.xmin and t.xmax and c.y between t.ymin and t.ymax)"
    return f"""
, {_PTS}, {_SEGS}, {_clicks_sql()}
, np as (
  select c.click_id, 0 as layer_order, 'points' as layer, p.id as feature_id,
    sqrt((p.lon - c.x) * (p.lon - c.x) + (p.lat - c.y) * (p.lat - c.y)) as d,
    {G.haversine_sql('c.x', 'c.y', 'p.lon', 'p.lat')} as m
  from clicks c, pts p
  qualify row_number() over (partition by c.click_id order by d, p.id) = 1
), segd as (
  select c.click_id, v.line_id, min({seg_deg}) as d, min({seg_m}) as m_any
  from clicks c, v group by c.click_id, v.line_id
), nl as (
  select click_id, 1 as layer_order, 'lines' as layer, line_id as feature_id, d, m_any as m from segd
  qualify row_number() over (partition by click_id order by d, line_id) = 1
), nt as (
  select c.click_id, 2 as layer_order, 'tracts' as layer, cast(t.geoid as bigint) as feature_id,
    case when {inside} then 0.0e0 else {rect_deg} end as d,
    case when {inside} then 0.0e0 else {rect_m} end as m
  from clicks c, fx_tracts t
  qualify row_number() over (partition by c.click_id order by d, cast(t.geoid as bigint)) = 1
), hits as (
  select * from np where m < 200 union all select * from nl where m < 200 union all select * from nt where m < 200
)
select click_id, layer, feature_id, round(m, 3) as dist_m from hits
qualify row_number() over (partition by click_id order by layer_order) = 1
"""


@query("nearest_clicks", "J4 P10 G10 G11", with_fixtures(_nearest_sql(), "fx_points", "fx_vertices", "fx_tracts"))
def nearest_clicks(spark, sf_dir):
    """For every click: the nearest feature (planar degrees) of the first layer
    (points, lines, tracts) whose nearest is within 200 m."""
    layers = [("points", X.points_layer(spark, sf_dir).select("feature_id", "geom")),
              ("lines", X.lines_layer(spark, sf_dir)),
              ("tracts", X.tracts_layer(spark, sf_dir).select("feature_id", "geom"))]
    r = IN.inspect_at(_clicks(spark, sf_dir), layers, poly_layers={"tracts"})
    return r.select("click_id", "layer", "feature_id", F.round("dist_m", 3).alias("dist_m"))


# ---------------------------------------------------------------------------
# G3-G7, G12, G14 measures and text forms
# ---------------------------------------------------------------------------


def _wkt_num(c):
    return f"cast(round({c}, 6) as varchar)"


@query("tract_shapes", "G3 G4 G5 G7 G14", with_fixtures(f"""
, corners as (
  select geoid, xmin, ymin, xmax, ymax, {_corner_utm_cols()} from fx_tracts
)
select geoid,
  round(abs(((e1 - e0) * (n2 - n0) - (e2 - e0) * (n1 - n0)) + ((e2 - e0) * (n3 - n0) - (e3 - e0) * (n2 - n0))) / 2, 3) as area_m2,
  round(sqrt(power(e1 - e0, 2) + power(n1 - n0, 2)) + sqrt(power(e2 - e1, 2) + power(n2 - n1, 2))
      + sqrt(power(e3 - e2, 2) + power(n3 - n2, 2)) + sqrt(power(e0 - e3, 2) + power(n0 - n3, 2)), 3) as perim_m,
  round((xmin + xmax) / 2, 6) as cx, round((ymin + ymax) / 2, 6) as cy,
  'POLYGON ((' || {_wkt_num('xmin')} || ' ' || {_wkt_num('ymin')} || ', ' || {_wkt_num('xmax')} || ' ' || {_wkt_num('ymin')}
    || ', ' || {_wkt_num('xmax')} || ' ' || {_wkt_num('ymax')} || ', ' || {_wkt_num('xmin')} || ' ' || {_wkt_num('ymax')}
    || ', ' || {_wkt_num('xmin')} || ' ' || {_wkt_num('ymin')} || '))' as wkt
from corners
""", "fx_tracts"))
def tract_shapes(spark, sf_dir):
    """Per tract: UTM area and perimeter, planar centroid, WKT."""
    t = X.tracts_layer(spark, sf_dir)
    u = t.select("geoid", "geom", G.to_utm("geom").alias("ugeom"))
    cx, cy = G.centroid_sql("geom")
    out = u.select("geoid", F.round(G.area("ugeom"), 3).alias("area_m2"),
                   F.round(G.length("ugeom"), 3).alias("perim_m"),
                   F.round(F.expr(cx), 6).alias("cx"), F.round(F.expr(cy), 6).alias("cy"),
                   G.to_wkt("geom").alias("wkt"))
    return out


@query("line_shapes", "G5 G7 G12 G3", with_fixtures(f"""
, {_SEGS}
, s as (
  select line_id, x, y, nx, ny,
    case when nx is null then 0.0e0 else sqrt(power(nx - x, 2) + power(ny - y, 2)) end as dl,
    case when nx is null then 0.0e0 else {_seg_len_utm('x', 'y', 'nx', 'ny')} end as dm
  from v
), a as (
  select line_id, count(*) as n_vertices, sum(dm) as length_m, sum(dl) as len_deg,
    sum(dl * (x + nx) / 2) as mx, sum(dl * (y + ny) / 2) as my, avg(x) as ax, avg(y) as ay
  from s group by line_id
)
select line_id as feature_id, n_vertices, round(length_m, 3) as length_m,
  round(case when len_deg > 0 then mx / len_deg else ax end, 6) as cx,
  round(case when len_deg > 0 then my / len_deg else ay end, 6) as cy,
  'line' as layer_kind
from a
""", "fx_vertices"))
def line_shapes(spark, sf_dir):
    """Per line: vertex count, UTM length, length-weighted centroid; the
    layer's geometry kind."""
    lines = X.lines_layer(spark, sf_dir)
    # The layer's kind from its distinct kinds (at most three values)
    kinds = [r[0] for r in lines.select("geom.kind").distinct().limit(4).collect()]
    layer_kind = kinds[0] if len(kinds) == 1 else "point"
    cx, cy = G.centroid_sql("geom")
    out = lines.withColumn("ugeom", G.to_utm("geom")).select(
        "feature_id", SM.vertex_count().alias("n_vertices"),
        F.round(G.length("ugeom"), 3).alias("length_m"),
        F.round(F.expr(cx), 6).alias("cx"), F.round(F.expr(cy), 6).alias("cy"),
        F.lit(layer_kind).alias("layer_kind"))
    return out


# ---------------------------------------------------------------------------
# K11 tiles, G8 simplify
# ---------------------------------------------------------------------------

_TILE_Z = (10, 13)
_TILE_CAP = 5


def _tile_sql():
    latc = "greatest(least(lat, 85.0511287798e0), -85.0511287798e0)"
    return f"""
, {_PTS}
, b as (select id, lon, lat, z from pts, (select unnest(range({_TILE_Z[0]}, {_TILE_Z[1] + 1})) as z))
, k as (
  select id, z,
    cast(least(greatest(floor((lon + 180.0e0) / 360.0e0 * pow(2.0e0, z)), 0.0e0), pow(2.0e0, z) - 1) as bigint) as tx,
    cast(least(greatest(floor((1.0e0 - ln(tan(radians({latc})) + 1.0e0 / cos(radians({latc}))) / pi()) / 2.0e0 * pow(2.0e0, z)), 0.0e0), pow(2.0e0, z) - 1) as bigint) as ty
  from b
), r as (select *, row_number() over (partition by z, tx, ty order by id) as rn from k)
select z, tx, ty, count(*) as n, count(*) filter (where rn <= {_TILE_CAP}) as n_kept from r group by z, tx, ty
"""


@query("tile_thinning", "K11", with_fixtures(_tile_sql(), "fx_points"))
def tile_thinning(spark, sf_dir):
    """Per-tile feature counts at zooms 10-13 and counts after thinning to at
    most 5 features per tile."""
    p = X.points_layer(spark, sf_dir)
    _, counts = TL.thin_tiles(p, _TILE_Z[0], _TILE_Z[1], _TILE_CAP)
    return counts.select(F.col("z").cast("int").alias("z"), "tx", "ty", "n", "n_kept")


_LINE_Z = (8, 11)
_LINE_CAP = 20


def _line_tile_sql():
    """Every tile of each segment's envelope, clipped by the four borders."""
    merc = lambda y: f"(1.0e0 - ln(tan(radians({y})) + 1.0e0 / cos(radians({y}))) / pi()) / 2.0e0"
    t_in = lambda a, b, t: (f"case when {a} = {b} then (case when floor({a}) = {t} then 0.0e0 else 2.0e0 end) "  # noqa: E731
                            f"else least(({t} - {a}) / ({b} - {a}), ({t} + 1 - {a}) / ({b} - {a})) end")
    t_out = lambda a, b, t: (f"case when {a} = {b} then 1.0e0 "  # noqa: E731
                             f"else greatest(({t} - {a}) / ({b} - {a}), ({t} + 1 - {a}) / ({b} - {a})) end")
    return f"""
, {_SEGS}
, one as (select line_id from fx_vertices group by line_id having count(*) = 1)
, s as (
  select line_id, (x + 180.0e0) / 360.0e0 as ux, {merc('y')} as uy, (nx + 180.0e0) / 360.0e0 as vx, {merc('ny')} as vy
  from v where nx is not null
  union all
  select line_id, (x + 180.0e0) / 360.0e0, {merc('y')}, (x + 180.0e0) / 360.0e0, {merc('y')}
  from fx_vertices where line_id in (select line_id from one)
), zs as (
  select line_id, z, ux * pow(2.0e0, z) as ax, uy * pow(2.0e0, z) as ay, vx * pow(2.0e0, z) as bx, vy * pow(2.0e0, z) as "by"
  from s, (select unnest(range({_LINE_Z[0]}, {_LINE_Z[1] + 1})) as z)
), cx as (
  select *, unnest(range(cast(floor(least(ax, bx)) as bigint), cast(floor(greatest(ax, bx)) as bigint) + 1)) as tx from zs
), cy as (
  select *, unnest(range(cast(floor(least(ay, "by")) as bigint), cast(floor(greatest(ay, "by")) as bigint) + 1)) as ty from cx
), t as (
  select *, greatest(0.0e0, {t_in('ax', 'bx', 'tx')}, {t_in('ay', '"by"', 'ty')}) as t0,
    least(1.0e0, {t_out('ax', 'bx', 'tx')}, {t_out('ay', '"by"', 'ty')}) as t1
  from cy
), l as (
  select z, tx, ty, line_id,
    round(sum((t1 - t0) * sqrt(power(bx - ax, 2) + power("by" - ay, 2))), 6) as length
  from t where t1 - t0 > 1e-9 group by z, tx, ty, line_id
), r as (select *, row_number() over (partition by z, tx, ty order by length desc, line_id) as rn from l)
select cast(z as integer) as z, tx, ty, count(*) as n, round(sum(length), 3) as length,
  count(*) filter (where rn <= {_LINE_CAP}) as n_kept,
  round(sum(length) filter (where rn <= {_LINE_CAP}), 3) as length_kept
from r group by z, tx, ty
"""


@query("line_tiles", "K11", with_fixtures(_line_tile_sql(), "fx_vertices"))
def line_tiles(spark, sf_dir):
    """Per tile at zooms 8-11: the number and clipped length (in tiles) of the
    lines that pass through it, all of them and the 20 with the longest part."""
    _, counts = TL.thin_line_tiles(X.lines_layer(spark, sf_dir), *_LINE_Z, _LINE_CAP)
    return counts.select(F.col("z").cast("int").alias("z"), "tx", "ty", "n", F.round("length", 3).alias("length"),
                         "n_kept", F.round("length_kept", 3).alias("length_kept"))


@query("simplify_lines", "G8")
def simplify_lines(spark, sf_dir):
    """Vertex counts of every line before and after simplification (tolerance
    0.00004 deg)."""
    lines = X.lines_layer(spark, sf_dir)
    before = lines.select("feature_id", SM.vertex_count().alias("n_before"))
    after = SM.simplify(lines).select("feature_id", SM.vertex_count().alias("n_after"))
    return before.join(after, "feature_id")


# ---------------------------------------------------------------------------
# P9 filter builder
# ---------------------------------------------------------------------------


@query("filter_numeric", "P9 F6", with_fixtures(f"""
, {_PTS}
select id as feature_id, name, val from pts where val >= 5000
""", "fx_points"))
def filter_numeric(spark, sf_dir):
    """Builder: val >= ' 5000 ' (trimmed, numeric-looking -> number)."""
    rows, _, _ = FR.filter_report(X.points_layer(spark, sf_dir), "points", "val", ">=", " 5000 ")
    return rows.select("feature_id", "name", "val")


@query("filter_like", "P9 F6 F7", with_fixtures(f"""
, {_PTS}
select id as feature_id, name, category from pts where name like '%er#00000_1%' or category ilike '%uild%'
""", "fx_points"))
def filter_like(spark, sf_dir):
    """Builder: LIKE with its own '_' wildcard, OR an ILIKE condition."""
    lay = X.points_layer(spark, sf_dir)
    cond = FL.build_filter("name", "LIKE", "er#00000_1") | FL.build_filter("category", "ILIKE", "UILD")
    return lay.where(cond).select("feature_id", "name", "category")


@query("filter_nulls", "P9 F6 F4", with_fixtures("""
select id, name from fx_points where lon is null and category = 'MACHINERY'
""", "fx_points"))
def filter_nulls(spark, sf_dir):
    """Builder: IS NULL (value ignored) with a string equality."""
    p = X.fx_points(spark, sf_dir)
    return p.where(FL.build_filter("lon", "IS NULL", "ignored") & FL.build_filter("category", "=", "MACHINERY")) \
        .select("id", "name")


# ---------------------------------------------------------------------------
# A7 / G6 union perimeter of shapes that overlap in awkward ways
# ---------------------------------------------------------------------------


@query("union_perimeter", "A7 G6", """
select c_custkey as query_id, round(3.0 * (10 + c_custkey % 50) + 4.0 * (5 + c_custkey % 17), 3) as perimeter
from customer
""")
def union_perimeter(spark, sf_dir):
    """Perimeter of the union of three rectangles per customer, sized and
    turned by the customer's key: one w x h; one of half the height wound the
    other way, its base half on the first one's base; one on top that meets the
    first one's upper side between its corners. The turned edges coincide only
    nearly. Closed form: 3 w + 4 h."""
    c = S.spread(X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id")), "query_id")
    w, h = (F.col("query_id") % 50 + 10).cast("double"), (F.col("query_id") % 17 + 5).cast("double")
    turn, zero = (F.col("query_id") % 12) * 0.1, F.lit(0.0)

    def ring(*corners):
        return F.array(F.array(*[F.struct((x * F.cos(turn) - y * F.sin(turn)).alias("x"),
                                          (x * F.sin(turn) + y * F.cos(turn)).alias("y")) for x, y in corners]))

    shapes = {"a": ring((zero, zero), (w, zero), (w, h), (zero, h)),
              "b": ring((w / 2, zero), (w / 2, h / 2), (w * 1.5, h / 2), (w * 1.5, zero)),
              "c": ring((w / 4, h), (w * 0.75, h), (w * 0.75, h * 2), (w / 4, h * 2))}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("shape_id"), r.alias("rings")) for k, r in shapes.items()]))
    df = c.select("query_id", each.alias("s")).select("query_id", "s.shape_id", G.polygon(F.col("s.rings")).alias("geom"))
    return S.union_boundary_length(df).select("query_id", F.round("perimeter", 3).alias("perimeter"))


# ---------------------------------------------------------------------------
# F6 / F8 / J7 keys and values of unlike form
# ---------------------------------------------------------------------------


@query("filter_text_number", "F6 P9", """
select o_orderkey, o_orderpriority from orders where o_orderpriority < '3'
""")
def filter_text_number(spark, sf_dir):
    """Builder: a value that looks like a number against a text column compares
    as text."""
    o = X.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    rows, _, _ = FR.filter_report(o, "orders", "o_orderpriority", "<", " 3 ")
    return rows


@query("long_keys", "F8", """
select c_custkey from customer c
where exists (select 1 from orders o where o.o_custkey = c.c_custkey)
""")
def long_keys(spark, sf_dir):
    """Key filter with padding to three places: longer keys stay whole."""
    c = X.table(spark, sf_dir, "customer").select("c_custkey")
    return FL.semi_filter(c, X.table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", width=3)


@query("attach_first", "J7 A2", """
select c_custkey, o.o_orderkey, o.o_orderpriority
from customer left join (
  select o_custkey, min(o_orderkey) as o_orderkey, arg_min(o_orderpriority, o_orderkey) as o_orderpriority
  from orders group by o_custkey) o on o.o_custkey = c_custkey
""")
def attach_first(spark, sf_dir):
    """Each customer with the first of its orders (by order key), without an
    aggregate."""
    c = X.table(spark, sf_dir, "customer").select("c_custkey")
    o = X.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return R.attach(c, o, "c_custkey", "o_custkey", width=5, order=["o_orderkey"])


@query("legend_ticks", "X14 X8 X13", """
with t(tick, lo, hi, label) as (values (1, 30000.0, 50000.0, '30k'), (2, 50000.0, 70000.0, '50k'),
  (3, 70000.0, 90000.0, '70k'), (4, 90000.0, 120000.0, '90k'), (5, 120000.0, 1e300, '120k'))
select tick, round((tick - 1) * 25.0, 1) as percent, label, count(o_orderkey) as n
from t left join orders on o_totalprice >= lo and o_totalprice < hi
group by tick, label
""")
def legend_ticks(spark, sf_dir):
    """Legend ticks as rows: place, label and the number of orders in the class
    that starts at each break of the income overlay."""
    o = X.table(spark, sf_dir, "orders")
    return ST.legend_tick_rows(o, "o_totalprice", ST.CHOROPLETHS["acs_income"])
