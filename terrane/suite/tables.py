"""Registered attribute / catalog queries (P14, K3, F9, A5, A8, A9, J7, J8,
S14, P11, X13-X15, S25, W3, W6)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from terrane.functions import geom as G
from terrane.functions import style as ST
from terrane.functions import text as TX
from terrane.operators import filters as FL
from terrane.operators import relational as R
from terrane.registry import query, rounded
from terrane.sources import fixtures as X
from terrane.sources.fixtures import with_fixtures
from terrane.store import catalog as C

# ---------------------------------------------------------------------------
# P14 facility roll-up
# ---------------------------------------------------------------------------


def _facility_records(spark, sf_dir):
    li = X.table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("registry_id"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("string"))
        .otherwise(F.concat("l_returnflag", "l_linestatus")).alias("pgm_sys_acrnm"),
        F.concat(F.lit("Facility "), F.col("l_partkey").cast("string")).alias("primary_name"),
        F.lpad(F.col("l_suppkey").cast("string"), 5, "0").alias("postal_code"),
        "l_linenumber", "l_partkey", "l_suppkey")


@query("facility_rollup", "P14 A1 A2 J1 F17", """
with r as (
  select l_orderkey as registry_id,
    case when l_linenumber = 7 then null else concat(l_returnflag, l_linestatus) end as pgm,
    concat('Facility ', cast(l_partkey as varchar)) as primary_name,
    lpad(cast(l_suppkey as varchar), 5, '0') as postal_code, l_linenumber, l_partkey, l_suppkey
  from lineitem
), f as (
  select registry_id, primary_name, postal_code from r
  qualify row_number() over (partition by registry_id order by l_linenumber, l_partkey, l_suppkey) = 1
), p as (
  select registry_id, string_agg(distinct pgm, ';' order by pgm) as pgm_sys_acrnm
  from r where pgm is not null group by registry_id
)
select f.registry_id, f.primary_name, f.postal_code, p.pgm_sys_acrnm
from f left join p on f.registry_id = p.registry_id
""")
def facility_rollup(spark, sf_dir):
    """One row per facility: first record's metadata + sorted distinct programs."""
    recs = _facility_records(spark, sf_dir)
    return R.facility_rollup(recs, order=["l_linenumber", "l_partkey", "l_suppkey"],
                             meta=("primary_name", "city_name", "postal_code"))


# ---------------------------------------------------------------------------
# catalog: K3 upsert, F9 listing, A5/A9 summaries, J8 diff, F11 search
# ---------------------------------------------------------------------------

OLD_LOAD = dt.datetime(2026, 1, 1, 0, 0, 0)
NEW_LOAD = dt.datetime(2026, 6, 8, 12, 0, 0)


def _catalogs(spark, sf_dir):
    """Stand-in catalogs: the old one lists a layer per nation (customer
    counts); a new load reports supplier counts per nation and a summary table
    per region."""
    n = X.table(spark, sf_dir, "nation")
    r = X.table(spark, sf_dir, "region")
    cust = X.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("cnt"))
    supp = X.table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("cnt"))
    nr = n.join(r, n.n_regionkey == r.r_regionkey)
    old = (nr.join(cust, nr.n_nationkey == cust.c_nationkey, "left").select(
        F.lower("r_name").alias("schema_name"), F.lower("n_name").alias("table_name"),
        F.lit("map+db").alias("target"), F.lit("old").alias("source"), F.lit("bbox").alias("scope"),
        F.coalesce("cnt", F.lit(0)).cast("long").alias("n_features"),
        (F.pmod("n_nationkey", F.lit(2)) == 0).alias("validated"),
        F.when(F.pmod("n_nationkey", F.lit(2)) == 0, F.concat(F.lit("checked "), F.col("n_name"))).alias("notes"),
        F.lit(OLD_LOAD).alias("loaded_at")))
    new_layers = nr.join(supp, nr.n_nationkey == supp.s_nationkey).select(
        F.lower("r_name").alias("schema_name"), F.lower("n_name").alias("table_name"),
        F.when(F.col("cnt") > 3, "map+db").otherwise("db").alias("target"),
        F.lit("new").alias("source"), F.lit("region").alias("scope"), F.col("cnt").cast("long").alias("n_features"))
    per_region = (nr.join(supp, nr.n_nationkey == supp.s_nationkey).groupBy("r_name")
                  .agg(F.sum("cnt").alias("cnt")).select(
        F.lit("summary").alias("schema_name"), F.lower("r_name").alias("table_name"),
        F.lit("db").alias("target"), F.lit("new").alias("source"), F.lit("region").alias("scope"),
        F.col("cnt").cast("long").alias("n_features")))
    return old, new_layers.unionByName(per_region)


_CATALOG_CTE = """
with nr as (select * from nation n join region r on n.n_regionkey = r.r_regionkey),
cust as (select c_nationkey, count(*) as cnt from customer group by 1),
supp as (select s_nationkey, count(*) as cnt from supplier group by 1),
old as (
  select lower(r_name) as schema_name, lower(n_name) as table_name, 'map+db' as target, 'old' as source,
    'bbox' as scope, cast(coalesce(cnt, 0) as bigint) as n_features, n_nationkey % 2 = 0 as validated,
    case when n_nationkey % 2 = 0 then concat('checked ', n_name) end as notes,
    timestamp '2026-01-01 00:00:00' as loaded_at
  from nr left join cust on nr.n_nationkey = cust.c_nationkey
), new as (
  select lower(r_name) as schema_name, lower(n_name) as table_name,
    case when cnt > 3 then 'map+db' else 'db' end as target, 'new' as source, 'region' as scope,
    cast(cnt as bigint) as n_features
  from nr join supp on nr.n_nationkey = supp.s_nationkey
  union all
  select 'summary', lower(r_name), 'db', 'new', 'region', cast(sum(cnt) as bigint)
  from nr join supp on nr.n_nationkey = supp.s_nationkey group by r_name
), upserted as (
  select coalesce(n.schema_name, o.schema_name) as schema_name, coalesce(n.table_name, o.table_name) as table_name,
    coalesce(n.target, o.target) as target, coalesce(n.source, o.source) as source,
    coalesce(n.scope, o.scope) as scope, coalesce(n.n_features, o.n_features) as n_features,
    coalesce(o.validated, false) as validated, o.notes as notes,
    case when n.schema_name is not null then timestamp '2026-06-08 12:00:00' else o.loaded_at end as loaded_at
  from old o full outer join new n on o.schema_name = n.schema_name and o.table_name = n.table_name
)
"""


def _upserted(spark, sf_dir):
    old, new = _catalogs(spark, sf_dir)
    return C.upsert(old, new, loaded_at=NEW_LOAD)


@query("catalog_upsert", "K3 K5 A3", _CATALOG_CTE + """
select schema_name, table_name, target, source, scope, n_features, validated, notes,
  strftime(loaded_at, '%Y-%m-%d %H:%M:%S') as loaded_at from upserted
""")
def catalog_upsert(spark, sf_dir):
    """Keyed upsert of a new load into the catalog (validated/notes kept)."""
    up = _upserted(spark, sf_dir)
    return up.withColumn("loaded_at", F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss"))


@query("catalog_listing", "F9 W3", _CATALOG_CTE + """
select schema_name, table_name, n_features from upserted
where target = 'map+db' and n_features > 0 and not (schema_name = 'africa' and table_name = 'nation_0')
order by schema_name, n_features desc
""")
def catalog_listing(spark, sf_dir):
    """Map layers with features, one excluded, ordered by schema, size desc."""
    return FL.catalog_listing(_upserted(spark, sf_dir), exclude=(("africa", "nation_0"),))


@query("catalog_summary", "A5 A9 X8 W6 X18", _CATALOG_CTE + """
, g as (
  select schema_name, count(*) as n_layers, cast(sum(n_features) as bigint) as n_features
  from upserted where target = 'map+db' group by schema_name
)
select schema_name, n_layers, n_features, format('{:,}', n_features) as n_features_text,
  coalesce(array_position(['city','schools','business','osm','external','apis','knowledge','web'], schema_name), 9) as category_rank,
  schema_name as category_label,
  (select count(distinct schema_name) from upserted where target = 'map+db') as n_groups
from g
""")
def catalog_summary(spark, sf_dir):
    """Per-group layer and feature counts with display helpers."""
    up = _upserted(spark, sf_dir).where(F.col("target") == "map+db")
    return C.summary(up)


@query("catalog_totals", "A9", _CATALOG_CTE + """
select target, count(*) as n_layers, cast(sum(n_features) as bigint) as n_features
from upserted group by target
""")
def catalog_totals(spark, sf_dir):
    """Layers and features by target tier."""
    return C.totals(_upserted(spark, sf_dir))


@query("catalog_diff", "J8 U5 X6", _CATALOG_CTE + """
, b as (select distinct concat(schema_name, '.', table_name) as layer_id from old where n_features > 0 and target = 'map+db'),
a as (select distinct concat(schema_name, '.', table_name) as layer_id from upserted where n_features > 0 and target = 'map+db')
select layer_id, 'added' as change, split_part(layer_id, '.', 1) as schema_name, split_part(layer_id, '.', 2) as table_name
from (select layer_id from a except select layer_id from b)
union all
select layer_id, 'removed', split_part(layer_id, '.', 1), split_part(layer_id, '.', 2)
from (select layer_id from b except select layer_id from a)
""")
def catalog_diff(spark, sf_dir):
    """Map layers added and removed between the old and the upserted catalog."""
    old, _ = _catalogs(spark, sf_dir)
    up = _upserted(spark, sf_dir)

    def ids(df):
        return (df.where((F.col("n_features") > 0) & (F.col("target") == "map+db"))
                .select(TX.join_id(F.col("schema_name"), F.col("table_name")).alias("layer_id")))
    d = R.layer_diff(ids(old), ids(up), "layer_id")
    return d.select("layer_id", "change", TX.split_id(F.col("layer_id"), 1).alias("schema_name"),
                    TX.split_id(F.col("layer_id"), 2).alias("table_name"))


@query("layer_search", "F11 X2 X9", _CATALOG_CTE + """
select schema_name, table_name,
  upper(substr(replace(table_name, '_', ' '), 1, 1)) || substr(replace(table_name, '_', ' '), 2) as label,
  length(table_name) as name_len
from upserted
where strpos(lower(table_name), 'ion_1') > 0 or strpos(lower(schema_name), 'ica') > 0
""")
def layer_search(spark, sf_dir):
    """Case-insensitive literal search on layer and group names, with labels."""
    up = _upserted(spark, sf_dir)
    q1 = FL.name_search("ION_1", "table_name")
    q2 = FL.name_search(" ICA ", "schema_name")
    return up.where(q1 | q2).select("schema_name", "table_name",
                                    TX.nice_label(F.col("table_name")).alias("label"),
                                    F.length("table_name").alias("name_len"))


# ---------------------------------------------------------------------------
# S14 / A10 / J5 wide tract measures, P11 thematic layer
# ---------------------------------------------------------------------------

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _wide(spark, sf_dir):
    long = X.fx_measures(spark, sf_dir)
    wide = R.pivot_wide(long, "geoid", "variable", SEGMENTS)
    tracts = X.tracts_layer(spark, sf_dir)
    return R.attach(tracts, wide, "geoid", width=11,
                    agg={f"{v}{s}": F.first(f"{v}{s}") for v in SEGMENTS for s in "EM"})


def _wide_sql_cols():
    return ", ".join(
        f"max(case when variable = '{v}' then estimate end) as {v}E, "
        f"cast(max(case when variable = '{v}' then moe end) as bigint) as {v}M" for v in SEGMENTS)


_WIDE_CTE = with_fixtures(f"""
, wide as (select geoid, {_wide_sql_cols()} from fx_measures group by geoid)
, tw as (select t.geoid, t.name, w.* exclude (geoid) from fx_tracts t left join wide w on t.geoid = w.geoid)
""", "fx_measures", "fx_tracts")


@query("tract_measures_wide", "S14 A10 J5 J7 F8", _WIDE_CTE + f"""
select geoid, name, {", ".join(f"round({v}E, 6) as {v}E, {v}M" for v in SEGMENTS)} from tw
""")
def tract_measures_wide(spark, sf_dir):
    """Long tract measures pivoted to <var>E / <var>M and joined to tracts."""
    w = _wide(spark, sf_dir)
    cols = ["geoid", "name"] + [f"{v}{s}" for v in SEGMENTS for s in "EM"]
    return rounded(w.select(*cols), 6)


_MENTAL = ST.CHOROPLETHS["cdc_mental"]


def _ramp_sql(v: str, stops, na: str) -> str:
    vals = [float(s) for s, _ in stops]
    rgbs = [ST._rgb(c) for _, c in stops]
    n = G.num

    def channel(k):
        expr = n(rgbs[-1][k])
        for i in range(len(vals) - 2, -1, -1):
            lo, hi = vals[i], vals[i + 1]
            a, b = float(rgbs[i][k]), float(rgbs[i + 1][k])
            seg = f"({n(a)} + ({v} - {n(lo)}) / {n(hi - lo)} * {n(b - a)})"
            expr = f"(case when {v} < {n(hi)} then {seg} else {expr} end)"
        expr = f"(case when {v} <= {n(vals[0])} then {n(rgbs[0][k])} else {expr} end)"
        return f"lpad(lower(hex(cast(round({expr}) as bigint))), 2, '0')"
    return (f"(case when {v} is null or isnan({v}) then '{na}' else concat('#', {channel(0)}, {channel(1)}, {channel(2)}) end)")


def _legend_sql(v: str, cfg) -> str:
    b = [float(x) for x in cfg.breaks]
    n = len(b)
    pct = [100.0 * i / (n - 1) for i in range(n)]
    m = G.num
    expr = m(100.0)
    for i in range(n - 2, -1, -1):
        seg = f"({m(pct[i])} + ({v} - {m(b[i])}) / {m(b[i + 1] - b[i])} * {m(pct[i + 1] - pct[i])})"
        expr = f"(case when {v} < {m(b[i + 1])} then {seg} else {expr} end)"
    return f"(case when {v} is null then null when {v} <= {m(b[0])} then {m(0.0)} else {expr} end)"


@query("thematic_tracts", "P11 X13 X14 J5", (_WIDE_CTE + f"""
, v as (select geoid, cast(BUILDINGM as double) as value from tw)
select geoid, value,
  case when value is null then null else
    (case when value >= 10.0e0 then 1 else 0 end) + (case when value >= 15.0e0 then 1 else 0 end)
    + (case when value >= 20.0e0 then 1 else 0 end) + (case when value >= 25.0e0 then 1 else 0 end) end as bin,
  {_ramp_sql('value', ST.choropleth_stops(_MENTAL), _MENTAL.na_color)} as color,
  round({_legend_sql('value', _MENTAL)}, 6) as legend_pct
from v
"""))
def thematic_tracts(spark, sf_dir):
    """Tracts classified on a measure with the 4-break mental-health overlay."""
    w = _wide(spark, sf_dir).select("geoid", F.col("BUILDINGM").cast("double").alias("value"))
    bin_, color = ST.classify("value", _MENTAL)
    return rounded(w.select("geoid", "value", bin_.alias("bin"), color.alias("color"),
                            ST.legend_position("value", _MENTAL).alias("legend_pct")), 6)


@query("building_heights", "X15 F15 F14", (f"""
with b as (
  select p_partkey, cast(p_size as double) as h0, p_type as OCC_CLS, p_name as PROP_ADDR,
    p_retailprice as SQFEET from part
), c as (select *, case when h0 is null or h0 < 2.0e0 then 3.0e0 else h0 end as HEIGHT from b)
select p_partkey, HEIGHT, OCC_CLS, PROP_ADDR, SQFEET,
  {_ramp_sql('HEIGHT', list(ST.HEIGHT_STOPS), ST.HEIGHT_NA)} as color
from c
"""))
def building_heights(spark, sf_dir):
    """Fixed building projection, cleaned heights and the 3-stop height ramp."""
    p = X.table(spark, sf_dir, "part")
    b = p.select("p_partkey", F.col("p_size").cast("double").alias("h0"),
                 F.col("p_type").alias("OCC_CLS"), F.col("p_name").alias("PROP_ADDR"),
                 F.col("p_retailprice").alias("SQFEET"))
    b = b.withColumn("HEIGHT", ST.clean_height("h0"))
    return b.select("p_partkey", "HEIGHT", "OCC_CLS", "PROP_ADDR", "SQFEET",
                    ST.height_color("HEIGHT").alias("color"))


# ---------------------------------------------------------------------------
# S25 / A8 enrollment
# ---------------------------------------------------------------------------


def _enrollment(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    return o.select(
        F.lpad(F.col("o_custkey").cast("string"), 7, "0").alias("leaid"),
        F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(99).alias("grade"),
        F.when(F.col("o_orderstatus") == "F", 99).otherwise(1 + F.pmod("o_orderkey", F.lit(7))).alias("race"),
        F.when(F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2"), 99)
        .otherwise(1 + F.pmod("o_orderkey", F.lit(2))).alias("sex"),
        F.floor(F.col("o_totalprice") / 1000).cast("long").alias("enrollment"))


@query("enrollment_totals", "S25 A8 F4 F8", """
with e as (
  select lpad(cast(o_custkey as varchar), 7, '0') as leaid, year(o_orderdate) as year,
    case when o_orderpriority = '5-LOW' then 1 else 99 end as grade,
    case when o_orderstatus = 'F' then 99 else 1 + o_orderkey % 7 end as race,
    case when o_orderpriority like '1%' or o_orderpriority like '2%' then 99 else 1 + o_orderkey % 2 end as sex,
    cast(floor(o_totalprice / 1000) as bigint) as enrollment
  from orders
), d as (select distinct lpad(cast(c_custkey as varchar), 7, '0') as leaid from customer where c_mktsegment = 'BUILDING')
select leaid, count(*) as n_rows,
  cast(sum(case when race = 99 and sex = 99 then enrollment else 0 end) as bigint) as total
from e where year = 1997 and grade = 99 and leaid in (select leaid from d)
group by leaid
""")
def enrollment_totals(spark, sf_dir):
    """District enrollment rows for one year at grade 99 (all grades), filtered
    to the district list by a semi join, with the race=99 & sex=99 total."""
    e = _enrollment(spark, sf_dir).where((F.col("year") == 1997) & (F.col("grade") == 99))
    districts = X.table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    e = FL.semi_filter(e, districts, "leaid", "c_custkey", width=7)
    total = F.when((F.col("race") == 99) & (F.col("sex") == 99), F.col("enrollment")).otherwise(0)
    return e.groupBy("leaid").agg(F.count("*").alias("n_rows"), F.sum(total).cast("long").alias("total"))
