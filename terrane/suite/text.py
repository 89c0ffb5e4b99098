"""Registered scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import text as TX
from terrane.plans import inspect as IN
from terrane.registry import query, rounded
from terrane.sources import fixtures as X
from terrane.sources.fixtures import with_fixtures

_SLUG = "regexp_replace(lower(regexp_replace({0}, '[^A-Za-z0-9]+', '_', 'g')), '^_|_$', '', 'g')"


@query("slug_names", "X1 F19", f"""
select p_partkey, {_SLUG.format('p_name')} as name_slug, {_SLUG.format('p_brand')} as brand_slug,
  {_SLUG.format("concat(' ', p_type, ': ', p_name, ' (', p_brand, ')')")} as label_slug
from part where length({_SLUG.format('p_name')}) > 0
""")
def slug_names(spark, sf_dir):
    """Table-name slugs of part names / brands / composed labels; empty slugs dropped."""
    p = X.table(spark, sf_dir, "part")
    out = p.select("p_partkey", TX.slug("p_name").alias("name_slug"), TX.slug("p_brand").alias("brand_slug"),
                   TX.slug(F.concat(F.lit(" "), "p_type", F.lit(": "), "p_name", F.lit(" ("), "p_brand",
                                    F.lit(")"))).alias("label_slug"))
    return out.where(F.length("name_slug") > 0)


def _reserved_decode(expr: str) -> str:
    for ch, code in TX.RESERVED.items():
        lit = ch.replace("'", "''")
        expr = f"replace({expr}, '{code}', '{lit}')"
    return expr


_URL_T = "replace(text, ' ', '_')"
_WIKI_SQL = f"""
select conv_id, turn,
  'https://en.wikipedia.org/wiki/' || (case when regexp_matches({_URL_T}, '%[0-9A-Fa-f]{{2}}') then {_URL_T}
    else {_reserved_decode(f"url_encode({_URL_T})")} end) as url,
  'https://en.wikipedia.org/?curid=' || cast(conv_id as varchar) as id_url
from conversations where role = 'user'
"""


@query("wiki_urls", "X3 X4", _WIKI_SQL)
def wiki_urls(spark, sf_dir):
    """Article URLs for whole user-turn texts (spaces -> '_', percent-encoded
    keeping reserved characters) and id URLs."""
    c = X.table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return c.select("conv_id", "turn", TX.wiki_url(F.col("text")).alias("url"),
                    TX.curid_url(F.col("conv_id")).alias("id_url"))


@query("text_cleaning", "X9 X12 X7 F18", """
with e as (
  select event_id, event_type, props, json_extract_string(props, '$.k') as k_text from events
)
select event_id, upper(event_type) as kind, length(props) as props_len,
  try_cast(k_text as double) as k,
  coalesce(try_cast(k_text as double), -1.0e0) as k_or_default,
  case when trim(props) = '' or trim(props) = 'NA' or length(trim(props)) > 10 then null else trim(props) end as short_props,
  left(props, 120) as popup_value,
  coalesce(nullif(event_type, ''), 'unknown') as event_label
from e
""")
def text_cleaning(spark, sf_dir):
    """Trim / case / length, safe numeric casts with defaults, value cleaning."""
    e = X.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    out = e.select("event_id", F.upper("event_type").alias("kind"), F.length("props").alias("props_len"),
                   TX.safe_double(k).alias("k"),
                   TX.coalesce_na(TX.safe_double(k), F.lit(-1.0)).alias("k_or_default"),
                   TX.clean_value("props", 10).alias("short_props"),
                   TX.shortened("props").alias("popup_value"),
                   TX.coalesce_empty("event_type", F.lit("unknown")).alias("event_label"))
    return rounded(out, 6)


_LINK_SQL = with_fixtures("""
, l as (
  select id, lat, lon, 10 + (id % 9) * 0.5e0 as zoom,
    '?' || concat_ws('&', 'c=' || printf('%.5f,%.5f', lat, lon),
                     'z=' || regexp_replace(cast(round(10 + (id % 9) * 0.5e0, 1) as varchar), '\\.0$', ''),
                     'l=' || lower(category) || '.points|apis.' || lower(category)) as link
  from fx_points where lon is not null
)
select id, link, cast(split_part(split_part(split_part(link, 'c=', 2), '&', 1), ',', 1) as double) as lat2,
  cast(split_part(split_part(split_part(link, 'c=', 2), '&', 1), ',', 2) as double) as lon2,
  cast(split_part(split_part(link, 'z=', 2), '&', 1) as double) as zoom2
from l
""", "fx_points")


@query("permalinks", "X10 X6", _LINK_SQL)
def permalinks(spark, sf_dir):
    """Encode a share link per point (centre, zoom, layer ids) and decode it."""
    p = X.fx_points(spark, sf_dir).where(F.col("lon").isNotNull())
    zoom = F.lit(10) + F.pmod("id", F.lit(9)) * F.lit(0.5)
    ids = F.array(F.concat(F.lower("category"), F.lit(".points")), F.concat(F.lit("apis."), F.lower("category")))
    link = TX.permalink(F.col("lat"), F.col("lon"), zoom, ids)
    out = p.select("id", link.alias("link"))
    lat, lon, z = TX.permalink_center(F.col("link"))
    return rounded(out.select("id", "link", lat.alias("lat2"), lon.alias("lon2"), z.alias("zoom2")), 6)


_CARD_FIELDS = ["category", "val", "lon", "lat"]


def _card_sql_value(c: str) -> str:
    return f"trim(cast({c} as varchar))"


def _card_sql() -> str:
    vals = ", ".join(
        f"case when {_card_sql_value(c)} is null or {_card_sql_value(c)} = '' or {_card_sql_value(c)} = 'NA' "
        f"or length({_card_sql_value(c)}) > 80 then null else "
        f"'{c[0].upper() + c[1:]}: ' || {_card_sql_value(c)} end" for c in _CARD_FIELDS)
    return with_fixtures(f"""
, p as (select id, name, category, val, lon, lat from fx_points where lon is not null and lat is not null)
select id as feature_id,
  case when name is not null and trim(name) <> '' then name else 'Points' end as title,
  'APIs & sensors' as category_label, '#d97706' as category_color,
  array_to_string(list_slice(list_filter([{vals}], lambda v: v is not null), 1, 6), ' | ') as fields
from p
""", "fx_points")


@query("feature_cards", "X16 F13 F18 X2 X18", _card_sql())
def feature_cards(spark, sf_dir):
    """Feature cards of every point: title column, category, first six cleaned
    attribute fields."""
    layer = X.points_layer(spark, sf_dir)
    cards = IN.feature_cards(layer, "apis", "points")
    return cards.select("feature_id", "title", "category_label", "category_color",
                        F.array_join(F.transform("fields", lambda f: F.concat(f["label"], F.lit(": "), f["value"])),
                                     " | ").alias("fields"))


@query("attribute_list", "X17 G15", with_fixtures("""
, p as (select id, name, category, val, lon, lat from fx_points where lon is not null and lat is not null)
select * from (
  select id as feature_id, 'Name' as key, trim(name) as value from p
  union all select id, 'Category', trim(category) from p
  union all select id, 'Val', trim(cast(val as varchar)) from p
  union all select id, 'Lon', trim(cast(lon as varchar)) from p
  union all select id, 'Lat', trim(cast(lat as varchar)) from p
) where value is not null and value <> '' and value <> 'NA'
""", "fx_points"))
def attribute_list(spark, sf_dir):
    """Inspector attribute rows (key, value) of every feature, nulls removed."""
    layer = X.points_layer(spark, sf_dir)
    return IN.attribute_rows(layer)
