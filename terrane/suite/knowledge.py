"""Registered knowledge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.config import CENTROID
from terrane.functions import geom as G
from terrane.functions import text as TX
from terrane.operators import filters as FL
from terrane.operators import relational as R
from terrane.operators import tiles as TL
from terrane.registry import query, rounded
from terrane.sources import fixtures as X
from terrane.sources import readers as RD
from terrane.sources.fixtures import with_fixtures
from terrane.suite.text import _reserved_decode

n_ = G.num


def _people(spark, sf_dir):
    """Stand-in category-member documents (user turns of each conversation as
    member titles) and a second people source (assistant turns)."""
    c = X.table(spark, sf_dir, "conversations")
    docs = (c.where(F.col("role") == "user").groupBy("conv_id")
            .agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct(F.col("text").alias("title")))
                                              .alias("categorymembers")).alias("query"))).alias("json")))
    second = c.where(F.col("role") == "assistant").select(F.col("text").alias("name"))
    return docs, second


_URL = "replace(name, ' ', '_')"
_PEOPLE_SQL = f"""
with p as (
  select text as name from conversations where role = 'user' and not starts_with(text, 'List of')
  union
  select text from conversations where role = 'assistant'
)
select name, 'https://en.wikipedia.org/wiki/' || (case when regexp_matches({_URL}, '%[0-9A-Fa-f]{{2}}') then {_URL}
    else {_reserved_decode(f"url_encode({_URL})")} end) as url
from p order by name limit 40
"""


@query("notable_people", "S26 F10 U6 X3 W4", _PEOPLE_SQL)
def notable_people(spark, sf_dir):
    """Category members ('List of' pages excluded) united with a second source
    deduplicated by name, linked, first 40 by name."""
    docs, second = _people(spark, sf_dir)
    titles = RD.category_titles(docs)
    people = titles.unionByName(second).dropDuplicates(["name"])
    return people.select("name", TX.wiki_url(F.col("name")).alias("url")).orderBy("name").limit(40)


@query("people_pins", "W1 P6 G1", f"""
with p as (select conv_id, turn from conversations where role = 'user'),
o as (select conv_id, turn, row_number() over (order by conv_id, turn) as ordinal from p)
select conv_id, turn, ordinal,
  round({n_(CENTROID[0])} + ((ordinal - 1) % 12 - 6) * {n_(0.0009)}, 6) as lon,
  round({n_(CENTROID[1])} + (floor((ordinal - 1) / 12) - 6) * {n_(0.0009)}, 6) as lat
from o
""")
def people_pins(spark, sf_dir):
    """People pinned around the centroid on a deterministic 12-wide grid, in
    input order (global ordinal over (conv_id, turn))."""
    c = X.table(spark, sf_dir, "conversations").where(F.col("role") == "user").select("conv_id", "turn")
    o = R.global_ordinal(c, ["conv_id", "turn"])
    lon, lat = R.jitter_grid(F.col("ordinal"), CENTROID[0], CENTROID[1])
    return rounded(o.select("conv_id", "turn", "ordinal", lon.alias("lon"), lat.alias("lat")), 6)


@query("history_pages", "S27", """
with t as (
  select p.url as title from pages p where p.page_id in (select doc_id from labels)
  union all select 'missing/' || cast(doc_id as varchar) from labels
)
select url as title, coalesce(html, '') as html from pages where url in (select title from t)
""")
def history_pages(spark, sf_dir):
    """Page content for a title list; titles without a page are skipped."""
    pages = X.table(spark, sf_dir, "pages").select(F.col("url").alias("title"), "html", "page_id")
    labels = X.table(spark, sf_dir, "labels")
    have = pages.join(labels.select(F.col("doc_id").alias("page_id")), "page_id", "left_semi").select("title")
    missing = labels.select(F.concat(F.lit("missing/"), F.col("doc_id").cast("string")).alias("title"))
    return RD.page_contents(pages, have.unionByName(missing))


def _facts_inputs(spark, sf_dir):
    t = X.fx_triples(spark, sf_dir)
    preds = t.select("predicate").distinct()
    props = preds.select(F.col("predicate").alias("direct_claim"),
                         F.concat(F.lit("prop/"), F.col("predicate")).alias("prop"))
    src_no = F.regexp_extract("predicate", r"(\d+)$", 1).try_cast("int")
    prop_labels = preds.where(F.pmod(src_no, F.lit(2)) == 0).select(
        F.concat(F.lit("prop/"), F.col("predicate")).alias("id"), F.lit("en").alias("lang"),
        F.concat(F.lit("source "), F.regexp_extract("predicate", r"(\d+)$", 1)).alias("label"))
    vals = t.select("value").distinct()
    val_labels = vals.where(F.col("value").isin("en", "fr")).select(
        F.col("value").alias("id"), F.lit("en").alias("lang"), F.upper("value").alias("label"))
    other = vals.select(F.col("value").alias("id"), F.lit("de").alias("lang"), F.lit("Quelle").alias("label"))
    return t, props, prop_labels.unionByName(val_labels).unionByName(other)


@query("facts_panel", "J6 F12 W5 S28", with_fixtures("""
, props as (select distinct predicate as direct_claim, 'prop/' || predicate as prop from fx_triples),
labels as (
  select distinct 'prop/' || predicate as id, 'en' as lang, 'source ' || regexp_extract(predicate, '(\\d+)$', 1) as label
  from fx_triples where try_cast(regexp_extract(predicate, '(\\d+)$', 1) as int) % 2 = 0
  union all select distinct value, 'en', upper(value) from fx_triples where value in ('en', 'fr')
),
f as (
  select t.subject, p.prop, coalesce(pl.label, p.prop) as propLabel, t.value, coalesce(vl.label, t.value) as valueLabel
  from fx_triples t join props p on t.predicate = p.direct_claim
  left join labels pl on pl.id = p.prop and pl.lang = 'en'
  left join labels vl on vl.id = t.value and vl.lang = 'en'
)
select subject, prop, propLabel, value, valueLabel from f
where propLabel is not null and valueLabel is not null and valueLabel not like 'Q%'
qualify row_number() over (partition by subject order by propLabel, valueLabel) <= 20
""", "fx_triples"))
def facts_panel(spark, sf_dir):
    """Statements with property map and English labels (fallback to the id /
    literal), id-valued labels dropped, first 20 per subject."""
    t, props, labels = _facts_inputs(spark, sf_dir)
    # batch form of J6: every subject at once (the per-subject filter is the
    # single-entity special case)
    t2 = t.join(props, t.predicate == props.direct_claim).select("subject", "prop", "value")
    lab = labels.where(F.col("lang") == "en").select("id", "label")
    pl = lab.select(F.col("id").alias("prop"), F.col("label").alias("propLabel"))
    vl = lab.select(F.col("id").alias("value"), F.col("label").alias("valueLabel"))
    rows = (t2.join(pl, "prop", "left").join(vl, "value", "left")
            .select("subject", "prop", F.coalesce("propLabel", "prop").alias("propLabel"),
                    "value", F.coalesce("valueLabel", "value").alias("valueLabel")))
    rows = FL.facts_filter(rows)
    return TL.top_k_per_group(rows, ["subject"], ["propLabel", "valueLabel"], 20, salt_of=["prop", "value"])
