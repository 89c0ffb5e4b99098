"""Scalar text functions."""

from pyspark.sql import functions as F

from terrane.functions import text as TX


def _one(spark, col, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(col(F.col("v"))).collect()]


def test_slug_published_names(spark):
    names = ["_Special Investment Fee District: Sewer", "sde.GIS.Lots", "100m USNG Grid (MaxScale=15,000)",
             "Map-Block-Lot (All Scales)"]
    assert _one(spark, TX.slug, names) == ["special_investment_fee_district_sewer", "sde_gis_lots",
                                           "100m_usng_grid_maxscale_15_000", "map_block_lot_all_scales"]


def test_nice_label(spark):
    assert _one(spark, TX.nice_label, ["usgs_earthquakes", "epa_frs_facilities", "levee_system", "osm"]) == [
        "USGS earthquakes", "EPA frs facilities", "Levee system", "OSM"]


def test_wiki_url(spark):
    got = _one(spark, TX.wiki_url, ["Springfield, Ohio", "Café – O'Brien's (Annex)", "Already%20encoded"])
    assert got == ["https://en.wikipedia.org/wiki/Springfield,_Ohio",
                   "https://en.wikipedia.org/wiki/Caf%C3%A9_%E2%80%93_O'Brien's_(Annex)",
                   "https://en.wikipedia.org/wiki/Already%20encoded"]


def test_permalink_round_trip(spark):
    df = spark.createDataFrame([(43.207, -71.538, 12.0, ["city.parcels", "osm.roads"])],
                               "lat double, lon double, z double, ids array<string>")
    link = df.select(TX.permalink(F.col("lat"), F.col("lon"), F.col("z"), F.col("ids")).alias("l")).first().l
    assert link == "?c=43.20700,-71.53800&z=12&l=city.parcels|osm.roads"
    lat, lon, z = TX.permalink_center(F.lit(link))
    r = spark.range(1).select(lat.alias("a"), lon.alias("b"), z.alias("c")).first()
    assert (r.a, r.b, r.c) == (43.207, -71.538, 12.0)


def test_clean_value_and_safe_cast(spark):
    assert _one(spark, TX.clean_value, [" x ", "", "NA", "y" * 81, None]) == ["x", None, None, None, None]
    assert _one(spark, TX.safe_double, ["1.5", "abc", None]) == [1.5, None, None]
