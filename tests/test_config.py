"""Study-area constants (the reference's own offline tests)."""

from terrane.config import CENTROID, CITY_BBOX, REGION_BBOX, SCHOOL_DISTRICT_IDS


def test_city_bbox_well_formed():
    assert CITY_BBOX.xmin < CITY_BBOX.xmax and CITY_BBOX.ymin < CITY_BBOX.ymax
    assert -72 < CITY_BBOX.xmin < -71 and 43 < CITY_BBOX.ymin < 44


def test_region_contains_city():
    assert REGION_BBOX.contains(CITY_BBOX)


def test_centroid_near_downtown():
    assert abs(CENTROID[0] - (-71.538)) < 0.1 and abs(CENTROID[1] - 43.207) < 0.1


def test_two_district_ids():
    assert sorted(SCHOOL_DISTRICT_IDS.values()) == ["3302460", "3304760"]


def test_bbox_wkt_ring_closed():
    ring = CITY_BBOX.ring()
    assert ring[0] == ring[-1] and len(ring) == 5
    assert CITY_BBOX.wkt().startswith("POLYGON((-71.668185 43.151772,")
