"""Study-area parameters.

Every job takes a :class:`StudyArea`; the defaults are the fixed values of the
study area the engine was built for. They enter plans as literals, so Catalyst
folds them and pushes bbox predicates into the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class BBox:
    xmin: float
    ymin: float
    xmax: float
    ymax: float

    def contains(self, other: "BBox") -> bool:
        return (self.xmin <= other.xmin and self.ymin <= other.ymin
                and self.xmax >= other.xmax and self.ymax >= other.ymax)

    def ring(self) -> list[tuple[float, float]]:
        """Closed counter-clockwise ring."""
        return [(self.xmin, self.ymin), (self.xmax, self.ymin), (self.xmax, self.ymax),
                (self.xmin, self.ymax), (self.xmin, self.ymin)]

    def wkt(self) -> str:
        """POLYGON text with 6-decimal coordinates, as the occurrence scan used."""
        pts = ",".join(f"{x:f} {y:f}" for x, y in self.ring())
        return f"POLYGON(({pts}))"


# Fixed values of the study area (constants the reference fixes).
CITY_BBOX = BBox(-71.668185, 43.151772, -71.456903, 43.309419)
REGION_BBOX = BBox(-71.95, 42.95, -71.30, 43.50)
CENTROID = (-71.538, 43.207)
DOWNTOWN = (-71.5374, 43.2069)
SCHOOL_DISTRICT_IDS = {"city": "3302460", "valley": "3304760"}
FIPS = {"state": "33", "county": "013"}
CITY_ENTITY_ID = "Q28249"
SCHEMAS = ("city", "external", "osm", "apis", "schools", "business", "knowledge", "web")


@dataclass(frozen=True)
class StudyArea:
    city: BBox = CITY_BBOX
    region: BBox = REGION_BBOX
    centroid: tuple[float, float] = CENTROID
    district_ids: tuple[str, ...] = field(
        default_factory=lambda: tuple(SCHOOL_DISTRICT_IDS.values()))
    fips_state: str = FIPS["state"]
    fips_county: str = FIPS["county"]
    entity_id: str = CITY_ENTITY_ID

    def bbox(self, region: bool = False) -> BBox:
        return self.region if region else self.city


DEFAULT_AREA = StudyArea()
