"""Parameters of the rules, with the values the published results rely on."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values -------------------------------------------------------------
# Words and patterns that mark a place as operational rather than public.
OPERATIONAL_WORDS = (
    r"test(?:ing)?",
    r"warehouse",
    r"repair",
    r"maintenance",
    r"bike.checking",
    r"depot",
    r"private rack",
)
OPERATIONAL_PATTERNS = (
    r"^base\b",
    r"^mtv\b",
    r"hubbard_test",
    r"hastings",
    r"chi.watson",
    r"map frame",
)
PUBLIC_RACK = "public rack"

# Readable headers for the generated region columns of the city inventory.
REGION_COLUMNS = {
    ":@computed_region_awaf_s7ux": "historical_ward_2003_2015_region_id",
    ":@computed_region_6mkv_f3dw": "zip_code_region_id",
    ":@computed_region_vrxf_vc4k": "community_area_region_id",
    ":@computed_region_bdys_3d7i": "census_tract_region_id",
    ":@computed_region_43wa_7qmu": "ward_region_id",
    ":@computed_region_rpca_8um6": "zip_code_boundary_region_id",
    ":@computed_region_8hcu_yrd4": "ward_2023_region_id",
}

# Columns an inventory gains from the reference it is joined to.
INVENTORY_COLUMNS = (
    "station_key",
    "station_first_trip_at",
    "source_ids",
    "name_variants",
    "first_trip_archive",
    "opening_date_status",
    "earlier_same_name_trip_at",
    "service_date_review_reasons",
)

EARTH_RADIUS_METRES = 6_371_000.0
LIST_SEPARATOR = " | "
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class Box:
    """Inclusive latitude/longitude box that a usable coordinate lies in."""

    lat_min: float = 41.4
    lat_max: float = 42.3
    lon_min: float = -88.1
    lon_max: float = -87.3


@dataclass(frozen=True)
class Rules:
    box: Box = Box()
    match_metres: float = 150.0
    alias_metres: float = 35.0
    max_dispersion_metres: float = 300.0
    coarse_tolerance: float = 1e-9
    coarse_half_cell: float = 0.005
    min_arrival_coordinates: int = 3
    min_reliable_coordinates: int = 10
    min_evidence: int = 10
    min_similarity: float = 0.65
    first_archive_day: str = "2013-06-27"
    key_prefix: str = "place_"
    feed_archive: str = "current_feed_snapshot"
    # Words of one operator's own (brand names and the like), as regex terms.
    extra_operational_words: tuple[str, ...] = ()

    @property
    def operational_regex(self) -> str:
        words = "|".join(OPERATIONAL_WORDS + self.extra_operational_words)
        return "|".join((rf"\b({words})\b",) + OPERATIONAL_PATTERNS)


DEFAULT = Rules()
