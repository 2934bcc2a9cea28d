"""The build over the check tables, stage by stage, each materialised once.

The data shrinks by orders of magnitude at the roll-up, so that and the later
stages are written to the checkpoint folder and shared by the queries of a
session.  ``clear()`` forgets them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placetrace.operators import matching
from placetrace.operators.aliases import flag_renames, identity_review, merge_aliases
from placetrace.operators.cluster import cluster_by_name, entity_key
from placetrace.operators.coordinates import recover_feed_coordinates, reject_scattered, use_arrivals, use_catalog
from placetrace.operators.entities import public_entities, summarize_entities
from placetrace.operators.names import recover_names, with_exclusion
from placetrace.operators.observe import observe_stored, single_ends
from placetrace.operators.profile import profile_trips
from placetrace.plans import adapters
from placetrace.session import FILE_ROWS, checkpoint, checkpoint_large

# Read by the scatter test only.
CORNERS = ("lat_p05", "lat_p95", "lon_p05", "lon_p95")

_DONE: dict[tuple[str, str, str], DataFrame] = {}


def clear() -> None:
    _DONE.clear()


class Stages:
    """Lazily built stages of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def _once(self, name: str, build: Callable[[], DataFrame], file_rows: int = FILE_ROWS) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _DONE:
            _DONE[key] = checkpoint_large(build(), file_rows)
        return _DONE[key]

    # Sources.  Normalised trips are written once and then scanned by column.
    def trips(self) -> DataFrame:
        # A trip has two ends, so a task of the census holds twice the rows.
        return self._once("trips", lambda: adapters.trips(self.spark, self.sf_dir), FILE_ROWS // 2)

    def catalog(self) -> DataFrame:
        return adapters.catalog(self.spark, self.sf_dir)

    def city(self) -> DataFrame:
        return adapters.city(self.spark, self.sf_dir)

    def information(self) -> DataFrame:
        return adapters.information(self.spark, self.sf_dir)

    def status(self) -> DataFrame:
        return adapters.status(self.spark, self.sf_dir)

    def boundary(self) -> DataFrame:
        return adapters.boundary(self.spark)

    def table(self, name: str) -> DataFrame:
        return adapters.table(self.spark, self.sf_dir, name)

    # Stages.
    def observations(self) -> DataFrame:
        return self._once("observations", lambda: observe_stored(self.trips()))

    def profiles(self) -> DataFrame:
        return self._once("profiles", lambda: profile_trips(self.trips(), ends=single_ends(self.trips())))

    # Stored at each step whose rows are split for the next: a filter on derived columns derives them anew.
    def named(self) -> DataFrame:
        return self._once("named", lambda: reject_scattered(recover_names(self.observations())).drop(*CORNERS))

    def enriched(self) -> DataFrame:
        return self._once("enriched", lambda: use_arrivals(use_catalog(self.named(), self.catalog())))

    def located(self) -> DataFrame:
        return self._once(
            "located",
            lambda: with_exclusion(recover_feed_coordinates(self.enriched(), self.information(), self.city())),
        )

    def kept(self) -> DataFrame:
        return self.located().filter("reason IS NULL").drop("reason")

    def excluded(self) -> DataFrame:
        return self.located().filter("reason IS NOT NULL")

    def clusters(self) -> DataFrame:
        """Observations by place, before aliases are merged."""
        return self._once("clusters", lambda: cluster_by_name(self.kept(), stored=True))

    def by_name(self) -> DataFrame:
        """An older, simpler build: one entity per name."""
        nowhere = F.lit(None).cast("double")
        return (
            self.kept()
            .withColumn("anchor_lat", nowhere)
            .withColumn("anchor_lon", nowhere)
            .withColumn("cluster_no", F.lit(0).cast("long"))
            .withColumn("ambiguous", F.lit(False))
            .withColumn("many_locations", F.lit(False))
            .withColumn("station_key", entity_key(F.col("name_key"), nowhere, nowhere))
        )

    def _summary(self, clustered: DataFrame) -> DataFrame:
        flags = {"many_locations": "name_has_multiple_locations", "merged": "nearby_name_aliases_merged"}
        present = {old: new for old, new in flags.items() if old in clustered.columns}
        return summarize_entities(
            clustered.withColumnsRenamed(present),
            self.catalog(),
            self.boundary(),
            extra_flags=list(present.values()),
        )

    def singles(self) -> DataFrame:
        """Entities before aliases are merged."""
        return self._once("singles", lambda: self._summary(self.clusters()))

    def _merge(self) -> tuple[DataFrame, DataFrame]:
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if (*key, "clustered") not in _DONE:
            rekeyed, merges = merge_aliases(self.clusters(), self.singles())
            _DONE[(*key, "clustered")] = checkpoint_large(rekeyed)
            _DONE[(*key, "merges")] = checkpoint(merges)
        return _DONE[(*key, "clustered")], _DONE[(*key, "merges")]

    # From here on as in the shipped build: everything starts from merged entities.
    def clustered(self) -> DataFrame:
        return self._merge()[0]

    def merges(self) -> DataFrame:
        return self._merge()[1]

    def entities(self) -> DataFrame:
        return self._once("entities", lambda: self._summary(self.clustered()))

    def old_entities(self) -> DataFrame:
        return self._once("old_entities", lambda: self._summary(self.by_name()))

    def review(self) -> DataFrame:
        return self._once("review", lambda: identity_review(self.entities(), self.clustered()))

    def flagged(self) -> DataFrame:
        return flag_renames(self.entities(), self.review())

    def feeds(self) -> DataFrame:
        return self._once(
            "feeds",
            lambda: matching.feed_rows(
                self.city(), self.information(), self.status(), self.boundary()
            ),
        )

    def candidates(self) -> DataFrame:
        return self._once(
            "candidates",
            lambda: matching.resolve_matches(
                matching.match_candidates(self.entities(), self.feeds())
            ),
        )

    def matches(self) -> DataFrame:
        """The candidates that can be accepted or call for a review; pairs that are only near are not formed."""
        return self._once(
            "matches",
            lambda: matching.resolve_matches(
                matching.with_evidence(matching.match_candidates(self.entities(), self.feeds()))
            ),
        )

    def reconciled(self) -> DataFrame:
        return self._once(
            "reconciled",
            lambda: matching.reconcile(
                self.flagged(), self.feeds(), self.matches(), "2026-09-15"
            ),
        )

    def public(self) -> DataFrame:
        return public_entities(self.reconciled())
