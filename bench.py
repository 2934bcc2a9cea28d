"""Times the headline queries and prints one JSON line.

Stages are built once and shared, as in a real build: the first query that
needs a stage pays for it.  ``rows_per_second`` is the roll-up rate over the
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from placetrace.plans import stages  # noqa: E402
from placetrace.plans.queries import QUERIES  # noqa: E402
from placetrace.session import local_session  # noqa: E402

HEADLINES = (
    "trip_profile",
    "observe_rollup",
    "rows_by_month",
    "catalog_enrich",
    "cluster_by_name",
    "entity_summary",
    "first_trip",
    "identity_review",
    "merge_aliases",
    "feed_rows",
    "distance_join",
    "match_candidates",
    "match_status",
    "validation_checks",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cores, int(cores) if cores.isdigit() else 8, **{"spark.ui.showConsoleProgress": "false"})
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    # Let the JVM compile the plans on a smaller scale first, outside the clock.
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    for name in HEADLINES:
        QUERIES[name](spark, small if os.path.isdir(small) else sf_dir).write.format("noop").mode(
            "overwrite"
        ).save()
    stages.clear()
    seconds = {}
    for name in HEADLINES:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "trip_rows": lines,
                "rows_per_second": round(lines / seconds["observe_rollup"]),
                "cpus": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
