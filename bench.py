"""Wall seconds of the registered queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from folium.session import local_session
from folium.table_queries import QUERIES

HEADLINE = [
    "type_summary",
    "relation_summary",
    "class_restricted_summary",
    "faceted_publications",
    "facet_options",
    "kpis",
    "year_type_series",
    "department_summary",
    "territory_counts",
    "public_territory",
    "consolidate_publications",
    "remap_bridge",
    "consolidated_export",
    "precedence_level",
    "level_conflicts",
    "keep_first_unique",
    "recode_empties",
    "normalize_key",
    "normalize_lower",
    "host_classifier",
    "marker_prefix_exact_class",
    "title_rules",
    "requested_updates",
    "binary_type",
    "postgrad_detail",
    "column_profile",
    "bridge_cardinality",
    "scalar_vs_bridge",
    "controls",
    "orphans",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores)
    # Throw-away queries, one of which shuffles, so that start-up is not charged to the first one.
    for name in ("year_bounds", "type_summary"):
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cores": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
