"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the timed rounds over all queries
after one untimed round; the reported time of a query is its median.  Plans are built anew in every round.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dwellgrid.catalog.queries import queries  # noqa: E402
from dwellgrid.session import local_session  # noqa: E402

HEADLINE = [
    "utilization_by_floor",
    "utilization_floor",
    "compare_floors",
    "busiest_rooms",
    "peak_hours_floor",
    "kpis_24h",
    "status_floor_now",
    "free_rooms_now",
    "underused_rooms",
    "all_rooms_rate",
    "dense_hourly_series",
    "facility_features",
    "rank_zones",
    "find_rooms_like",
    "data_profile",
    "overview",
    "data_overview_7d_30d",
    "hourly_rollup",
    "question_intents",
    "dialogue_last8",
    "row_documents",
    "document_chunks",
    "knn_cosine_gated",
    "mmr_rerank",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cores)
    catalogue = queries()
    times = {name: [] for name in chosen}
    for _ in range(runs + 1):
        for name in chosen:
            began = time.perf_counter()
            catalogue[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name].append(time.perf_counter() - began)
    seconds = {name: round(statistics.median(t[1:]), 4) for name, t in times.items()}
    label = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "sum of median seconds per headline query",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": float(label) if label.replace(".", "", 1).isdigit() else label,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
