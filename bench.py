"""Times the headline queries at ``$BENCH_SF_DIR`` and prints one JSON line.

``BENCH_QUERIES`` names other queries, comma-separated, or ``all``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from amperic.plans.catalog import QUERIES
from amperic.session import local_session

# At least one query per operator family.
HEADLINE = [
    "deployed_readings", "outage_transitions", "outage_ordinal", "sensor_population_10d", "powered_snapshot_4m",
    "majority_resample_5m", "outage_powered_sensors", "powered_x_outage_minute", "gps_accuracy", "grid_distance",
    "pair_grid_distance", "dbscan_time_eps90", "dbscan_time_min5", "st_dbscan", "st_dbscan_grid", "dbscan_features",
    "agglomerate_time", "optics_time", "cluster_summary", "saifi", "saidi_ignore_restore", "label_quality",
    "saidi_noise_split", "saidi_nearest_time", "saidi_nearest_space", "outage_size_histograms",
    "readings_in_cluster_interval", "powered_in_hull", "hull_area", "percent_area_out", "k_distance", "kde_grid",
    "silhouette_time", "io_round_trip",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    named = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    names = list(QUERIES) if named == ["all"] else named or HEADLINE
    spark = local_session(cores, partitions=cores, app="bench")
    spark.sparkContext.setLogLevel("OFF")
    # start the workers and load the classes outside the timings
    QUERIES["outage_transitions"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    taken = {}
    for name in names:
        run = QUERIES[name]
        begin = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.perf_counter() - begin, 3)
        print(f"{name} {taken[name]}", file=sys.stderr)
    line = {
        "metric": "queries, wall clock",
        "value": round(sum(taken.values()), 3),
        "unit": "sec",
        "queries": taken,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
