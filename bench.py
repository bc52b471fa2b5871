"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local cores.
"""

import json
import os
import time

from pyspark.sql import functions as F

from stintlake.plans import fixtures
from stintlake.plans.queries import QUERIES
from stintlake.session import local_session

HEADLINE = [
    "telemetry_lap_join", "lap_distance", "silver_laps", "silver_telemetry",
    "lap_position_quality", "sample_spacing", "race_position_quality",
    "rule_107_circuit", "pace_delta", "warehouse_laps", "bi_wear_curve",
    "stop_requests", "best_stop", "stop_predictions",
    "catalogue_races", "catalogue_drivers",
    "middle_lap", "fastest_lap", "lap_enriched", "g_diagnostic",
    "track_segments", "braking_zones", "nearest_sample", "gap_ahead",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()
    seconds = {}
    # Deriving and storing the two input tables is timed as well, before the queries.
    for name, derive in {"derive_laps": fixtures.laps, "derive_telemetry": fixtures.telemetry}.items():
        start = time.perf_counter()
        derive(spark, sf_dir)
        seconds[name] = round(time.perf_counter() - start, 3)
    # The full wear model, trained once for the five queries that use it.
    start = time.perf_counter()
    QUERIES["wear_metrics"](spark, sf_dir).collect()
    seconds["train_wear_model"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": cpus,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
