"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], the least of two runs each, and print one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import QUERIES  # noqa: E402

HEADLINE = (
    "class_fractions", "slope", "dtm", "proximity", "median_dist", "building_components", "building_summary",
    "component_edges", "component_rings", "component_wkt", "zonal_median", "zonal_majority", "cell_profile", "mosaic", "lcz_scores", "lcz_contributions", "lcz_matches", "lcz_classify", "lcz_grid",
    "align_regridded", "cell_profile_large", "mosaic_tiles", "window_sums", "sky_view",
)
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's and the Python workers' first-use costs outside the timings.
    QUERIES["proximity"](spark, sf_dir).limit(1).collect()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = min(times.get(name, float("inf")), round(time.perf_counter() - start, 3))
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
