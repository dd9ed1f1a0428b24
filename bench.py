"""Time the headline queries; prints one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times; the best time
counts. Model fits are long, so they run once. Beside them stand DuckDB's seconds
for the same result by the SQL that checks it, as a yardstick on one machine.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from subsight.plans.catalog import QUERIES  # noqa: E402
from subsight.plans.oracles import ORACLES  # noqa: E402

TABLES = ["nation", "customer", "orders", "events"]

HEADLINE = [
    "scan_subscribers",
    "scope_counts",
    "variant_profile",
    "ab_conversion",
    "ab_sample_size",
    "ab_z_two_sample",
    "sample_n",
    "ztest_trials",
    "sprt_decision",
    "tier_assign",
    "signups_by_tier",
    "acquisition_by_tier_channel",
    "cac_by_tier_channel",
    "cohort_counts",
    "cohort_retention",
    "engagement_features",
    "validation_join",
    "trial_days",
    "refund_revenue_audit",
    "churn_counts",
    "impute_by_frequency",
    "one_hot",
    "minmax_scaled",
    "binary_metrics",
    "auc",
    "cac_per_subscriber",
    "clv_summary",
    "clv_hist_by_tier",
    "clv_kde",
    "churn_by_channel",
]
FITS = ["logistic_scores", "forest_scores"]


def seconds(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def duckdb_seconds(sf_dir: str) -> dict[str, float]:
    """Seconds of the checking SQL in DuckDB, best of two runs."""
    try:
        import duckdb
    except ImportError:
        return {}
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    times = {}
    for name in HEADLINE:
        if name in ORACLES:
            runs = []
            for _ in range(2):
                start = time.perf_counter()
                connection.execute(ORACLES[name]).fetchall()
                runs.append(time.perf_counter() - start)
            times[name] = round(min(runs), 3)
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("subsight-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        seconds(spark, name, sf_dir)
        times[name] = round(min(seconds(spark, name, sf_dir) for _ in range(runs)), 3)
    for name in FITS:
        times[name] = round(seconds(spark, name, sf_dir), 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
                "spark": spark.version,
                "cpus": cpus,
                "duckdb": duckdb_seconds(sf_dir),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
