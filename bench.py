"""Times the headline queries, each with all its stages built anew, and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1) and BENCH_CPUS the local cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from saldo.plans.catalogue import run_alone  # noqa: E402

HEADLINE = (
    "ing_ids",
    "ing_gateway_charge",
    "fn_scale",
    "led_daily_balance",
    "bat_gross",
    "stm_totals",
    "alloc_largest",
    "settlements",
    "settlements_stated",
    "erp_assess_plain",
    "erp_assess_orders",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("saldo-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    run_alone("bat_build", spark, directory).count()  # start-up is not part of any query
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        run_alone(name, spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(directory).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
