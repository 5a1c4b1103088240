"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from panelcast.catalog.queries import registry
from panelcast.session import build_session

HEADLINE = [
    "bars_daily",
    "bars_fine",
    "mfi_signal",
    "features",
    "split_walkforward",
    "linear_forecast",
    "elasticnet_forecast",
    "knn_tuned",
    "arima_forecast",
    "leaderboard",
    "forecast_job",
    "forecast_job_fine",
    "forecast_request",
    "knn_impute",
    "stmt_long",
]


def run(spark, name: str, folder: str) -> float:
    started = time.perf_counter()
    registry()[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "bars_daily", folder)  # start-up of the JVM and the file cache
    seconds = {name: round(run(spark, name, folder), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
