"""All queries of the library on one node (or those named); prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from touchline.plans import registry
from touchline.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
LIMIT = float(os.environ.get("BENCH_LIMIT_S", "1200"))  # later queries are listed as not run
COSTLY = ("gbm", "feature_importance", "ts_cv", "backtest", "fitted_rps_by_season", "ablation", "fit_certificates")  # come last


def main() -> None:
    spark = build_session(CPUS, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    names = sys.argv[1:] or [*[q for q in queries if q not in COSTLY], *COSTLY]
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    left_out = []
    for name in names:
        if sum(seconds.values()) > LIMIT:
            left_out.append(name)
            continue
        start = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "not_run": left_out,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
