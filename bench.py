"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to the noop sink, so nothing is collected to the driver. The
time of a query includes building its plan and any staged table it writes.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["bars", "labelled_features", "ticker_features", "feature_table", "triple_barrier", "sample_weights", "cross_percentile_rank", "quantile_buckets", "daily_ic", "pooled_ic",
            "period_returns", "backtest", "cost_sensitivity", "trade_exits", "running_balance", "realised_equity", "asof_forward_join", "resolve_outcomes", "weekly_ic", "feature_drift", "cusum",
            "train_classifier", "score_latest", "walk_forward_scores"]


def main() -> None:
    from crosspanel.queries import QUERIES
    from crosspanel.session import local_session, release

    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "8g"))
    # load classes and the file listing once, outside the timings
    QUERIES["coverage"](spark, root).write.format("noop").mode("overwrite").save()
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    times, errors = {}, {}
    for name in names:
        t = time.time()
        try:
            QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001
            errors[name] = f"{type(e).__name__}: {str(e)[:300]}"
        times[name] = round(time.time() - t, 3)
        release(spark)
        print(f"{name}: {times[name]}s {errors.get(name, '')}", file=sys.stderr, flush=True)
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(root.rstrip("/")).removeprefix("sf")}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
