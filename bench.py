"""Wall time of the headline queries; prints one JSON line.

Each query is planned, run and counted in full (every output column is produced) on
``local[$BENCH_CPUS]``. The first run of a query includes code generation; the best of
``BENCH_RUNS`` runs is reported, with the first one beside it.
"""

from __future__ import annotations

import json
import os
import time

from tapewright.catalog import QUERIES
from tapewright.session import local_session

HEADLINE = [
    "bars_ohlcv", "bars_index", "dedupe_keep_last", "upsert_tail", "rolling_mean_sum",
    "rolling_std", "rolling_extremes", "rolling_quantile", "rolling_blocks", "atr14",
    "cum_typical", "ewm_adjust_true", "ewm_adjust_false", "ewm_gaps_blocks",
    "adv_norm_volume", "breadth", "tail_spread", "tail_spread_hot_groups", "pivot_pressure",
    "pca_projection", "xsection_features", "asof_features", "asof_tolerance",
    "backfill_join", "feature_frame", "feature_frame_blocks", "score_chain", "signals",
    "stream_bars",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus)
    best, first = {}, {}
    for name in names:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        best[name], first[name] = round(min(times), 3), round(times[0], 3)
    print(
        json.dumps(
            {
                "metric": "total_wall_time",
                "value": round(sum(best.values()), 3),
                "unit": "sec",
                "queries": best,
                "first_run": first,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
