"""Headline queries, timed one after another; prints one JSON line.

The stored hand-over tables are built first and timed under ``build_*``; the
queries then start from them. ``export_*`` times an operator alone, without the digest that its
query prints for the comparison with SQL.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from barfold.session import local_session  # noqa: E402
from barfold.operators import samples  # noqa: E402
from workload.queries import QUERIES, SEQ_LEN, STORED_INPUTS, Inputs  # noqa: E402

HEADLINE = (
    "dedupe_bars", "tradable_range", "adjustment_factors", "apply_adjustment",
    "apply_adjustment_scan", "quality_per_isin", "liquid_universe", "volume_baseline",
    "compute_features", "sample_index", "export_windows", "panel_index", "assign_splits",
    "shuffle_labels", "fit_predict_ar1", "fit_predict_quantiles", "walk_forward_ar1", "walk_forward_quantiles",
    "score_panels_softmax", "backtest_rows",
    "backtest_rows_pooled", "rank_ic_summary", "pinball_loss", "flagship_rank_ic",
)


EXPORTS = {"export_windows": lambda x: samples.sample_windows(x.features, SEQ_LEN)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "barfold-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in STORED_INPUTS:
        start = time.perf_counter()
        getattr(Inputs(spark, sf_dir), name)
        seconds[f"build_{name}"] = round(time.perf_counter() - start, 3)
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        made = EXPORTS[name](Inputs(spark, sf_dir)) if name in EXPORTS else QUERIES[name](spark, sf_dir)
        made.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
