"""One JSON line with the seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]."""

from __future__ import annotations

import json
import os
import sys
import time

from latentia.plans.catalogue import QUERIES
from latentia.session import session

HEADLINE = ["daily_realized_variance", "bars_gapfill", "roll_noise", "roll_by_state", "signature", "bipower_daily", "naive_vol_rule", "kalman_filter", "imm_filter", "circular_null", "walkforward_folds", "auc", "reliability_bins", "cost_curve", "platt_walkforward", "lr_oof", "imm_regimes", "mlp_compare"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["bars_last"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is not measured
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
