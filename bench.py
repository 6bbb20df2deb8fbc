"""Headline queries, timed one after the other; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from judgelake.plans.catalogue import QUERIES
from judgelake.session import local_session

HEADLINE = ["e4_rank_and_cap", "e5_measurement_verdict", "f1_match_findings", "f1_match_grid", "f10_aggregate_scores", "f14_replay_grid",
            "g8_sweep_curve", "g10_change_rules", "c8_parse_diff", "c12_cluster_span", "c21_unit_state", "c7_diff_rebuild", "c22_locate",
            "h8_decide", "i9_spot_check_rows", "i15_pre_samples", "i17_violations", "j2_rolling_rate", "d2_score_units", "a4_read_tsv"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["e1_compose"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start workers and caches
    times = {}
    for name in os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split():
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
