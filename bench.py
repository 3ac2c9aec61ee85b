"""Headline queries, timed one by one; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from assaylake.plans import QUERIES
from assaylake.session import local_session

HEADLINE = [
    "agg_01_describe", "agg_03_profile", "flt_03_outliers_iqr", "flt_05_outliers_by_split", "sca_05_fill_median", "sca_06_fill_mode",
    "sca_08_scale_standard", "sca_10_scale_robust", "sca_15_power_lambda", "sta_01_gram", "sta_01_gram_array", "sta_03_correlation_matrix",
    "sta_08_distribution", "win_01_global_rank", "win_02_forward_fill_by", "win_05_durbin_watson", "spl_01_random", "spl_02_stratified",
    "spl_04_endpoints", "spl_08_kfold", "reg_01_ols", "reg_02_metrics_by_split", "reg_04_cross_validation", "reg_05_leave_one_out",
    "reg_07_williams", "reg_10_pcr", "pca_01_scores", "pca_01_variance_wide", "jon_01_attach_numeric", "jon_04_key_candidates",
    "jon_08_count_limits", "clu_01_lloyd_steps", "clu_03_dbscan", "clu_11_two_way_table", "cls_02_naive_bayes", "cls_08_report",
    "jon_10_nearest_neighbour", "clu_04_k_distance", "cls_04_nearest_neighbour", "chm_03_kowwin", "chm_11_batch_scoring", "win_06_half_response", "src_09_group_definitions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 4)
    only = sys.argv[1:]
    spark = local_session(cores, shuffle_partitions=max(8, int(cores)))
    # One small job first, so that starting the JVM and the Python workers is not timed.
    QUERIES["reg_02_metrics_by_split"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
