"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
import json
import os
import time

from cohortloom import plans, session

HEADLINE = [
    "g01_signal_summary", "g04_extract_features", "g06_peak_count", "g14_welch_features", "g18_saccade_metrics", "j02_validated_join",
    "j11_asof_align", "b04_classification_metrics", "b08_regression_metrics", "b11_canonical_oof", "b13_metrics_rollup", "b17_efficiency",
    "f07_classify_by_keywords", "q05_mask_unavailable", "q13_group_kfold", "q21_table_hash", "s04_drop_duplicates", "w04_lag_lead",
    "x05_anova_f", "x10_apply_state", "h04_encode", "h04_encode_full_dimension", "h07_cosine_scores", "h13_select_temperature",
    "m05_knn_uniform", "n01_wilcoxon_statistic", "n05_pareto_front", "n06_bootstrap_ci", "n07_cluster_bootstrap",
]


def run(spark, sf, name):
    start = time.perf_counter()
    plans.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session.build(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ["BENCH_QUERIES"].split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    times = {}
    for name in names:
        run(spark, sf, name)
        times[name] = round(sorted(run(spark, sf, name) for _ in range(repeats))[repeats // 2], 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
