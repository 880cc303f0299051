"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tarnwatch.plans import registry  # noqa: E402
from tarnwatch.session import build_session  # noqa: E402

HEADLINE = ["traffic_features", "flows", "running_flow_features", "global_frequency_features", "signature_matches",
            "hybrid_verdict", "create_alerts", "dedup_alerts", "escalate_alerts", "apply_rules", "kill_chain_progression",
            "campaign_confidence", "behavior_profiles", "zscore_anomalies", "threat_report", "metric_rates", "geolocate",
            "request_quota", "missing_filled", "scale_robust", "roc_auc", "score_batch",
            "group_campaigns", "build_campaigns", "smote", "isolation_forest_anomalies", "clean_features", "train_models",
            "correlate_stream_multi_stage_attack"]
WARM_UP = "flows"  # run once before measuring: JVM, code generation and Python workers


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", master=f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    spark.sparkContext.setLogLevel("ERROR")
    available = registry.queries()
    available[WARM_UP](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names:
        begun = time.time()
        available[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - begun, 3)
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
