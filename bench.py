"""Times the headline queries once each after one warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from sumstead.plans.analytics_queries import QUERIES as ANALYTICS
from sumstead.plans.cleaning_queries import QUERIES as CLEANING
from sumstead.plans.question_queries import QUERIES as QUESTIONS
from sumstead.session import build_session

HEADLINE = (
    "q_m2_monthly_metrics", "q_a12_dashboard", "q_a3_ratio", "q_m4_store_comparison", "q_t3_top_products",
    "q_w4_weekday_baseline", "q_i4_insight_feed", "q_q6_accepted", "q_u1_ledger", "q_a7_run_summary",
    "q_q8_quality_summary", "q_l3_intents", "q_l6_linked_products", "q_l10_product_answers",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = {**CLEANING, **ANALYTICS, **QUESTIONS}
    # Starts the JVM's code paths and the file cache; not timed.
    queries["q_m2_monthly_metrics"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }, ensure_ascii=False))


if __name__ == "__main__":
    main()
