"""Times headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tertulia.plans import registry  # noqa: E402
from tertulia.plans.graph import forget_stored  # noqa: E402
from tertulia.session import build_session  # noqa: E402

HEADLINE = [
    "r00_all_matches", "r20_monedas_explicitas", "a04_temporal_references", "a11_category_ranking", "t03_price_statistics",
    "t04_price_trend", "t08_patterns_by_hour", "t18_executive_summary", "l03_page_labels", "l20_instagram", "l02_rewritten_texts",
    "g05_candidate_pairs", "g07_reply_probability", "g15_thread_members", "g26_components", "h05_intention_sequences",
    "m01_lexicon_score", "m04_sentence_scores", "m12_transitions", "d01_positive_pairs", "d02_random_negatives",
    "d06_hard_negatives", "d10_token_jaccard", "e09_roc_auc", "w01_alarm_hits", "w15c_session_windows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    registry.load_all()
    registry.QUERIES["t06_hourly_activity"](spark, sf_dir).count()  # starts the executors' code paths
    times = {}
    for name in HEADLINE:
        forget_stored()  # each query pays for the tables it stores
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
