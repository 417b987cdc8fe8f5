"""Times the headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from airloom.plans import catalogue  # noqa: E402
from airloom.session import session  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "q02_dedup_events",
    "q05_window_stats",
    "q07_window_slope",
    "q12_late_accounting",
    "q17_signature",
    "q21_scenario_gating",
    "q29_active_incidents",
    "q33_ticket_episodes",
    "q37_ticket_upsert",
    "q44_knn",
    "q49_headings_sections",
    "q50_word_chunks",
]
LIMIT_S = 400


def main() -> None:
    spark = session(
        "bench",
        **{
            "spark.master": f"local[{CPUS}]",
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times, began = {}, time.time()
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            t = time.time()
            catalogue.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
            if time.time() - began > LIMIT_S:
                break
        times[name] = round(median(runs[1:] or runs), 3)
    print(
        json.dumps(
            {
                "metric": "sum of warm medians",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
