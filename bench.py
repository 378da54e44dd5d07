"""Times the headline queries; prints one JSON line."""

import json
import os
import time

from courtflow.plans.registry import QUERIES
from courtflow.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
HEADLINE = (
    "longest_rallies", "rallies", "smooth_track", "player_stats", "heatmap_argmax", "gap_fill", "asof_nearest", "team_tactics", "rally_patterns", "point_rates", "score_match",
    "usual_vs_now", "people_records", "cooldown_peaks", "ball_events", "hit_confirm", "onset_pops", "key_shots", "clip_budget", "takeaways",
)


def main() -> None:
    spark = local_session(CPUS, "16g", CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # warm-up
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(sorted(runs)[1], 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
