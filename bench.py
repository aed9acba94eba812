"""Time the headline queries; prints one JSON line.

Each query is built, planned and executed in full (no rows are collected).
"""

from __future__ import annotations

import json
import os
import sys
import time

from tagtrack.plans.queries import QUERIES
from tagtrack.session import local_session

HEADLINE = (
    "parse_ranges",
    "ranges_log",
    "telemetry_valid",
    "latest_per_anchor",
    "asof_hold",
    "ema_distance",
    "locate_2d",
    "locate_2d_full",
    "locate_3d_to_2d",
    "locate_3d_point",
    "locate_3d_track",
    "player_card",
    "player_card_3d",
    "running_max",
    "running_total_lines",
    "trail_lines",
    "heatmap_smooth",
    "heat_rgba",
    "error_final_2d",
    "truth_at_delay",
    "best_delay",
    "zone_time",
)
#: the heaviest jobs, timed after the headline ones and not part of their total
HEAVY = (
    "locate_2d_frame",
    "score_3d_track",
    "error_3d",
    "alpha_sweep",
    "locate_3d_async",
    "messages_to_positions",
    "card_from_locate_2d",
    "heat_from_locate_2d",
    "stream_track",
    "stream_messages_to_positions",
    "stream_latest",
    "stream_sessions",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or (*HEADLINE, *HEAVY)
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(v for n, v in times.items() if n not in HEAVY or sys.argv[1:]), 3),
                "heavy_value": round(sum(v for n, v in times.items() if n in HEAVY), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
