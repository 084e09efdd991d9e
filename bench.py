"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``, each warmed up on the smallest tables; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spatialqa.registry import QUERIES  # noqa: E402
from spatialqa.session import local_session  # noqa: E402

HEADLINE = ["nms_kept", "nms_mixed", "overlap_pairs", "overlap_pairs_mixed", "fused_candidates", "detection_scores", "archive_dedup", "union_coverage", "pixel_owners",
            "mask_quality", "routed_candidates", "selected_candidates", "scan_plan", "round_progress", "merged_confidence", "regression_gate"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "spatialqa-bench", partitions=int(cpus) if cpus.isdigit() else 8)
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    run = lambda name, where: QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
    for name in names if os.path.isdir(small) else ():
        run(name, small)  # warm-up: code is loaded and compiled
    for name in names:
        start = time.perf_counter()
        run(name, folder)
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
