"""Time the headline queries; prints one JSON line.

Each query is drained into a no-op sink, once "cold" and three times warm, of which the median is
reported. Flow and packet views and the capture files are written once beforehand, as they are
stored in practice; that time is reported as "prepare".
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = (
    "flow_assembly", "flow_aggregate", "host_window_sums", "host_window_distinct", "dst_window",
    "pair_repeat_max", "beacon_regularity", "incident_sessions", "incident_aggregate",
    "adaptive_threshold", "flow_dataset", "pcap_scan", "bucket_rollup", "host_rollup", "global_prev_ts", "average_precision",
)


def main() -> None:
    from packetloom.plans import registry
    from packetloom.session import local_session

    spark = local_session(CPUS)
    spark.sparkContext.setLogLevel("OFF")

    def timed(fn) -> float:
        begun = time.perf_counter()
        fn()
        return round(time.perf_counter() - begun, 3)

    def views() -> None:
        for view in (registry.packets, registry.flows, registry.paired, registry.sessions,
                     registry.bounded, registry.captures):
            view(spark, SF_DIR)

    def drain(name: str) -> None:
        registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()

    prepare = timed(views)
    rows = registry.flows(spark, SF_DIR).count()
    cold = {q: timed(lambda: drain(q)) for q in HEADLINES}
    warm = {q: median(timed(lambda: drain(q)) for _ in range(3)) for q in HEADLINES}
    print(json.dumps({
        "metric": "headline queries, warm", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "prepare": prepare, "rows": rows,
        "rows_per_sec": {q: round(rows / t) for q, t in warm.items()},
        "sf": Path(SF_DIR).name.removeprefix("sf"), "cpus": CPUS}))


if __name__ == "__main__":
    main()
