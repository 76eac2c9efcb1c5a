"""Headline queries, timed: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from airlens.plans import registry
from airlens.session import local_session

QUERIES = ["states_with_features", "finding_candidates", "findings_by_rule", "encounter_pairs", "traffic_density", "restricted_traffic", "launch_exposure", "feed_comparison_summary", "enriched_states", "rule_close_approach",
           "collision_probability", "rule_telemetry", "packet_authentication", "caption_milestones"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    registry.load()
    registry.tune(spark)
    registry.QUERIES["traffic_states"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the JVM
    times, failed = {}, []
    for name in QUERIES:
        t = time.time()
        try:
            registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001 - the other figures still count
            failed.append(name)
            print(f"{name}: {str(e)[:300]}", file=sys.stderr, flush=True)
            continue
        times[name] = round(time.time() - t, 3)
        print(f"{name}: {times[name]} s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")), **({"failed": failed} if failed else {})}))
    if failed:
        sys.exit(1)


if __name__ == "__main__":
    main()
