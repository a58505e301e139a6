"""Headline queries at one scale: prints one JSON line.

Stored frames (aligned frame, index, bars, evidence) are built by the first query that needs them and
timed under ``stored``; then every query runs once to warm up and BENCH_RUNS times for the median.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from chorale.plans import catalog
from chorale.plans import q_outcomes, q_survey
from chorale.plans import testbed as tb
from chorale.session import local_session

HEADLINE = [
    "H1_derive_detections", "I2_align_shared_grid", "I3_align_run_closed_time", "J5_per_species_table", "J7_summary", "J7_micro_curve",
    "T3_strength", "P6_muddiness", "P13_matched_league", "K5_vocalisation_outcomes", "K17_summary", "U3_bootstrap", "V4_evidence",
    "V13_sweep", "V17_held_out_own", "X7_navigator_bins", "X10_box_suggestions", "E8_recall_table", "L5_draw_sample", "L9_accumulation",
    "G2_label_windows", "G6_merge_spans",
]


def run(df) -> int:
    """Every row and column is computed, none is collected."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_CPUS", "8")))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    stored = {}
    for name, build in (("aligned", tb.aligned), ("detections", tb.detections), ("labelled windows", q_outcomes.lab), ("boxes", q_outcomes.cov),
                        ("bars", q_survey.bars), ("evidence", q_survey.ev)):
        t0 = time.perf_counter()
        build(spark, sf).count()
        stored[name] = round(time.perf_counter() - t0, 3)
    times = {}
    for name in HEADLINE:
        fn = catalog.QUERIES[name].run

        def once() -> float:
            if name == "V13_sweep":  # the query under test is the sweep itself, not its stored result
                for key in [k for k in tb._STORED if k[2] == "sweep"]:
                    tb._STORED.pop(key)
            if name == "V17_held_out_own":
                q_survey.forget_held_out()
            t0 = time.perf_counter()
            run(fn(spark, sf))
            return time.perf_counter() - t0
        first = once()
        times[name] = round(statistics.median(once() for _ in range(1 if first > 30 else runs)), 3)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "stored": stored, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
