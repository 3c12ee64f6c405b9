"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Inputs derived from the given tables are written first and reported apart. Each query runs once cold and, while the time allowance lasts, again:
twice, or once if it took long. Its figure is the median of its warm runs, or the cold run where there was no time for others.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from catalogue import inputs
from catalogue.building import responses
from catalogue.registry import QUERIES
from ledgerloom.session import local_session, release

HEADLINE = (
    "supplier_master", "match_cascade", "match_fuzzy", "po_lookup", "line_pairs_scored", "line_assignment", "line_substring_large",
    "review_queue", "discrepancies_long", "state_latest", "stats", "response_parse", "custom_regex", "line_items_from_grid",
    "normalised_supplier", "supplier_duplicates", "export_xml", "ground_fields",
)
#: Run once: a stream keeps its own state between runs.
ONCE = ("stream_ingest_state",)
#: Seconds after which no warm run is started.
ALLOWANCE = 600
#: Seconds of a cold run after which one warm run is enough.
LONG = 15


def run(spark, name: str, sf_dir: str) -> float:
    start = time.time()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    begin = time.time()
    for build in (inputs.suppliers, inputs.purchase_orders, inputs.po_lines, inputs.invoices, inputs.raw_lines, responses):
        build(spark, sf_dir)
    for name in ("clin", "cpol"):
        inputs.view(spark, sf_dir, name)
    staged = round(time.time() - begin, 3)
    print(f"stage_inputs {staged}", file=sys.stderr, flush=True)
    seconds, cold = {}, {}
    for name in (*[n for n in HEADLINE if n in QUERIES], *ONCE):
        cold[name] = run(spark, name, sf_dir)
        times = 0 if name in ONCE else 1 if cold[name] > LONG else 2
        warm = [run(spark, name, sf_dir) for _ in range(times) if time.time() - begin < ALLOWANCE]
        seconds[name] = round(median(warm or [cold[name]]), 3)
        print(f"{name} cold {cold[name]} median {seconds[name]}", file=sys.stderr, flush=True)
    release(spark)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "cold": cold,
        "stage_inputs": staged, "sf": sf_dir.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
