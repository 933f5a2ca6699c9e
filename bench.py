"""Time the headline queries; prints one JSON line.

Queries share the staged event table as an analysis session would: the first
query that needs a table pays for building it.  ``cold`` has the time of each
query on tables of its own.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from nocturne.queries import QUERIES  # noqa: E402
from nocturne.queries.registry import forget  # noqa: E402
from nocturne.session import get_session  # noqa: E402

HEADLINE = [
    "event_table", "pursuits_strict", "pursuits_direct", "pump_state_across_nights", "fill_global",
    "visit_summary", "scorecard_without_rank", "glicko_last_nights", "scorecard", "pair_shares",
    "period_contrast", "dispersion", "status_tests_adjusted", "bootstrap_draws",
    "price_five_numbers", "highest_density_intervals", "posterior_modes", "effective_size",
    "welch_by_flag", "two_roles", "top_order_per_customer",
    "logs_to_event_table", "draw_summary", "interaction_table", "holm_adjustment",
]
COLD = ["event_table", "fill_global", "price_five_numbers", "highest_density_intervals", "glicko_last_nights"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", tempfile.mkdtemp(prefix="bench-"))
    spark.conf.set("spark.sql.shuffle.partitions", cpus)
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine

    def timed(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    seconds = {name: timed(name) for name in HEADLINE}
    cold = {}
    for name in COLD:
        forget(spark, sf_dir)
        cold[name] = timed(name)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
