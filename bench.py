"""Time the headline queries once each and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barrio.catalog import QUERIES, load  # noqa: E402
from barrio.catalog.registry import stored_places  # noqa: E402
from barrio.session import build_session  # noqa: E402

HEADLINE = [
    "w2_one_to_one", "j1_candidate_pairs", "g6_match_audit", "w5_nearest_open",
    "j2_nearest_per_query_point", "g4_grid_clusters", "u2_osm_upsert", "u4_guarded_prune",
    "u5_refinement_policy", "o7_compose_hours", "o5_can_sell", "g9_top_areas", "g1_madrid_candidates",
    "c1_score_v2", "d8_exact_duplicates", "s5_osm_sequence",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    load()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    # The stores table is written once, as an ingest does; its cost is reported on its own.
    start = time.time()
    stored_places(spark, folder)
    times["load_places"] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
