"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from evigraph.plans import catalog  # noqa: E402
from evigraph.session import local_session  # noqa: E402

HEADLINE = [
    "edge_structure", "edge_rules", "graph_audit", "graph_metrics", "claim_rollup",
    "policy_decisions", "work_nodes", "faceted_search", "ranked_search", "cohorts",
    "candidate_duplicates", "duplicate_pairs", "person_linkage", "collaboration", "influence",
    "missing_edges", "candidate_suggestions", "reachable_depths", "contemporaries",
    "field_peers", "era_peers", "thread_gaps", "thread_junctions", "claim_changelog",
    "apply_repairs", "merge_edges", "coauthors", "text_keys", "roster_match", "near_misses",
    "merged_duplicates", "candidate_validation", "shortest_path", "link_suggestions",
    "collaboration_for", "influence_for", "missing_edges_for", "candidate_matches",
    "source_neighbor_counts", "parallel_development_counts",
    "import_review_audit", "record_conflicts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.all_queries()
    queries["edge_types"](spark, sf_dir).collect()  # start the session's threads
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
