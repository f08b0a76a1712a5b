"""Times headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose input and threads."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lexloom.session import local_session  # noqa: E402

HEADLINE = [
    "norm_list_search", "norm_detail_nested", "clause_path_depth", "hierarchy_parents", "event_assembly", "reference_resolution",
    "consolidated_text", "vector_topk", "rag_context_budget", "session_cards", "upsert_norms", "text_clean",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "10g", "bench")
    spark.sparkContext.setLogLevel("ERROR")
    from lexloom.plans.queries import QUERIES

    QUERIES["status_histogram"](spark, sf_dir).collect()  # starts the session up
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
