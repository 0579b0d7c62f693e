"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from corpuslens.plans import catalog
from corpuslens.session import local_session

HEADLINE = [
    "validate_findings",
    "finding_fingerprints",
    "merge_findings",
    "category_scores",
    "history_delta",
    "parse_annotations",
    "split_windows",
    "run_detectors",
    "redact_text",
    "added_ranges",
    "compare_findings",
    "match_claims",
    "extract_imports",
    "resolve_imports",
    "keyword_index",
    "pack_batches",
    "select_by_risk",
    "validate_fields",
    "debounce",
    "sample_findings",
    "keyword_search",
    "related_chunks",
    "attach_context",
    "health_score",
    "dependency_cycles",
    "public_api",
    "detect_conflicts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    names = sys.argv[1:] or HEADLINE
    catalog.QUERIES["agent_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(8).repartition(8).mapInPandas(lambda it: it, "id long").count()
    times = {}
    for name in names:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
