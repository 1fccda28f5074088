"""Times the headline queries; prints one JSON line.

Each query runs once to the end, with every row and column computed, after one
small warm-up of the session.
"""

import json
import os
import sys
import time

from claimloom.plans.registry import all_queries
from claimloom.session import get_spark

HEADLINE = [
    "merge_summary", "source_union_merge", "url_dedup", "derived_columns", "resume_skip",
    "source_overlap", "uniqueness_count", "shifted_row_repair", "api_response_flatten",
    "extraction_dispatch", "landmark_profile", "article_frontier", "crawl_rule_filter",
    "corpus_line_cap", "ngram_counts", "top_phrases", "yake_term_scores",
    "yake_ranked_phrases", "query_seed_list", "incremental_claim_ingest",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = get_spark("bench", cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    known = all_queries()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        known[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
