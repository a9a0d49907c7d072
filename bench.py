"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidewell.catalog import analysis, parsing
from tidewell.session import local_session

HEADLINE = [
    "drop_reasons_by_source", "snapshot_merge", "near_dup_components", "published_rows", "anchor_candidates", "deadline_roundtrip",
    "script_feed", "longest_name_match", "fuzzy_link", "import_anti", "canon_collapse", "outage_runs", "registry_fill", "lifecycle_table",
    "include_exclude_sections", "duty_evidence", "exact_dedup", "word_weights", "budget_topn", "fresh_profile_join",
    "tfidf_terms", "sibling_bundle", "relevance_score", "weighted_scores",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    catalogue = {**parsing.QUERIES, **analysis.QUERIES}
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalogue[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
