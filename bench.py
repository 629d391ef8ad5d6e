"""Headline queries, timed: one JSON line on standard output.

Each query runs in full and every output row is produced; only the rows are
not stored. The time is the better of two runs in a warm session; a first run
of more than 30 seconds is not repeated.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from glossweave.plans.catalog import QUERIES  # noqa: E402
from glossweave.session import build_session  # noqa: E402

HEADLINE = [
    "quality_by_source", "typed_entries", "validate_standard", "duplicate_texts", "upsert_entries", "raw_to_entries",
    "dump_all_senses", "html_entries", "stream_clean", "stream_chain", "phonetic_pairs", "nearest_words", "components", "pagerank",
    "layered_scores_balanced", "cognate_clusters", "lexical_difference_report", "assign_concepts", "vector_topk",
    "language_similarity", "tree_distance",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    timings = {}
    for name in sys.argv[1:] or HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
            if runs[0] > 30:
                break
        timings[name] = round(min(runs), 3)
    documents = spark.read.parquet(f"{sf}/documents.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": sf.rsplit("sf", 1)[-1],
        "entries_per_sec": {q: round(documents / timings[q]) for q in ("quality_by_source", "typed_entries", "stream_clean", "stream_chain") if q in timings},
    }))


if __name__ == "__main__":
    main()
