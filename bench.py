"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from quillstone.plans import queries as catalogue
from quillstone.plans.engine import session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = (
    "bm25_topk dense_topk binary_rescore rrf_fuse ir_metrics normalize_text dedup_first_wins dedup_merge sentence_split_v2 chunk_fixed_size chunk_fixed_tokens"
    " chunk_sentence_window chunk_parent_child latency_percentiles_linear latency_percentiles_rounded_rank session_windows tumbling_windows stage_sums guard_input"
).split()


def main() -> None:
    spark = session(f"local[{CPUS}]", int(CPUS) * 2)
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        catalogue.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
