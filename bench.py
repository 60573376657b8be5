"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query is planned and run to the end; every result column is produced and dropped. All
queries run once to load classes and compile, then once more for the figures.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paritas.queries import QUERIES  # noqa: E402
from paritas.session import local_session  # noqa: E402

HEADLINE = (
    "match_stats", "reconcile_full_outer", "matched_rows", "unmatched_rows", "execute_matching",
    "apply_rules", "execute_validation", "validation_details", "failing_duplicates",
    "agg_sum", "agg_first", "agg_median", "agg_composite_key", "describe_numeric",
    "describe_categorical", "topk_values", "seeded_sample", "dataset_fingerprint",
    "normalize_keys", "convert_values", "chunked_csv_union", "infer_types", "evaluate_mapping",
    "audit_report",
)


def run(name: str, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        run(name, spark, sf_dir)
    seconds = {name: round(run(name, spark, sf_dir), 3) for name in names}
    spark.stop()
    print(json.dumps({
        "metric": "total time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
