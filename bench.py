"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

from shiftlens import get_session
from shiftlens.plans import load

HEADLINE = [
    "segment_compare_channel",
    "compare_summary_limit_band",
    "profile_all_dimensions",
    "rate_matrix",
    "anomaly_scan",
    "chi_square_city",
    "psi_late",
    "psi_unrounded",
    "performance",
    "grouped_auc_channel",
    "auc_ks_unrounded",
    "importance",
    "attribution_compare",
    "entity_reasons",
    "quality_check",
    "domain_findings_loans",
    "stratified_split",
    "assigned_rate_matrix",
    "sections_documents",
    "bm25_scores",
    "dense_scores",
    "hybrid_search",
    "ungrounded_numbers",
    "graded_answers",
    "system_summary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="shared-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()
    queries["cohort_rate_all"].run(spark, folder).collect()
    took = {}
    for name in names:
        start = time.perf_counter()
        queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
