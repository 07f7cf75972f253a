"""Time the headline queries: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from recordloom import plans  # noqa: E402
from recordloom.session import build, drop_staged  # noqa: E402

HEADLINE = (
    "reconcile_totals", "join_inner", "join_salted", "join_outer_suffix", "group_sum_avg_min_max", "group_first_last",
    "dedupe_keep_first", "pivot_last_wins", "describe_columns", "median_exact", "row_number_dense", "row_number_within",
    "topk_per_group", "arith_floor_mod_round", "text_ops", "date_ops", "cast_number_text", "number_text", "flatten_nested",
    "explode_objects", "infer_schema_json", "observed_paths", "check_unique", "gate_fused", "contract_violations",
    "redact_documents", "csv_leading_zero", "json_round_trip", "table_upsert", "table_digest", "page_merge", "page_signals",
    "extract_completeness", "search_runs", "retention_by_count", "retention_by_size", "run_report", "outage_intervals",
    "latency_flatness", "moving_average_7", "trend_analysis", "word_frequency", "lexicon_sentiment",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
    }
    spark = build("bench", f"local[{cpus}]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    known = plans.queries()
    run = lambda name: known[name](spark, folder).write.format("noop").mode("overwrite").save()
    run("group_count")  # starts the JVM's own warm-up; not counted
    times = {}
    for name in wanted:
        start = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - start, 3)
        drop_staged(spark)
    total = round(sum(times.values()), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
