"""Time the headline queries on one folder of test tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from casetable.drills import all_queries  # noqa: E402
from casetable.session import local_session  # noqa: E402

HEADLINE = [
    "B1_assign_ids", "D3_explode_cases", "D6_split_corpus_solutions", "D9_flag_vector_field",
    "E0g_parse_memory_limit", "E0l_replace_literals", "E0m_replace_words", "E1_semi_by_id", "E2_resume_anti",
    "E4_overlay_update", "E6_key_coverage", "E8_pair_runs_by_tag", "E9_first_filled_rows", "E10_execution_grid",
    "E12_scatter_vector", "F2_describe_column_lines", "F4_histogram_lines", "F5_all_pass", "F6_first_passing",
    "F7_validated_problems", "F8_stop_at_failure", "F9_verdicts", "F13_zero_groups", "F14_recheck_rows",
    "F15_score_rows", "F17_change_pairs", "F20_tag_drift", "F21_row_diff", "F24_set_score_large",
    "F27_metric_table", "F32_contract_check", "G2_dedup_first", "G6_chunk_rows_by_range", "G8_running_totals",
    "G9_every_n_summary", "H1_render_requests", "I2_stream_append_once",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("casetable-bench", os.environ.get("BENCH_CPUS", "8"))
    queries = all_queries()
    names = list(queries) if os.environ.get("BENCH_ALL") else HEADLINE
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the JVM
    times = {}
    for name in names:
        best = None
        for _ in range(int(os.environ.get("BENCH_RUNS", "2"))):
            at = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - at
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({
        "metric": "headline queries, best of runs, summed", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
