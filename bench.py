"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lexmill.plans import all_queries
from lexmill.session import get_spark

HEADLINE = (
    "a1_document_frequency_idf", "a2_tfidf_cosine_top10", "t2_bm25_top10", "a13_hit_rate_mrr", "a9_reciprocal_rank_fusion",
    "t3_two_stage_funnel", "w2_diversify_per_document", "p1_row_level_security", "t2_bm25_under_access_rules",
    "a7_word_cooccurrence", "a8_bigram_successors", "j1_exact_nearest_neighbours", "a15_recall_sweep",
    "f3_normalise_text", "f4_injection_risk_documents", "f9_pii_masking", "f11_secret_redaction",
    "f18_fixed_windows", "f20_sentence_packing_with_overlap", "f22_semantic_chunks", "s8_idempotent_upsert",
    "u3_first_wins_dedup", "a24_triage_summary", "a26_latency_percentiles", "a28_alert_rules", "w7_for_duration_alert",
    "w9_cold_start_storm", "w10_sticky_degradation", "st4_rate_limit_batch", "st1_windowed_latency_metrics", "st4_rate_limit_on_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = get_spark(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
