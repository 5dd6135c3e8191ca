"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "base_words", "pr1_numbers", "pr5_high_stakes", "pr19_repeated_phrase", "jn4_word_turn_overlap", "jn9_word_segment_asof",
    "jn13_cross_check", "jn16_already_processed", "wn4_merge_spans", "wn8_fill_speakers", "wn10_monologue_cut", "wn13_token_chunks",
    "ag14_separation", "jb1_assemble", "jb2_risky_spans", "jb4_guard", "jb6_name_speakers", "jb9_merge_parts", "jb10_sentences",
    "jb11_decisions", "jb12_tasks", "jb14_fidelity", "jb15_cluster_voices", "jb16_render", "sm1_latest_progress", "sm4_sessions",
]


def main() -> None:
    from groundledger import catalog
    from groundledger.session import session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    queries = catalog.queries()
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(queries)
    spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().collect()  # session start-up is not a query
    seconds: dict[str, float] = {}
    for name in names:
        t = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t, 3)
        print(name, seconds[name], file=sys.stderr)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
