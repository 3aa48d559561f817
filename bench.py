"""Time the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line.

Each query runs once; its result goes to the no-op sink, so every row and column is computed and nothing is collected.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bookloom.session import build_session  # noqa: E402

HEADLINE = (
    "a2_read_text_corpus", "c10_split_chapters", "e6_chapter_stats", "c3_strip_ad_phrases", "c4_drop_adjacent_repeats",
    "b1_norm_title", "b21_strip_html", "b38_redact_secrets", "a7_extract_records", "h1_extract_toc", "h4_chapter_text",
    "d1_exact_title_lookup", "d2_fuzzy_title_join", "g4_rank_candidates", "g5_resolve", "g6_two_round_resolve",
    "f3_dedup_by_content", "f5_assign_unique_names", "f6_split_tiers", "f7_board_merge", "g11_pick", "g12_recommend",
    "g13_full_text_search", "e8_transfer_report", "e9_toc_tree_flatten", "d13_small_cover_upgrade", "a13_write_books",
    "i1_progress_stream", "i3_block_breaker", "i4_ttl_dedup",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    from bookloom.plans import QUERIES
    spark.read.parquet(f"{folder}/region.parquet").count()  # start the executors before the clock runs
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
