"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS, BENCH_QUERIES (comma separated, or all).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from quirework.plans import registry  # noqa: E402

HEADLINE = (
    "merge_dialogue", "clean_text", "paragraph_items", "merge_dialogue_aggressive",
    "drop_boilerplate", "leaf_blocks", "clean_section_items", "clean_section_html",
    "download_links", "book_slugs", "section_blocks", "html_documents", "markdown_documents",
    "page_estimate", "imposition_plan", "variant_fanout", "baseline_comparison", "run_report",
)


def spread(spark: SparkSession, folder: str, files: int) -> str:
    """The tables that the queries read, in ``files`` files each: the given ones have a single
    row group, which one task reads while the other cores wait. Not timed."""
    copy = tempfile.mkdtemp(prefix="bench-")
    for table in ("documents", "pages", "conversations", "embeddings"):
        spark.read.parquet(f"{folder}/{table}.parquet").repartition(files).write.parquet(f"{copy}/{table}.parquet")
    return copy


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder, name_of_sf = spread(spark, folder, int(cpus)), os.path.basename(folder.rstrip("/"))
    known = registry.queries()
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(known) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    seconds = {}
    for name in names:
        if name not in known:
            continue
        times = []
        for _ in range(runs + 1):  # the first one warms up
            start = time.perf_counter()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of headline queries (median of runs)",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": name_of_sf.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
