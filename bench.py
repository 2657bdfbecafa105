"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from gustline.plans import QUERIES
from gustline.session import build_session

HEADLINE = (
    "daily_summary", "day_completeness", "gap_list", "gap_rows", "gap_fill", "retime_repair", "audit_repair",
    "highwater_accept", "change_only", "backwards_rows", "rollover_segments", "plateau_flag", "latest_per_key",
    "nth_row", "source_fallback", "enrich_left", "new_content_anti", "consecutive_dup", "any_dup", "page_links",
    "section_text", "combine_range", "split_day_manifest", "union_history", "time_parse", "canonical_projection",
    "html_fragment", "xml_parse", "stream_highwater", "stream_tumbling",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="gustline-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        took = []
        for attempt in range(runs + 1):
            start = time.perf_counter()
            # every column is computed and nothing is brought to the driver
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took), 3)
    total = round(sum(seconds.values()), 3)
    scale = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    result = {"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": scale}
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
