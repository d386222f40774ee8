"""Times the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [names...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from docketry.registry.queries import QUERIES
from docketry.session import build_session

HEADLINES = (
    "a1_summary", "pack_all_fields", "f1_regex", "f2_nearest_word_array",
    "f2_nearest_word_join", "f3_section", "f6_fuzzy_date", "f7_contextual", "f8_multi_pattern",
    "f9_multi_date", "f10_emails", "f10_emails_documents", "c1_batch_trigger",
    "c3_fuzzy_trigger_documents", "n1_normalize_text", "n2_lines", "s4_page_concat",
    "r5_mapping_build", "r7_mapping_suffix", "r8_update_batch", "r9_update_individual",
    "a4_download_stats", "a6_job_list", "e1_batch_run", "t1_stream_extraction", "t3_stream_jobs",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    seconds = {}
    for name in sys.argv[1:] or HEADLINES:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
