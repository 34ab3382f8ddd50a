"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from veilscan.catalog import load
from veilscan.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
HEADLINE = (
    "scan_documents",
    "detect_all_documents",
    "detect_all_letters",
    "findings_letters",
    "report_totals",
    "report_by_category",
    "dedup_first",
    "dedup_groups",
    "prf_overview",
    "prf_by_extension",
    "prf_by_label",
    "src_html_text",
    "src_structured_rows",
    "src_json_open",
    "val_luhn",
    "stream_scan",
)


def main() -> None:
    spark = local_session(CPUS, "veilscan-bench")
    catalog = load()
    # start the JVM's code generation and the Python workers before the clock runs
    catalog["prf_by_group"].run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog[name].run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    scale = re.search(r"sf([0-9.]+)", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
