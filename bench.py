"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tariffloom.session import local_session  # noqa: E402
from tariffloom.workloads import all_workloads  # noqa: E402

HEADLINE = (
    "flagship_recompute", "rule_copay", "identity_blame", "five_value_blame", "limit_lookup", "duplicates_later",
    "growth", "generate_basic", "generate_payment", "validate_basic", "validate_payment", "segment_tables", "value_drift",
    "anchor_unique", "label_normalize", "hybrid_match", "notice_amounts", "extract_constants", "workbook_scan",
    "reconcile_spellings", "edits_latest", "repair_fixpoint", "stream_edits",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    names = sys.argv[1:] or HEADLINE
    loads = all_workloads()
    loads["flagship_recompute"].build(spark, sf).write.format("noop").mode("overwrite").save()  # warm up the JVM
    times = {}
    for name in names:
        start = time.perf_counter()
        loads[name].build(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    # suppliers are the documents: each has 950 basic rows, 949 of them payable, times 25 services
    documents = spark.read.parquet(f"{sf}/supplier.parquet").count()
    per_document = {"validate_payment": ("payment_rows_per_s", 949 * 25), "validate_basic": ("basic_rows_per_s", 950), "notice_amounts": ("notices_per_s", 1)}
    rates = {rate: round(documents * n / times[name]) for name, (rate, n) in per_document.items() if times.get(name)}
    if times.get("hybrid_match"):  # every label of last year against every label of its block
        from tariffloom.workloads.matching import part_labels

        sides = [side.groupBy("block").count().withColumnRenamed("count", n) for side, n in zip(part_labels(spark, sf), ("old", "new"), strict=True)]
        pairs = sides[0].join(sides[1], "block").selectExpr("sum(old * new) as n").first()["n"]
        rates["label_pairs_per_s"] = round(pairs / times["hybrid_match"])
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rates": rates, "sf": Path(sf).name}))


if __name__ == "__main__":
    main()
