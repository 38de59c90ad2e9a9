"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with the median warm seconds of each.

``gen200k_*`` run over the generator's 200,000 requests (420,000 source rows), the scale for which
the baseline states row-building times. Cold seconds stand beside the warm ones. The other queries
read the canonical tables that the first of them writes, so its cold seconds hold that too.

``--scale default`` (10k and 50k), ``--scale stress`` (200k with them) or ``--scale N`` runs the three
outputs over the generator alone, once each as the baseline does, and prints their stages as a table;
``--no-json`` leaves out the file bench-results/latest.json that it writes otherwise.
"""

from __future__ import annotations

import argparse
import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.metrics import Recorder
from ledgerloom.model import Direction
from ledgerloom.plans.dept_summary import department_summary
from ledgerloom.plans.doc_compare import compare_documents
from ledgerloom.queries import QUERIES
from ledgerloom.sources.generator import dataset_name, generate_erp, generate_oa

HEADLINE = ("dept_variance_oa", "dept_variance_erp", "oa_doc_compare_summary", "erp_doc_compare_summary", "oa_doc_compare_material", "detail_forward", "detail_reverse", "precheck_all", "lookup_suggestions_oa")
RUNS = 3


def _run(df: DataFrame) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


SCALES = {"default": (10_000, 50_000), "stress": (10_000, 50_000, 200_000)}


def scales_of(text: str) -> tuple[int, ...]:
    if text in SCALES:
        return SCALES[text]
    if not text.isdigit() or not int(text):
        raise argparse.ArgumentTypeError("default, stress or a positive whole number")
    return (int(text),)


def generated(spark: SparkSession, n: int) -> dict:
    return {
        "variance_summary": lambda oa=generate_oa(spark, n), erp=generate_erp(spark, n): department_summary(oa, erp, Direction.FORWARD),
        "oa_doc_compare": lambda oa=generate_oa(spark, n), erp=generate_erp(spark, n): compare_documents(oa, erp).summary(),
        "erp_doc_compare": lambda oa=generate_oa(spark, n), erp=generate_erp(spark, n): compare_documents(erp, oa).summary(),
    }


def by_scale(spark: SparkSession, scales: tuple[int, ...], write: bool) -> None:
    """Stages of the three outputs at each scale: a table on standard error, and a file."""
    report = []
    for n in scales:
        record = Recorder(spark)
        for name, make in generated(spark, n).items():
            record.measure(name, lambda make=make: make().count(), rows_in=n + n * 11 // 10)
        report.append({"dataset": dataset_name(n), "total_ms": record.total_ms(), "most_memory_mb": record.most_memory_mb(), "stages": [vars(s) for s in record.stages]})
        for s in record.stages:
            print(f"{dataset_name(n):>8} {s.name:<18} {s.rows_in:>9} {s.rows_out:>9} {s.ms:>10.1f} ms", file=sys.stderr)
        print(f"{dataset_name(n):>8} {'total':<18} {record.total_ms():>30.1f} ms", file=sys.stderr)
    if write:
        path = Path("bench-results/latest.json")
        path.parent.mkdir(exist_ok=True)
        path.write_text(json.dumps(report, indent=1, ensure_ascii=False))


def main() -> None:
    options = argparse.ArgumentParser(description=__doc__)
    options.add_argument("--scale", type=scales_of)
    options.add_argument("--no-json", action="store_true")
    given = options.parse_args()
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", os.environ.get("BENCH_PARTITIONS", cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if given.scale:
        by_scale(spark, given.scale, not given.no_json)
        return spark.stop()
    oa, erp = generate_oa(spark, 200_000), generate_erp(spark, 200_000)
    todo = {q: (lambda q=q: QUERIES[q](spark, sf)) for q in HEADLINE}
    todo |= {
        "gen200k_dept_variance": lambda: department_summary(oa, erp, Direction.FORWARD, ordered=False),
        "gen200k_oa_doc_compare": lambda: compare_documents(oa, erp).summary(ordered=False),
        "gen200k_erp_doc_compare": lambda: compare_documents(erp, oa).summary(ordered=False),
    }
    warm, cold = {}, {}
    for name, make in todo.items():
        seconds = [_run(make()) for _ in range(RUNS + 1)]
        cold[name], warm[name] = round(seconds[0], 3), round(statistics.median(seconds[1:]), 3)
        print(f"{name}: cold {cold[name]} warm {warm[name]}", file=sys.stderr)
    print(json.dumps({"metric": "sum of median warm seconds of the headline queries", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "sf": sf, "cpus": int(cpus), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
