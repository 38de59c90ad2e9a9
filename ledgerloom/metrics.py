"""Stage times, row counts and memory of a run, as rows of the diagnostics output."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.exprs import cell_safe_note
from .model import DIAGNOSTICS_DISPLAY, NOT_APPLICABLE, UNKNOWN


@dataclass
class Stage:
    name: str
    rows_in: int | None
    rows_out: int | None
    ms: float
    memory_mb: float | None
    note: str


def jvm_heap_mb(spark: SparkSession) -> float | None:
    """Used heap of the driver's JVM, None where it can't be read."""
    try:
        runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()  # noqa: SLF001
        return (runtime.totalMemory() - runtime.freeMemory()) / 1e6
    except Exception:  # noqa: BLE001 - e.g. a remote session without a gateway
        return None


def executor_peaks(spark: SparkSession) -> list[tuple[str, float | None]]:
    """(executor, peak heap in MB) of the driver and every executor, as they last reported; nothing where that can't be read."""
    try:
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)  # noqa: SLF001
        each = [found.apply(i) for i in range(found.size())]
        peak = lambda e: e.peakMemoryMetrics().get().getMetricValue("JVMHeapMemory") / 1e6 if e.peakMemoryMetrics().isDefined() else None
        return sorted((e.id(), peak(e)) for e in each)
    except Exception:  # noqa: BLE001 - e.g. a remote session without a gateway
        return []


def capabilities(spark: SparkSession) -> list[tuple[str, str]]:
    conf = spark.conf
    return [("spark", spark.version), ("shuffle_partitions", conf.get("spark.sql.shuffle.partitions")), ("adaptive", conf.get("spark.sql.adaptive.enabled")), ("time_zone", conf.get("spark.sql.session.timeZone"))]


class Recorder:
    """Runs stages one by one. A stage that fails leaves its row, then its error goes on."""

    def __init__(self, spark: SparkSession):
        self.spark, self.stages = spark, []

    def measure(self, name: str, run: Callable[[], object], rows_in: int | None = None) -> object:
        before, began, note, out = jvm_heap_mb(self.spark), time.perf_counter(), "", None
        try:
            out = run()
            return out
        except Exception as e:
            note = str(e)
            raise
        finally:
            after = jvm_heap_mb(self.spark)
            rows = out if isinstance(out, int) else None
            delta = None if before is None or after is None else round(after - before, 2)
            self.stages.append(Stage(name, rows_in, rows, round(1000 * (time.perf_counter() - began), 2), delta, note))

    def frame(self, spark: SparkSession) -> DataFrame:
        known = lambda v: UNKNOWN if v is None else str(v)
        rows = [("运行时能力", n, *[NOT_APPLICABLE] * 4, v) for n, v in capabilities(spark)]
        rows += [("阶段耗时", s.name, known(s.rows_in), known(s.rows_out), str(s.ms), known(s.memory_mb), s.note) for s in self.stages]
        rows += [("执行器内存", name, *[NOT_APPLICABLE] * 3, known(None if peak is None else round(peak, 2)), "") for name, peak in executor_peaks(spark)]
        df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in DIAGNOSTICS_DISPLAY))
        return df.withColumn("note", cell_safe_note(F.col("note")))

    def total_ms(self) -> float:
        return round(sum(s.ms for s in self.stages), 2)

    def most_memory_mb(self) -> float | None:
        return max((s.memory_mb for s in self.stages if s.memory_mb is not None), default=None)
