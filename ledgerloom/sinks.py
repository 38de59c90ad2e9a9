"""Writing outputs: rows and the kind and query state they came from, as one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import store
from .model import DIAGNOSTICS_DISPLAY, OUTPUT_NAMES, PRECHECK_DISPLAY, OutputKind, QueryResult, QueryState, display
from .operators.precheck import CLEAN

#: Kinds an older output may carry and still be replaced by a newer one.
LEGACY_KINDS = {"legacy_detail": OutputKind.VARIANCE.value}
# Names that the summary's output had before, the newest first.
LEGACY_NAMES = ("报废差异明细", "查询面板")


def read_metadata(spark: SparkSession, path: str) -> tuple[str, QueryState] | None:
    """(kind, state) of an output, None if there is none or it can't be trusted."""
    found = store.metadata(spark, path) or {}
    try:
        kind = found.get("kind")
        return (kind, QueryState.parse(found)) if kind in {k.value for k in OutputKind} | LEGACY_KINDS.keys() else None
    except ValueError:
        return None


def may_replace(found: tuple[str, QueryState] | None, kind: OutputKind) -> bool:
    """An output is replaced by its own kind only, or by the kind that took over a legacy one."""
    return found is not None and (found[0] == kind.value or LEGACY_KINDS.get(found[0]) == kind.value)


def _options(fmt: str) -> dict[str, str]:
    return {"header": "true"} if fmt == "csv" else {}


def _guard(spark: SparkSession, path: str, kind: OutputKind) -> None:
    where = store.current(spark, path)
    if where and not may_replace(read_metadata(spark, path), kind) and not store.Store(spark, path).empty(where):
        raise FileExistsError(f"{path} holds something else than {kind.value}")


def _meta(kind: OutputKind, state: QueryState | None) -> dict:
    return {"kind": kind.value, **(state or QueryState()).to_dict()}


def write_output(df: DataFrame, path: str, kind: OutputKind, state: QueryState | None = None, fmt: str = "parquet") -> None:
    """Write rows with their metadata; an existing folder that isn't this kind's output is left alone.

    Both become visible in one step: a write that fails, or is cut short, leaves the output as it was.
    """
    _guard(df.sparkSession, path, kind)
    store.replace(df, path, _meta(kind, state), fmt, _options(fmt))


def write_counted(df: DataFrame, path: str, kind: OutputKind, state: QueryState | None = None, fmt: str = "parquet") -> int:
    """:func:`write_output`, and how many rows there are, counted by the run that writes them; none leave the output as it was."""
    spark, seen = df.sparkSession, Observation("rows")
    _guard(spark, path, kind)
    staged = store.write_staged(df.observe(seen, F.count(F.lit(1)).alias("n")), path, fmt, _options(fmt))
    n = seen.get["n"]
    store.commit(spark, staged, path, _meta(kind, state)) if n else store.Store(spark, path).delete(staged)
    return n


def write_report(df: DataFrame, path: str, report: str, title: str, status: str | Callable[[], str] = "", headers: dict[str, str] | None = None, fmt: str = "parquet") -> None:
    """Write the rows of a precheck, lookup or diagnostics run under display names, with its title and status beside them.

    ``status`` may be worked out once the rows are written. A report is replaced by one of the same name only.
    """
    spark = df.sparkSession
    if store.current(spark, path) and (read_report(spark, path) or ("",))[0] != report:
        raise FileExistsError(f"{path} holds something else than {report}")
    meta = lambda: {"report": report, "title": title, "status": status() if callable(status) else status}
    store.replace(display(df, headers) if headers else df, path, meta, fmt, _options(fmt))


def read_report(spark: SparkSession, path: str) -> tuple[str, str, str] | None:
    """(name, title, status) of a report, None if there is none."""
    found = store.metadata(spark, path) or {}
    return (found["report"], found.get("title", ""), found.get("status", "")) if "report" in found else None


def read_output(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The rows of an output or report, also where a write was cut short."""
    return spark.read.format(fmt).options(**_options(fmt)).load(store.current(spark, path) or path)


# Title and status of the precheck's output.
PRECHECK_TITLE, PRECHECK_CLEAN, PRECHECK_FOUND = "报废差异预验证", "未发现预验证问题", "发现 {n} 条预验证问题"


def write_precheck(issues: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The issues of a precheck under their headers; its status tells how many there are.

    They are counted by the job that writes them; the row that tells of no issues isn't one.
    """
    seen = Observation("issues")
    counted = issues.observe(seen, F.count_if(F.col("issue_type") != CLEAN[5]).alias("n"))
    write_report(counted, path, "precheck", PRECHECK_TITLE, lambda: PRECHECK_FOUND.format(n=n) if (n := seen.get["n"]) else PRECHECK_CLEAN, PRECHECK_DISPLAY, fmt)


def write_lookup(found: QueryResult, path: str, fmt: str = "parquet") -> None:
    """The rows of a lookup; a number that is unknown writes nothing."""
    if found.df is not None:
        write_report(found.df, path, "lookup", "单据查询结果", found.message, fmt=fmt)


def write_diagnostics(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    write_report(rows, path, "diagnostics", "性能诊断", headers=DIAGNOSTICS_DISPLAY, fmt=fmt)


def output_paths(root: str) -> dict[OutputKind, str]:
    """The catalog of outputs: where each kind lies below a folder."""
    return {kind: f"{root.rstrip('/')}/{name}" for name, kind in OUTPUT_NAMES.items()}


def setup_outputs(spark: SparkSession, root: str) -> dict[OutputKind, str]:
    """The catalog with all its folders there: a summary under an older name gets its new one, what is missing is made, empty.

    A folder under an older name is left alone where the summary has one already.
    """
    paths, files = output_paths(root), store.Store(spark, root)
    summary = paths[OutputKind.VARIANCE]
    older = next((p for name in LEGACY_NAMES if files.exists(p := f"{root.rstrip('/')}/{name}")), None)
    if older and not store.current(spark, summary):
        files.rename(older, summary)
    for path in paths.values():
        if not store.current(spark, path):
            files.make(path)
    return paths


def error_frame(spark: SparkSession, message: str, label: str = "错误") -> DataFrame:
    """The one-row output of a failed query."""
    return spark.createDataFrame([(label, message)], "label string, message string")
