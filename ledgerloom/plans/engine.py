"""The engine: one place that runs any output over a pair of canonical tables."""

from __future__ import annotations

import logging

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..metrics import Recorder
from ..model import (
    ERP_COMPARE_DISPLAY, LOOKUP_ERP_DISPLAY, LOOKUP_OA_DISPLAY, NO_RESULT, OA_COMPARE_DISPLAY, VARIANCE_DISPLAY, Direction, OutputKind, QueryFilters, QueryResult, QueryState, display,
)
from ..shared import cleared
from ..sinks import read_metadata, read_output, write_counted
from . import detail, dept_summary, doc_compare, lookup, strict

_log = logging.getLogger(__name__)


_HEADERS = {OutputKind.VARIANCE: VARIANCE_DISPLAY, OutputKind.OA_COMPARE: OA_COMPARE_DISPLAY, OutputKind.ERP_COMPARE: ERP_COMPARE_DISPLAY}


def _oa_first(kind: OutputKind, state: QueryState) -> bool:
    return kind is OutputKind.OA_COMPARE or (kind is OutputKind.VARIANCE and state.direction is Direction.FORWARD)


class ReconEngine:
    """Queries over one pair of sources. Results are lazy unless a message or a count is asked for.

    ``raw_oa`` and ``raw_erp`` (text columns) allow strict runs, which raise on cells they can't use.
    ``source_rows``, as file footers tell it, spares counting the sources.
    """

    def __init__(self, oa: DataFrame, erp: DataFrame, *, raw_oa: DataFrame | None = None, raw_erp: DataFrame | None = None, source_rows: int | None = None):
        self.oa, self.erp, self.raw, self._source_rows = oa, erp, (raw_oa, raw_erp), source_rows

    def source_rows(self) -> int:
        if self._source_rows is None:
            self._source_rows = self.oa.count() + self.erp.count()
        return self._source_rows

    def compare(self, kind: OutputKind, filters: QueryFilters | None = None) -> doc_compare.DocCompare:
        """P1 or P2; the direction has no say in either."""
        sides = (self.oa, self.erp) if kind is OutputKind.OA_COMPARE else (self.erp, self.oa)
        return doc_compare.compare_documents(*sides, filters)

    def rows(self, kind: OutputKind, state: QueryState | None = None, ordered: bool = True) -> DataFrame:
        state = state or QueryState()
        if kind is OutputKind.VARIANCE:
            return dept_summary.department_summary(self.oa, self.erp, state.direction, state.filters, ordered)
        return self.compare(kind, state.filters).summary(ordered)

    def write(self, kind: OutputKind, path: str, state: QueryState | None = None, *, strict_cells: bool = False, fmt: str = "parquet") -> QueryResult:
        """Run an output into its folder: rows are worked out, counted and written by one run, and stand there with their state.

        With no rows the folder stays as it was and the result has the message. The result's rows are those written.
        """
        state = state or QueryState()
        self._require_clean(kind, state, strict_cells)
        n = write_counted(display(self.rows(kind, state), _HEADERS[kind]), path, kind, state, fmt)
        counts = {"rows": n} | ({"source_rows": self._source_rows} if self._source_rows is not None else {})
        if not n:
            return QueryResult(None, NO_RESULT.format("OA" if _oa_first(kind, state) else "ERP"), counts)
        return QueryResult(read_output(self.oa.sparkSession, path, fmt), "", counts)

    def _require_clean(self, kind: OutputKind, state: QueryState, strict_cells: bool) -> None:
        if not isinstance(kind, OutputKind):
            raise ValueError(f"不支持的输出页类型：{kind}")
        if strict_cells and None not in self.raw:
            oa_first = _oa_first(kind, state)
            strict.require_clean(*(self.raw if oa_first else self.raw[::-1]), state.filters, "OA" if oa_first else "ERP")

    def run(self, kind: OutputKind, state: QueryState | None = None, *, strict_cells: bool = False, count_materials: bool = False) -> QueryResult:
        """Rows under display names, or the message for an empty result, with row counts.

        The rows are kept until the caller calls ``release`` on the result, so they are worked out once.
        """
        state = state or QueryState()
        self._require_clean(kind, state, strict_cells)
        rows = self.rows(kind, state).persist(StorageLevel.MEMORY_AND_DISK)  # counted here, read by the caller
        counts = {"source_rows": self.source_rows(), "rows": rows.count()}
        if not counts["rows"]:
            rows.unpersist()
            return QueryResult(None, NO_RESULT.format("OA" if _oa_first(kind, state) else "ERP"), counts)
        if kind is not OutputKind.VARIANCE and count_materials:
            counts["material_rows"] = self.compare(kind, state.filters).materials(False).count()
        return QueryResult(display(rows, _HEADERS[kind]), "", counts, rows)

    def expand(self, kind: OutputKind, doc_no: str, state: QueryState | None = None) -> DataFrame:
        """Item rows of one document of a compare, under its saved state."""
        return self.compare(kind, (state or QueryState()).filters).materials_of(doc_no)

    def expand_output(self, path: str, doc_no: str) -> DataFrame:
        """Item rows of one document of an output that was written before, under the state saved beside it."""
        found = read_metadata(self.oa.sparkSession, path)
        if found is None or found[0] not in (OutputKind.OA_COMPARE.value, OutputKind.ERP_COMPARE.value):
            raise ValueError(f"{path} holds no document compare")
        return self.expand(OutputKind(found[0]), doc_no, found[1])

    def details(self, direction: Direction = Direction.FORWARD, filters: QueryFilters | None = None) -> tuple[DataFrame, DataFrame]:
        """P6: detail rows and their roll-up."""
        rows = detail.detail_compare(self.oa, self.erp, direction, filters).rows()
        return rows, detail.detail_summary(rows)

    def lookup(self, mode: str, doc_no: str) -> QueryResult:
        found = lookup.lookup_document(self.oa, self.erp, mode, doc_no)
        if found.df is None:
            return QueryResult(None, found.message)
        return QueryResult(display(found.df, LOOKUP_OA_DISPLAY if mode == lookup.OA_MODE else LOOKUP_ERP_DISPLAY))

    def suggestions(self) -> dict[str, DataFrame]:
        return {"oa": lookup.lookup_suggestions(self.oa, lookup.OA_MODE), "erp": lookup.lookup_suggestions(self.erp, lookup.ERP_MODE)}

    def organisation_suggestions(self) -> dict[str, list[str]]:
        """Values for each filter field; nothing if the sources can't be read."""
        try:
            found = lookup.organisation_suggestions(self.oa, self.erp).collect()
        except Exception:  # noqa: BLE001 - suggestions are optional by contract
            _log.warning("organisations can't be read", exc_info=True)
            found = []
        return {c: [r.value for r in found if r.field == c] for c in ("company", "dept1", "dept2")}

    def diagnostics(self, state: QueryState | None = None) -> DataFrame:
        """Stages, capabilities and results of running all three outputs; writes nothing.

        Each stage reads the sources itself and is done with what it shuffled when it ends: neither copies of both sides
        nor the shuffles of all stages come to lie on disk together.
        """
        spark, state, record = self.oa.sparkSession, state or QueryState(), Recorder(self.oa.sparkSession)
        with cleared(spark):
            n_oa = record.measure("read_oa", lambda: self.oa.count())
            n_erp = record.measure("read_erp", lambda: self.erp.count())
            for kind in OutputKind:
                record.measure(kind.value, lambda kind=kind: self.rows(kind, state, ordered=False).count(), rows_in=(n_oa or 0) + (n_erp or 0))
        return record.frame(spark)

