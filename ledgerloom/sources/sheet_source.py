"""Sheets as a Spark data source: ``spark.read.format("sheets")``, one task a file, Arrow batches of the asked columns.

A file's header is looked for in its first rows; then only the asked columns are read, and every
row must have as many cells as the header. A file for which that fails, at whatever row, is read
as a whole instead, ragged rows and missing columns allowed, and the reason is kept; a file that
can't be read that way either gives no rows and its reason. No file stops the others.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator, Sequence
from contextlib import suppress
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.csv as pacsv
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .headers import LEAST_HITS, SCAN_ROWS, Header, detect_header

PRUNED, FULL, FAILED = "pruned_columns", "full_read_fallback", "failed"
ROWS_AT_ONCE = 10_000
# Fixed value: text of the reason.
SHAPE = "行列数不一致"
_PLACED = [("_file", pa.string()), ("_place", pa.int64()), ("_strategy", pa.string()), ("_reason", pa.string())]
_REPORT = [("file", pa.string()), ("strategy", pa.string()), ("reason", pa.string()), ("header_row", pa.int64()), ("n_rows", pa.int64()), ("n_columns", pa.int64())]
_DDL = {pa.string(): "string", pa.int64(): "bigint"}


class ShapeError(ValueError):
    """A row whose cells don't fit the header."""


@dataclass
class SheetFile(InputPartition):
    path: str


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class SheetReader(DataSourceReader):
    def __init__(self, options: dict[str, str], report: bool):
        self.path, self.report = options["path"], report
        self.required: list[str] = json.loads(options.get("required", "[]"))
        self.least, self.scan = int(options.get("least", LEAST_HITS)), int(options.get("scan", SCAN_ROWS))
        self.separator = options.get("sep", ",")

    def partitions(self) -> Sequence[InputPartition]:
        store, at = _store(self.path)
        found = store.get_file_info(fs.FileSelector(at, recursive=True)) if store.get_file_info(at).type == fs.FileType.Directory else [store.get_file_info(at)]
        hidden = lambda p: any(part.startswith(("_", ".")) for part in p.removeprefix(at).split("/") if part)
        return [SheetFile(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and not hidden(f.path)]

    def _open(self, path: str, errors: str = "strict") -> io.TextIOWrapper:
        store, _ = _store(self.path)
        return io.TextIOWrapper(io.BufferedReader(store.open_input_stream(path)), "utf-8-sig", errors, newline="")

    def _header(self, path: str) -> Header:
        with self._open(path, "replace") as stream:  # what comes after the first rows is judged when it is read
            return detect_header(list(islice(csv.reader(stream, delimiter=self.separator), self.scan)), self.required, least=self.least, first_row=1)

    def _pruned(self, path: str, header: Header) -> Iterator[tuple[int, dict[str, pa.Array]]]:
        """(first place, asked columns) of batches below the header; raises where a row has another width."""
        if missing := header.missing(self.required):
            raise LookupError(f"缺失字段：{'、'.join(missing)}")
        with self._open(path, "replace") as stream:  # lines up to the header; quoted line ends there count as one row each
            reader = csv.reader(stream, delimiter=self.separator)
            above = sum(1 for _ in islice(reader, header.row + 1)) and reader.line_num
        names = [f"c{i}" for i in range(len(header.cells))]
        store, _ = _store(self.path)

        asked = {h: names[header.index[h]] for h in self.required}
        given = (
            pacsv.ReadOptions(column_names=names, skip_rows=above, use_threads=False, block_size=4 << 20),
            pacsv.ParseOptions(delimiter=self.separator, ignore_empty_lines=False, newlines_in_values=True),
            pacsv.ConvertOptions(include_columns=list(asked.values()), column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False, quoted_strings_can_be_null=False),
        )
        place = header.row + 1
        try:
            for batch in pacsv.open_csv(store.open_input_stream(path), *given):
                yield place, {h: batch.column(c) for h, c in asked.items()}
                place += batch.num_rows
        except pa.ArrowInvalid as e:
            raise ShapeError(f"{SHAPE}：{e}") from e

    def _whole(self, path: str, header: Header) -> Iterator[tuple[int, dict[str, pa.Array]]]:
        """The same of ragged rows; cells that a row or the header lacks are null."""
        with self._open(path) as stream:
            rows, place = islice(csv.reader(stream, delimiter=self.separator), header.row + 1, None), header.row + 1
            while batch := list(islice(rows, ROWS_AT_ONCE)):
                cell = lambda row, h: row[i] if (i := header.index.get(h, -1)) >= 0 and i < len(row) else None
                yield place, {h: pa.array([cell(r, h) for r in batch], pa.string()) for h in self.required}
                place += len(batch)

    def _plan(self, path: str) -> tuple[str, str, Header | None, int]:
        """How the file is read, why, and how many rows it has: it is gone through once before any row is given away, so a
        failure late in the file leaves nothing half read."""
        size = lambda batches: sum(len(next(iter(columns.values()))) if columns else 0 for _, columns in batches)
        try:
            header = self._header(path)
        except Exception as e:  # noqa: BLE001 - whatever a file holds is told by its reason
            return FAILED, str(e), None, 0
        try:
            return PRUNED, "", header, size(self._pruned(path, header))
        except Exception as e:  # noqa: BLE001
            reason = str(e)
        try:
            return FULL, reason, header, size(self._whole(path, header))
        except Exception as e:  # noqa: BLE001
            return FAILED, str(e), header, 0

    def read(self, partition: SheetFile) -> Iterator[pa.RecordBatch]:
        path = partition.path
        strategy, reason, header, n = self._plan(path)
        if self.report:
            values = (path, strategy, reason, None if header is None else header.row + 1, n, None if header is None else len(header.cells))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, _REPORT, strict=True)], schema=pa.schema(_REPORT))
            return
        if strategy == FAILED:
            return
        schema = pa.schema([(h, pa.string()) for h in self.required] + _PLACED)
        for place, columns in (self._pruned if strategy == PRUNED else self._whole)(path, header):
            size = len(next(iter(columns.values())))
            placed = [pa.array([path] * size), pa.array(range(place, place + size), pa.int64()), pa.array([strategy] * size), pa.array([reason] * size)]
            yield pa.RecordBatch.from_arrays([*columns.values(), *placed], schema=schema)


class SheetSource(DataSource):
    """Options: ``path`` of a file or folder, ``required`` headers as a JSON list, ``report`` for one row a file instead of
    its rows; ``sep``, ``least`` and ``scan`` as in header detection."""

    @classmethod
    def name(cls) -> str:
        return "sheets"

    @property
    def _report(self) -> bool:
        return self.options.get("report", "false").lower() == "true"

    def schema(self) -> str:
        fields = _REPORT if self._report else [(h, pa.string()) for h in json.loads(self.options.get("required", "[]"))] + _PLACED
        return ", ".join(f"`{n}` {_DDL[t]}" for n, t in fields)

    def reader(self, schema) -> DataSourceReader:
        return SheetReader(self.options, self._report)


def read_sheet_files(spark: SparkSession, path: str, required: dict[str, str], **options: str) -> tuple[DataFrame, DataFrame]:
    """(rows, report): raw canonical columns of every sheet that can be read, with _ord, row_label, and how each file was read."""
    from pyspark.sql import functions as F

    with suppress(Exception):  # registered before
        spark.dataSource.register(SheetSource)
    reader = spark.read.format("sheets").options(path=path, required=json.dumps(list(required.values()), ensure_ascii=False), **options)
    rows = reader.load().select(
        F.struct(F.col("_file").alias("file"), F.col("_place").alias("place")).alias("_ord"), *(F.col(f"`{h}`").alias(c) for c, h in required.items()), (F.col("_place") + 1).cast("string").alias("row_label"), "_file", "_strategy", "_reason"
    )
    return rows, reader.option("report", "true").load()
