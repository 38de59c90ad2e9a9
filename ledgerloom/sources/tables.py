"""Reading source tables: raw matrices, files by format, pruning to the contract's columns, typing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.exprs import norm_text, number_text, serial_date, text_date, text_decimal
from ..model import CANONICAL
from .headers import SCAN_ROWS, Header, detect_header, row_label
from .sheets import numbered_rows


@dataclass(frozen=True)
class TableMeta:
    """How a table was read."""

    headers: tuple[str, ...]
    header_row: str
    strategy: str
    fallback_reason: str = ""


def matrix_frame(spark: SparkSession, rows: Sequence[Sequence[object]]) -> DataFrame:
    """(_ord, cells array<string>) of a matrix held by the caller; ragged rows are fine."""
    from ..functions.values import plain_text

    return spark.createDataFrame([(i, [None if c is None else plain_text(c) for c in row]) for i, row in enumerate(rows)], "_ord long, cells array<string>")


def has_content(matrix: DataFrame) -> bool:
    """Whether any cell of a matrix holds text."""
    return not matrix.filter(F.exists("cells", lambda c: norm_text(c) != "")).limit(1).isEmpty()


def find_header(matrix: DataFrame, required: Sequence[str], *, first_row: int | None = None, least: int = 5) -> Header:
    """The header of a (_ord, cells) matrix, from its first rows only. They are found by their order; no other row's cells
    are worked out."""
    last = matrix.select("_ord").orderBy("_ord").limit(SCAN_ROWS).agg(F.max("_ord")).first()[0]
    first = [] if last is None else matrix.filter(F.col("_ord") <= F.lit(last)).orderBy("_ord").limit(SCAN_ROWS).collect()
    return detect_header([r.cells for r in first], required, least=least, first_row=first_row)


def parse_table(matrix: DataFrame, required: dict[str, str], *, first_row: int | None = None, prune: bool = True) -> tuple[DataFrame, TableMeta]:
    """Rows below the header: _ord, row_label and a text column for each header.

    ``required`` maps canonical columns to headers; with ``prune`` only those are kept, under
    canonical names, and those that the header lacks are null. Columns without a header are
    skipped, of repeated other headers the last counts, and rows without any text are dropped.
    """
    header = find_header(matrix, list(required.values()), first_row=first_row)
    body = matrix.filter(F.col("_ord") > header.row)
    label = F.concat(F.lit(""), (F.col("_ord") + first_row).cast("string")) if first_row is not None else F.concat(F.lit("相对 UsedRange 第 "), (F.col("_ord") + 1).cast("string"), F.lit(" 行"))
    named = {h: i for i, h in enumerate(header.cells) if h} | header.index
    filled = body.filter(reduce(or_, (norm_text(F.get("cells", F.lit(i))) != "" for i in named.values()), F.lit(False)))  # ends at a row's first text
    cell = lambda h: F.get("cells", F.lit(named[h])) if h in named else F.lit(None).cast("string")
    columns = [cell(h).alias(c) for c, h in required.items()] if prune else [cell(h).alias(h) for h in named]
    return filled.select("_ord", label.alias("row_label"), *columns), TableMeta(header.cells, row_label(header.row, first_row), "matrix")


class EmptyTableError(ValueError):
    """A table that isn't there, or holds no text at all."""


def _loaded(spark: SparkSession, path: str, fmt: str, options: dict[str, str] | None) -> DataFrame:
    reader = spark.read.format(fmt)
    for key, value in (({"header": "true"} if fmt == "csv" else {}) | (options or {})).items():
        reader = reader.option(key, value)
    return reader.load(path)


def read_full(spark: SparkSession, path: str, *, name: str = "", fmt: str = "parquet", options: dict[str, str] | None = None) -> DataFrame:
    """A whole table, all columns; raises with the table's name if there is none or no cell of it holds text."""
    name = name or path
    try:
        df = _loaded(spark, path, fmt, options)
    except AnalysisException as e:
        raise EmptyTableError(f"{name}：{e.getMessage() or e}") from e
    filled = [norm_text(F.col(f"`{c}`").cast("string")) != "" for c in df.columns]
    if not filled or df.filter(reduce(or_, filled)).limit(1).isEmpty():
        raise EmptyTableError(f"{name}：没有可读取的数据")
    return df


#: Lines of a file above its first row, by format.
_LINES_ABOVE = {"csv": 1}


def _numbered(df: DataFrame, columns: list[Column], fmt: str, order: str | None) -> DataFrame:
    """``columns`` with the rows' order and label. Rows of files go by file and place in it, and are called by the
    sheet's row number, below one header row if the format has one, with the file's name where there are several.
    Blank lines of CSV files don't count. Formats whose rows have no place have no number unless a column gives it."""
    if order:
        return df.select(F.col(f"`{order}`").cast("long").alias("_ord"), *columns, F.col(f"`{order}`").cast("string").alias("row_label"))
    file, place, alone = F.col("_metadata.file_path"), F.col("_metadata.row_index"), len(df.inputFiles()) < 2
    if fmt in ("csv", "json", "text"):
        df, file, place = numbered_rows(df, columns), F.col("_file"), F.col("_place")
        columns = [F.col(c) for c in df.columns if c not in ("_file", "_place")]
    elif fmt != "parquet":
        return df.select(F.monotonically_increasing_id().alias("_ord"), *columns, F.lit("").alias("row_label"))
    number = (place + 1 + (1 if fmt == "parquet" else _LINES_ABOVE.get(fmt, 0))).cast("string")
    label = F.when(F.lit(alone), number).otherwise(F.concat(F.element_at(F.split(file, "/"), -1), F.lit(":"), number))
    return df.select(F.struct(file.alias("file"), place.alias("place")).alias("_ord"), *columns, label.alias("row_label"))


def read_table(spark: SparkSession, path: str, required: dict[str, str], *, name: str = "", fmt: str = "parquet", order: str | None = None, options: dict[str, str] | None = None) -> tuple[DataFrame, TableMeta]:
    """A file table in raw canonical columns (any order, extra columns never leave the scan).

    Files whose columns carry the headers are pruned to them. If that fails for any reason, such as
    a missing header, the whole table is read, which must hold something, and the reason is recorded;
    missing columns are then null. ``order`` names a column of whole numbers that gives the rows their
    order and their numbers; see :func:`_numbered` for tables without one.
    """

    def picked(df: DataFrame, strict: bool) -> DataFrame:
        names = {norm: c for c in df.columns if (norm := c.strip())}
        if strict and (missing := [h for h in required.values() if h not in names]):
            raise LookupError(f"缺失字段：{'、'.join(missing)}")
        columns = [(F.col(f"`{names[h]}`") if h in names else F.lit(None).cast("string")).alias(c) for c, h in required.items()]
        return _numbered(df, columns, fmt, order)

    try:
        df = _loaded(spark, path, fmt, options)
        return picked(df, True), TableMeta(tuple(df.columns), "1", "pruned_columns")
    except (LookupError, AnalysisException) as e:
        df = read_full(spark, path, name=name, fmt=fmt, options=options)
        return picked(df, False), TableMeta(tuple(df.columns), "1", "full_read_fallback", str(e.args[0] if isinstance(e, LookupError) else e))


def dimensions(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_rows, n_columns, n_bytes) of every Parquet file, from footers that tasks read; no row is.

    Files that are no Parquet files have null rows and columns.
    """
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    ddl = "file string, n_rows long, n_columns int, n_bytes long"

    def footers(batches):
        for batch in batches:
            found = []
            for file in batch.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(file if "://" in file else "file://" + file.removeprefix("file:"))
                try:
                    with store.open_input_file(at) as f:
                        meta = pq.read_metadata(f)
                    found.append((meta.num_rows, len(meta.schema.to_arrow_schema())))
                except pa.ArrowInvalid:
                    found.append((None, None))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([n for n, _ in found], pa.int64()), pa.array([c for _, c in found], pa.int32()), batch.column("length")], ["file", "n_rows", "n_columns", "n_bytes"])

    return spark.read.format("binaryFile").load(path).select("path", "length").mapInArrow(footers, ddl)


def canonical(raw: DataFrame) -> DataFrame:
    """Typed canonical columns of a raw table: trimmed texts, dates, decimals; malformed cells are null.

    Dates may be texts, sheet day numbers, dates or timestamps; numeric ids lose their fraction.
    Blank quantities and amounts are zero. ``_ord`` and ``row_label`` stay.
    """
    kinds = {f.name: f.dataType for f in raw.schema.fields}

    def text(c: str):
        return number_text(F.col(c)) if isinstance(kinds[c], NumericType) and kinds[c].typeName() in ("double", "float") else norm_text(F.col(c))

    day = F.col("doc_date")
    kind = kinds["doc_date"].typeName()
    date = serial_date(day) if isinstance(kinds["doc_date"], NumericType) else day.cast("date") if kind in ("date", "timestamp", "timestamp_ntz") else text_date(day)
    number = lambda c: F.coalesce(F.col(c).try_cast("decimal(28,10)"), F.lit(0).cast("decimal(28,10)")) if isinstance(kinds[c], NumericType) else text_decimal(F.col(c))
    columns = {c: F.coalesce(text(c), F.lit("")) for c in CANONICAL if c not in ("doc_date", "qty", "amount")} | {"doc_date": date, "qty": number("qty"), "amount": number("amount")}
    return raw.select(*(columns[c].alias(c) for c in CANONICAL), "_ord", *(["row_label"] if "row_label" in kinds else []))


__all__ = ["EmptyTableError", "TableMeta", "canonical", "dimensions", "find_header", "has_content", "matrix_frame", "parse_table", "read_full", "read_table"]
