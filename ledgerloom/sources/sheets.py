"""Folders of sheets kept as CSV or text: every file has its own title rows, header and column order.

All files are read in one job. Spark numbers no rows of such files, so a row's place in its file
is worked out from the blocks it is read in: a row's distance from its block's first row, and the
rows of the blocks before. The first rows of each file are scored in one aggregation by file; what
is found goes back to that file's blocks, and each row takes its cells from where its own file has
them. Files without a usable header become issues and their rows are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import norm_text
from ..shared import scratch
from .headers import AMBIGUOUS, AMBIGUOUS_TEXT, LEAST_HITS, NOT_FOUND, NOT_FOUND_TEXT, REPEATED, REPEATED_TEXT, SCAN_ROWS

#: Columns that a sheet may have; wider rows are reported, not cut silently.
MOST_COLUMNS = 256
#: Blocks up to which their numbers are broadcast: about 40 MB; beyond that rows are joined by file and block.
MOST_BLOCKS = 100_000

# Texts of issues.
TOO_WIDE, TOO_WIDE_TEXT = "列数超出", "该行超过 {n} 列，超出部分未读取。"

_PLACE = ("_file", "_block", "_at")


def located(df: DataFrame, columns: Sequence[Column | str]) -> DataFrame:
    """Columns of a scan, with the file and block of each row and a number that grows within the block."""
    return df.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), *columns
    )


def blocks_of(rows: DataFrame) -> DataFrame:
    """(_file, _block, first, before): each block's first number, and the rows of its file before it."""
    sizes = rows.groupBy("_file", "_block").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_file", "_block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def with_blocks(rows: DataFrame, blocks: DataFrame, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """``rows`` with what ``blocks`` has for them and their ``_place`` in the file, from 0."""
    few = blocks.count() <= most_blocks
    met = rows.join(F.broadcast(blocks) if few else blocks, ["_file", "_block"])
    return met.withColumn("_place", F.col("_at") - F.col("first") + F.col("before")).drop("first", "before", "_at", "_block")


def numbered_rows(df: DataFrame, columns: Sequence[Column | str], most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """Columns of a CSV, JSON or text scan with each row's ``_file`` and ``_place`` in it, from 0."""
    rows = located(df, columns)
    return with_blocks(rows, scratch(blocks_of(rows), "blocks"), most_blocks)


_CSV = {"mode": "PERMISSIVE", "escape": '"', "columnNameOfCorruptRecord": "_wide", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _given(fmt: str, options: dict[str, str] | None) -> dict[str, str]:
    return _CSV | ({"sep": "\t"} if fmt == "text" else {}) | (options or {})


def _multi_line(given: dict[str, str]) -> bool:
    return given.get("multiLine", "false").lower() == "true"


def raw_cells(spark: SparkSession, path: str, *, fmt: str = "csv", options: dict[str, str] | None = None, columns: int = MOST_COLUMNS, wide: bool = False) -> DataFrame:
    """(_file, _block, _at, cells) of every row of every file; ``cells`` has ``columns`` texts, null where a row ends before.

    A line is a row, blank ones too, so rows keep their numbers; of tab-separated files with ``fmt``
    ``text``. With the option ``multiLine`` cells may hold line ends; blank lines don't count then.
    ``wide`` adds whether a row has more cells.
    """
    given = _given(fmt, options)
    names = [f"c{i}" for i in range(columns)]
    schema = ", ".join(f"{c} string" for c in [*names, *(["_wide"] if wide else [])])
    if _multi_line(given):
        df, cell = spark.read.format("csv").options(**given, header="false").schema(schema).load(path), lambda c: F.col(c)
        over = cell("_wide").isNotNull() & cell(names[-1]).isNotNull()  # rows of another width are marked; short ones lack the last cell
    else:
        lines = spark.read.text(path)
        df, cell = lines.withColumn("row", F.from_csv("value", schema, given)), lambda c: F.col(f"row.{c}")
        plain = F.regexp_replace("value", r'"(?:[^"]|"")*"', "")
        over = F.length(plain) - F.length(F.replace(plain, F.lit(given.get("sep", ",")), F.lit(""))) >= columns
    more = [over.alias("wide")] if wide else []
    return located(df, [F.array(*map(cell, names)).alias("cells"), *more])


def first_cells(spark: SparkSession, path: str, blocks: DataFrame, scan: int, *, fmt: str = "csv", options: dict[str, str] | None = None, columns: int = MOST_COLUMNS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(_file, _place, cells) of the first ``scan`` rows of every file. Where a line is a row, only those lines are parsed;
    the others are counted and let go."""
    given, starts = _given(fmt, options), blocks.filter("before = 0")
    top = lambda rows: with_blocks(rows.filter(F.col("_block") == 0), starts, most_blocks).filter(F.col("_place") < scan)
    if _multi_line(given):
        return top(raw_cells(spark, path, fmt=fmt, options=options, columns=columns))
    names = [f"c{i}" for i in range(columns)]
    lines = top(located(spark.read.text(path), ["value"]))
    cells = lines.select("_file", "_place", F.from_csv("value", ", ".join(f"{c} string" for c in names), given).alias("row"))
    return cells.select("_file", "_place", F.array(*(F.col(f"row.{c}") for c in names)).alias("cells"))


def score_headers(first: DataFrame, required: Sequence[str], *, least: int = LEAST_HITS) -> DataFrame:
    """One row a file, from (_file, _place, cells) of its first rows: _file, header_row, cells, at, issue_type, message,
    hits, missing, duplicates.

    Rows are ranked by required headers in them, then by fewest repeats of those, then by filled
    cells. ``at`` is the place of each required header, null where it is missing. Files with an
    ``issue_type`` have no usable header.
    """
    wanted = F.array(*map(F.lit, required))
    texts = F.transform("cells", lambda c: norm_text(c))
    hit = F.filter("texts", lambda t: F.array_contains(wanted, t))
    rows = first.select("_file", "_place", texts.alias("texts")).withColumn("hit", hit)
    distinct = F.size(F.array_distinct("hit"))
    rank = F.struct((-distinct).alias("hits"), (F.size("hit") - distinct).alias("repeats"), (-F.size(F.filter("texts", lambda t: t != ""))).alias("filled"))
    ranked = rows.select("_file", "_place", "texts", "hit", rank.alias("rank"))
    best = ranked.groupBy("_file").agg(
        F.min_by(F.struct("_place", "texts", "hit", "rank"), F.struct("rank", "_place")).alias("b"), F.collect_list("rank").alias("ranks"), F.count(F.lit(1)).alias("scanned")
    )
    hits, repeats = -F.col("b.rank.hits"), F.col("b.rank.repeats")
    ties = F.size(F.filter("ranks", lambda r: r == F.col("b.rank")))
    kind = F.when(hits < least, NOT_FOUND).when((ties > 1) & (hits < len(required)), AMBIGUOUS).when(repeats > 0, REPEATED)
    missing = F.filter(wanted, lambda h: ~F.array_contains(F.col("b.hit"), h))
    again = F.array_distinct(F.filter(F.transform(F.col("b.hit"), lambda t, i: F.when(F.array_position(F.col("b.hit"), t) <= i, t)), lambda t: t.isNotNull()))
    place = F.transform(wanted, lambda h: F.nullif(F.array_position(F.col("b.texts"), h) - 1, F.lit(-1)).cast("int"))
    found = best.select("_file", F.col("b._place").alias("header_row"), F.col("b.texts").alias("cells"), place.alias("at"), kind.alias("issue_type"), hits.alias("hits"), missing.alias("missing"), again.alias("duplicates"), "scanned")
    where = F.concat(F.lit("候选行：第 "), (F.col("header_row") + 1).cast("string"), F.lit(" 行。"))
    lacking = F.when(F.size("missing") > 0, F.concat(F.lit("缺失字段："), F.array_join("missing", "、"), F.lit("。"))).otherwise("")
    repeated = F.when(F.size("duplicates") > 0, F.concat(F.lit("重复必需字段："), F.array_join("duplicates", "、"), F.lit("。"))).otherwise("")
    filled = {"n": F.col("scanned").cast("string"), "hits": F.concat(F.col("hits").cast("string"), F.lit(f"/{len(required)}")), "where": where, "lacking": lacking, "repeats": repeated}
    message = F.when(F.col("issue_type") == NOT_FOUND, _said(NOT_FOUND_TEXT, filled)).when(F.col("issue_type") == AMBIGUOUS, _said(AMBIGUOUS_TEXT, filled)).when(F.col("issue_type") == REPEATED, _said(REPEATED_TEXT, filled))
    return found.withColumn("message", message).drop("scanned")


def _said(template: str, values: dict[str, Column]) -> Column:
    """A message template with columns for its fields."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


@dataclass(frozen=True)
class Sheets:
    """What a folder of sheets holds: typed-to-be rows, one row a file on its header, and files or rows that can't be used."""

    rows: DataFrame
    headers: DataFrame
    issues: DataFrame


def read_sheets(
    spark: SparkSession, path: str, required: dict[str, str], *, fmt: str = "csv", options: dict[str, str] | None = None, least: int = LEAST_HITS, scan: int = SCAN_ROWS, columns: int = MOST_COLUMNS, most_blocks: int = MOST_BLOCKS
) -> Sheets:
    """All sheets of a folder: ``rows`` has _ord, row_label, _file and the ``required`` canonical columns as text.

    ``row_label`` is the row's number in its sheet, ``_ord`` its file and place. Rows without any
    text, and headers a file lacks, are as in a single sheet: dropped, and null. ``issues`` has a
    row for each file whose header isn't found, is ambiguous or repeats a required column, and for
    each row with more cells than ``columns``. Files are read twice: their first rows for the
    headers, and whole; the second time only as many columns as the headers reach.
    """
    read = lambda n, wide=False: raw_cells(spark, path, fmt=fmt, options=options, columns=n, wide=wide)  # noqa: E731 - rows come in the same order however many columns are read
    blocks = scratch(blocks_of(read(columns)), "blocks")
    first = first_cells(spark, path, blocks, scan, fmt=fmt, options=options, columns=columns, most_blocks=most_blocks)
    headers = scratch(score_headers(first, list(required.values()), least=least), "headers")
    named = F.transform(F.filter(F.sequence(F.lit(0), F.size("cells") - 1), lambda i: F.get("cells", i) != ""), lambda i: i.cast("int"))
    usable = headers.filter("issue_type IS NULL").select("_file", "header_row", "at", named.alias("named"))
    reach = usable.agg(F.max(F.array_max("named"))).first()[0]
    per_block = blocks.join(usable, "_file")
    placed = with_blocks(read(min(columns, (reach if reach is not None else 0) + 1)), per_block, most_blocks).filter(F.col("_place") > F.col("header_row"))
    filled = placed.filter(F.exists("named", lambda i: norm_text(F.get("cells", i)) != ""))
    own = [F.get("cells", F.get("at", F.lit(k))).alias(c) for k, c in enumerate(required)]
    rows = filled.select(F.struct(F.col("_file").alias("file"), F.col("_place").alias("place")).alias("_ord"), *own, (F.col("_place") + 1).cast("string").alias("row_label"), "_file")
    bad = headers.filter("issue_type IS NOT NULL").select("_file", (F.col("header_row") + 1).cast("string").alias("row_label"), "issue_type", "message")
    over = with_blocks(read(columns, True).filter("wide").select(*_PLACE), blocks, most_blocks)
    wide = over.select("_file", (F.col("_place") + 1).cast("string").alias("row_label"), F.lit(TOO_WIDE).alias("issue_type"), F.lit(TOO_WIDE_TEXT.format(n=columns)).alias("message"))
    return Sheets(rows, headers, bad.unionByName(wide))
