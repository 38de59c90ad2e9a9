"""Registered queries of the reconciliation engine over the warehouse views."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.exprs import append_unique, bigrams, cell_safe_note, date_key, in_order, norm_text, serial_date, text_date, text_decimal
from .model import OA_HEADERS, Direction, OutputKind, QueryFilters, QueryState
from .operators.index import CandidateIndex
from .operators.place import with_place
from .operators.precheck import ISSUE, cell_issues, duplicate_issues, orphan_issues, precheck
from .operators.search import bigram_index, distinct_candidates, indexed_search, search
from .plans.dept_summary import classified_documents, department_summary, unmatched_documents
from .plans.detail import SUMMARY_READS, detail_compare, detail_summary, erp_groups, erp_only_rows, erp_rows_of_sources, oa_groups
from .plans.doc_compare import EXPANDED_ORDER, compare_documents
from .plans.engine import ReconEngine
from .plans.lookup import ERP_MODE, OA_MODE, lookup_rows, lookup_suggestions, organisation_suggestions
from .shared import shared_dir
from .sources.generator import generate_erp, generate_oa
from .sources.shapes import json_matrix
from .sources.sheet_source import read_sheet_files
from .sources.sheets import read_sheets
from .sources.tables import canonical, parse_table
from .sources.warehouse import erp_view, oa_view, raw_of

Query = Callable[[SparkSession, str], DataFrame]

FILTERS = QueryFilters(company="ASIA", start_date="1995-01-01", end_date="1996-12-31")
OA_DOC, ERP_DOC = "F14", "Q14-B"
SEARCH_TEXT = "re"
GENERATED = 10_000


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return oa_view(spark, d), erp_view(spark, d)


def _compare(oa_first: bool, materials: bool, filters: QueryFilters | None = None) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        sides = _both(spark, d)
        found = compare_documents(*(sides if oa_first else sides[::-1]), filters)
        return found.materials(ordered=False) if materials else found.summary(ordered=False)

    return run


def _variance(direction: Direction, filters: QueryFilters | None = None) -> Query:
    return lambda spark, d: department_summary(*_both(spark, d), direction, filters, ordered=False)


def _placed(df: DataFrame, *by: str) -> DataFrame:
    """An ordered result with each row's place in it, counted by ``by``."""
    at = df.withColumn("_at", F.monotonically_increasing_id())
    return at.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("_at"))).drop("_at")


def _document_order(oa_first: bool) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        sides = _both(spark, d)
        found = compare_documents(*(sides if oa_first else sides[::-1])).summary().select("company", "dept1", "doc_no")
        return _placed(found, "company", "dept1")

    return run


def _variance_order(spark: SparkSession, d: str) -> DataFrame:
    return _placed(department_summary(*_both(spark, d)).select("perspective", "company", "dept1", "dept2"), "perspective")


def _organisation_order(spark: SparkSession, d: str) -> DataFrame:
    return _placed(organisation_suggestions(*_both(spark, d)), "field")


def _expand_order(spark: SparkSession, d: str) -> DataFrame:
    return _placed(_expand(spark, d).select("doc_no", "item_code"), "doc_no")


def _both_directions(spark: SparkSession, d: str, documents: Callable[..., DataFrame] = classified_documents) -> DataFrame:
    sides = _both(spark, d)
    forward, reverse = (documents(*sides, direction).withColumn("direction", F.lit(direction.value)) for direction in (Direction.FORWARD, Direction.REVERSE))
    return forward.unionByName(reverse)


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return _both_directions(spark, d).groupBy("direction", "type", "matched").agg(F.count(F.lit(1)).alias("n"))


def _detail(direction: Direction, summary: bool) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = detail_compare(*_both(spark, d), direction).rows(ordered=False, columns=SUMMARY_READS if summary else ())
        return detail_summary(rows) if summary else rows

    return run


def _group_columns(groups: DataFrame) -> DataFrame:
    return groups.select("form_no", "item_code", F.round("qty", 2).cast("double").alias("qty"), F.round("amount", 2).cast("double").alias("amount"), "company", "item_name", "source_no", "days", "doc_nos")


def _erp_only(spark: SparkSession, d: str) -> DataFrame:
    oa, erp = _both(spark, d)
    return _group_columns(erp_only_rows(erp, oa))


def _erp_for_oa_source(spark: SparkSession, d: str) -> DataFrame:
    oa, erp = _both(spark, d)
    forms = oa_groups(oa.filter(F.col("company") == FILTERS.company))
    return _group_columns(erp_groups(erp_rows_of_sources(erp, forms), F.col("_ord")))


def _lookup(mode: str, doc_no: str) -> Query:
    return lambda spark, d: lookup_rows(*_both(spark, d), mode, doc_no, ordered=False)


def _suggestions(mode: str) -> Query:
    return lambda spark, d: lookup_suggestions((oa_view if mode == OA_MODE else erp_view)(spark, d), mode, ordered=False)


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return distinct_candidates(spark.read.parquet(f"{d}/part.parquet"), "p_name", "p_partkey")


def _raw(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return raw_of(oa_view(spark, d)), raw_of(erp_view(spark, d))


def _cells(*checks: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        oa, erp = _raw(spark, d)
        return cell_issues(oa, "OA", checks).unionByName(cell_issues(erp, "ERP", checks)).select(*ISSUE)

    return run


def _duplicates(spark: SparkSession, d: str) -> DataFrame:
    oa, erp = _raw(spark, d)
    return duplicate_issues(oa, "OA").unionByName(duplicate_issues(erp, "ERP")).select(*ISSUE)


def _sides_of(spark: SparkSession, d: str) -> DataFrame:
    """Raw rows of both sides with their ``side``."""
    oa, erp = _raw(spark, d)
    return oa.withColumn("side", F.lit("OA")).unionByName(erp.withColumn("side", F.lit("ERP")))


def _canonical_totals(spark: SparkSession, d: str) -> DataFrame:
    oa, erp = (canonical(raw).withColumn("side", F.lit(side)) for raw, side in zip(_raw(spark, d), ("OA", "ERP"), strict=True))
    return oa.unionByName(erp).groupBy("side", "company", date_key(F.col("doc_date")).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("qty").cast("double").alias("qty"), F.round(F.sum("amount"), 2).cast("double").alias("amount"))


def _normal_dates(spark: SparkSession, d: str) -> DataFrame:
    raw = _sides_of(spark, d)
    serial = F.col("n") + 34_000
    texts = raw.select(F.col("doc_date").alias("raw"), text_date(F.col("doc_date")).alias("day")).distinct()
    numbers = spark.range(500).select(F.col("id").alias("n")).select(F.concat(F.lit("#"), serial.cast("string")).alias("raw"), serial_date(serial + 0.75).alias("day"))
    return texts.union(numbers).select("raw", date_key(F.col("day")).alias("day"))


def _normal_decimals(spark: SparkSession, d: str) -> DataFrame:
    raw = _sides_of(spark, d)
    both = raw.select(F.explode(F.array("qty", "amount")).alias("raw")).distinct()
    return both.select("raw", F.round(text_decimal(F.col("raw")), 4).cast("double").alias("value"))


def _normal_text(spark: SparkSession, d: str) -> DataFrame:
    names = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(F.lit("　 \t"), F.col("p_name"), F.lit("  \n﻿")).alias("raw"))
    return names.select("p_partkey", norm_text(F.col("raw")).alias("text"), F.array_join(bigrams(norm_text(F.col("raw"))), "|").alias("grams"), cell_safe_note(F.concat(F.lit("="), F.col("raw")), 12).alias("note"))


def _append_unique(spark: SparkSession, d: str) -> DataFrame:
    """The links of every request, as they come, joined without repeats."""
    listed = oa_view(spark, d).groupBy("doc_no").agg(F.array_sort(F.collect_list(F.struct(F.col("_ord").alias("o"), F.col("link_no").alias("t")))).alias("links"))
    return listed.select("doc_no", append_unique(in_order(F.col("links")), ",").alias("text"))


def _generated(side: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = (generate_oa if side == "oa" else generate_erp)(spark, GENERATED)
        return rows.select("doc_no", "link_no", date_key(F.col("doc_date")).alias("doc_date"), "company", "dept1", "dept2", "item_code", "item_name", F.col("qty").cast("double").alias("qty"), F.col("amount").cast("double").alias("amount"))

    return run


def _generated_variance(direction: Direction) -> Query:
    return lambda spark, d: department_summary(generate_oa(spark, GENERATED), generate_erp(spark, GENERATED), direction, ordered=False)


def _sheet(spark: SparkSession, d: str) -> DataFrame:
    """All requests as a sheet that users keep: a title, then the header, then rows with a column of their own."""
    heads = list(OA_HEADERS.values())
    top = spark.createDataFrame([(0, ["scrap list"]), (1, [*heads, "note"])], "_ord long, cells array<string>").withColumn("_ord", F.col("_ord").cast("decimal(38,0)"))
    rows = _raw(spark, d)[0]
    cells = [F.concat(F.lit(" "), F.col(c), F.lit("\u3000")) if c == "doc_no" else F.col(c) for c in OA_HEADERS]
    return top.union(rows.select("_ord", F.array(*cells, F.lit("extra"))))


def _header_detect(spark: SparkSession, d: str) -> DataFrame:
    _, meta = parse_table(_sheet(spark, d), OA_HEADERS, first_row=1)
    return spark.createDataFrame([(i, h, meta.header_row) for i, h in enumerate(meta.headers)], "place int, header string, header_row string")


def _table_parse(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = parse_table(_sheet(spark, d), OA_HEADERS, first_row=1)
    typed = canonical(rows)
    return typed.select("doc_no", "link_no", date_key(F.col("doc_date")).alias("doc_date"), "company", "item_code", F.col("qty").cast("double").alias("qty"), F.col("amount").cast("double").alias("amount"), "row_label")


#: Sheets that the requests are dealt over; their number tells how each is laid out.
SHEETS = 200
#: Required headers that a broken sheet's header rows hold.
FEW_HEADS, HALF_HEADS = 4, 6


def sheet_folder(spark: SparkSession, d: str, broken: bool = False) -> str:
    """A folder of CSV sheets with all requests, as users keep them: up to three title lines, columns turned by a sheet's
    number, a column of their own. Of every 25, one has too few headers and one has two half header rows; with ``broken``
    every 25th has a row too short in its middle, and another ends in bytes that are no text."""
    heads = list(OA_HEADERS.values())
    turn = lambda cells, by: F.concat(F.slice(cells, by + 1, len(heads)), F.slice(cells, F.lit(1), by))
    line = lambda cells: F.array_join(F.transform(cells, lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))), ",")
    sheet, kind, by = F.col("sheet"), F.col("sheet") % 25, F.col("sheet").cast("int") % len(heads)
    names = turn(F.array(*map(F.lit, heads)), by)
    header = F.when(kind == 7, F.slice(names, 1, FEW_HEADS)).when(kind == 8, F.slice(names, 1, HALF_HEADS)).otherwise(F.concat(names, F.array(F.lit("note"))))
    titles = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(i.alias("at"), F.when(i <= sheet % 4, F.concat(F.lit("list "), i.cast("string"))).alias("line")))
    top = spark.range(SHEETS).withColumnRenamed("id", "sheet").select("sheet", F.explode(F.concat(titles, F.array(F.struct(F.lit(4).alias("at"), line(header).alias("line")), F.struct(F.lit(5).alias("at"), F.when(kind == 8, line(header)).alias("line"))))).alias("t"))
    rows = _raw(spark, d)[0].withColumn("sheet", F.regexp_extract("doc_no", r"(\d+)$", 1).cast("long") % SHEETS)
    body = rows.select("sheet", F.lit(6).alias("at"), F.col("_ord"), F.concat(line(turn(F.array(*OA_HEADERS), by)), F.lit(",x")).alias("line"))
    lines = top.select("sheet", "t.at", F.lit(0).cast("decimal(38,0)").alias("_ord"), "t.line").filter("line IS NOT NULL").union(body)
    if broken:
        more = spark.range(SHEETS).withColumnRenamed("id", "sheet").filter(kind.isin(3, 4)).select("sheet", F.lit(7).alias("at"), F.lit(0).cast("decimal(38,0)").alias("_ord"), F.when(kind == 3, "short").otherwise("bad").alias("line"))
        lines = lines.union(more)
    path = f"{shared_dir(spark)}/sheets-{uuid.uuid4().hex}"
    text = F.when(F.col("line") == "bad", F.unhex(F.lit("FFFE22"))).otherwise(F.encode("line", "utf-8")) if broken else F.col("line")
    lines = lines.repartitionById(SHEETS, F.col("sheet").cast("int")).sortWithinPartitions("sheet", "at", "_ord").select("sheet", text.cast("string").alias("line"))
    lines.write.partitionBy("sheet").text(path)
    return path


def _sheet_of(file: str | Column) -> Column:
    return F.regexp_extract(file, r"sheet=(\d+)", 1).cast("long").alias("sheet")


def _sheet_rows(rows: DataFrame) -> DataFrame:
    typed = canonical(rows).withColumn("sheet", _sheet_of(F.col("_ord.file")))
    return typed.select("sheet", F.col("row_label").cast("long").alias("row"), "doc_no", "link_no", date_key(F.col("doc_date")).alias("doc_date"), "company", "item_code", F.col("qty").cast("double").alias("qty"), F.col("amount").cast("double").alias("amount"))


def _sheets_parse(spark: SparkSession, d: str) -> DataFrame:
    return _sheet_rows(read_sheets(spark, sheet_folder(spark, d), OA_HEADERS).rows)


def _sheets_headers(spark: SparkSession, d: str) -> DataFrame:
    found = read_sheets(spark, sheet_folder(spark, d), OA_HEADERS).headers
    return found.select(_sheet_of("_file"), (F.col("header_row") + 1).alias("header_row"), F.coalesce("issue_type", F.lit("")).alias("issue_type"), F.col("hits").cast("int").alias("hits"), F.size("missing").alias("n_missing"), F.array_join("missing", ",").alias("missing"))


def _sheet_files(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = read_sheet_files(spark, sheet_folder(spark, d, broken=True), OA_HEADERS)
    return _sheet_rows(rows)


def _sheet_report(spark: SparkSession, d: str) -> DataFrame:
    _, report = read_sheet_files(spark, sheet_folder(spark, d, broken=True), OA_HEADERS)
    return report.select(_sheet_of("file"), "strategy", (F.col("reason") != "").alias("has_reason"), "header_row", "n_rows", F.col("n_columns").alias("n_columns"))


def _matrix_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as JSON lines of six shapes, and the cells they come to."""
    key, kind = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 6
    said = F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"'))
    parts = {0: (F.col("o_custkey").cast("string"),), 1: (said,), 2: ("[", key, ",", said, ",null,true]"), 3: ("[[", key, ",", F.col("o_custkey").cast("string"), "],[", said, "]]"), 4: ("[", key, ",[1.5,", said, '],[],"x"]'), 5: ("[]",)}
    line = F.coalesce(*(F.when(kind == k, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in own))) for k, own in parts.items()))
    rows = json_matrix(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", line.alias("line")), "line", "o_orderkey")
    return rows.select(F.col("_ord.line").alias("o_orderkey"), F.col("_ord.row").alias("row_at"), F.posexplode("cells").alias("col_at", "cell"))


def _output_place(spark: SparkSession, d: str) -> DataFrame:
    """Every document of the OA view with its row in the whole output."""
    docs = compare_documents(*_both(spark, d)).documents()
    return with_place(docs.select("doc_no", "company", "doc_ord"), "doc_ord").select("place", "doc_no", "company")


#: What is looked for in each field of the stored index.
SEARCHES = (("company", "a"), ("company", "si"), ("dept1", "ni"), ("dept1", "united"), ("dept2", "Build"), ("oa", "f1"), ("oa", "9"), ("oa", "F123"), ("erp", "4-b"), ("erp", "x"), ("erp", "q77"), ("erp", "zz"))


def search_index(spark: SparkSession, d: str) -> CandidateIndex:
    """An index of organisations and document numbers of both sides, added in two batches."""
    oa, erp = _both(spark, d)
    fields = {"company": oa, "dept1": oa, "dept2": oa, "oa": oa, "erp": erp}
    listed = [df.groupBy(F.col(c if c in ORG_FIELDS else "doc_no").alias("value")).agg(F.min("_ord").alias("_ord")).select(F.lit(c).alias("field"), "value", "_ord") for c, df in fields.items()]
    index = CandidateIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    for batch in (listed[:4], listed[2:]):  # the second has fields of the first again
        rows = batch[0]
        for more in batch[1:]:
            rows = rows.union(more)
        index.add(rows)
    return index


ORG_FIELDS = ("company", "dept1", "dept2")


def _search_index(spark: SparkSession, d: str) -> DataFrame:
    index, found = search_index(spark, d), None
    for field, text in SEARCHES:
        rows = index.search(field, text).select(F.lit(field).alias("field"), F.lit(text).alias("query"), "value")
        found = rows if found is None else found.union(rows)
    return found


#: Documents whose items an output shows: those of every 13th order.
OPEN_EVERY = 13


def _output_with_items(spark: SparkSession, d: str) -> DataFrame:
    sides = _both(spark, d)
    chosen = sides[0].filter(F.regexp_extract("doc_no", r"(\d+)$", 1).cast("long") % OPEN_EVERY == 0).select("doc_no").distinct()
    found = compare_documents(*sides).expanded(chosen)
    return with_place(found, *EXPANDED_ORDER).select("place", "row_type", "doc_no", "item_code", "company", "qty", "cp_qty", "qty_diff", "amount_diff")


def _expand(spark: SparkSession, d: str) -> DataFrame:
    return ReconEngine(*_both(spark, d)).expand(OutputKind.OA_COMPARE, OA_DOC, QueryState())


def _engine_variance(spark: SparkSession, d: str) -> DataFrame:
    return ReconEngine(*_both(spark, d)).rows(OutputKind.VARIANCE, QueryState(FILTERS, Direction.REVERSE), ordered=False)


def _unmatched(spark: SparkSession, d: str) -> DataFrame:
    return _both_directions(spark, d, unmatched_documents).select("direction", "doc_no", "company", F.col("oa_qty").cast("double").alias("oa_qty"), F.col("erp_qty").cast("double").alias("erp_qty"))


QUERIES: dict[str, Query] = {
    "dept_variance_oa": _variance(Direction.FORWARD),
    "dept_variance_erp": _variance(Direction.REVERSE),
    "dept_variance_filtered": _engine_variance,
    "oa_doc_compare_summary": _compare(True, False),
    "erp_doc_compare_summary": _compare(False, False),
    "oa_doc_compare_material": _compare(True, True),
    "erp_doc_compare_material": _compare(False, True),
    "oa_doc_compare_filtered": _compare(True, False, FILTERS),
    "oa_doc_expand": _expand,
    "oa_doc_order": _document_order(True),
    "erp_doc_order": _document_order(False),
    "dept_variance_order": _variance_order,
    "org_suggestions_order": _organisation_order,
    "oa_doc_expand_order": _expand_order,
    "classified_documents": _classified,
    "unmatched_documents": _unmatched,
    "detail_forward": _detail(Direction.FORWARD, False),
    "detail_reverse": _detail(Direction.REVERSE, False),
    "detail_summary_forward": _detail(Direction.FORWARD, True),
    "detail_summary_reverse": _detail(Direction.REVERSE, True),
    "erp_only_rows": _erp_only,
    "erp_rows_for_oa_source": _erp_for_oa_source,
    "lookup_oa": _lookup(OA_MODE, OA_DOC),
    "lookup_erp": _lookup(ERP_MODE, ERP_DOC),
    "lookup_suggestions_oa": _suggestions(OA_MODE),
    "lookup_suggestions_erp": _suggestions(ERP_MODE),
    "org_suggestions": lambda spark, d: organisation_suggestions(*_both(spark, d), ordered=False),
    "candidate_search_contains": lambda spark, d: search(_parts(spark, d), SEARCH_TEXT).select("value"),
    "candidate_search_bigram": lambda spark, d: indexed_search(c := _parts(spark, d), bigram_index(c), SEARCH_TEXT).select("value"),
    "precheck_bad_dates": _cells("date"),
    "precheck_bad_numbers": _cells("number"),
    "precheck_required": _cells("key"),
    "precheck_blank_link": _cells("link"),
    "precheck_duplicates": _duplicates,
    "precheck_orphans": lambda spark, d: orphan_issues(*_raw(spark, d)).select(*ISSUE),
    "precheck_all": lambda spark, d: precheck(*_raw(spark, d), ordered=False),
    "canonical_totals": _canonical_totals,
    "normalize_dates": _normal_dates,
    "normalize_decimals": _normal_decimals,
    "normalize_text": _normal_text,
    "append_unique": _append_unique,
    "benchmark_generator_oa": _generated("oa"),
    "benchmark_generator_erp": _generated("erp"),
    "benchmark_dept_variance": _generated_variance(Direction.FORWARD),
    "benchmark_dept_variance_erp": _generated_variance(Direction.REVERSE),
    "header_detect": _header_detect,
    "table_parse": _table_parse,
    "sheets_parse": _sheets_parse,
    "sheets_headers": _sheets_headers,
    "sheet_files_rows": _sheet_files,
    "sheet_files_report": _sheet_report,
    "matrix_shapes": _matrix_shapes,
    "oa_output_place": _output_place,
    "oa_output_with_items": _output_with_items,
    "search_index_fields": _search_index,
    "diagnostics": lambda spark, d: ReconEngine(*_both(spark, d)).diagnostics(),
}
