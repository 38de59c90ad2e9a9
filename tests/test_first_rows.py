"""A header is looked for in the first rows alone."""

from pyspark.sql import functions as F

from ledgerloom.sources.headers import SCAN_ROWS
from ledgerloom.sources.tables import find_header, parse_table

HEADS = {"doc_no": "Number", "item_code": "Item", "qty": "Quantity"}


def test_only_first_rows_cells_are_worked_out(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def cells(i):
        made.add(1)
        return ["Number", "Item", "Quantity"] if i == 1 else [None, "", " 　"] if i % 7 == 3 else [f"F{i}", "M", "1"]

    matrix = spark.range(2000, numPartitions=4).select((F.lit(1999) - F.col("id")).alias("_ord")).select("_ord", cells("_ord").alias("cells"))
    header = find_header(matrix, list(HEADS.values()), first_row=1, least=2)
    assert header.row == 1 and made.value <= 2 * SCAN_ROWS


def test_rows_without_text_are_dropped(spark):
    rows = [(0, ["title"]), (1, ["Number", "Item", "Quantity", "a", "b"]), (2, ["", None, " 　"]), (3, ["", "", "1"]), (4, []), (5, [None, None, None, None, "x"]), (6, ["F1"])]
    matrix = spark.createDataFrame(rows, "_ord long, cells array<string>")
    required = {**HEADS, "a": "a", "b": "b"}
    found, meta = parse_table(matrix, required, first_row=1)
    assert [r["_ord"] for r in found.orderBy("_ord").collect()] == [3, 5, 6] and meta.header_row == "2"
