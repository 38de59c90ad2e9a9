"""Row predicates of the reconciliation queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import QueryFilters


def in_dates(filters: QueryFilters, column: str = "doc_date") -> Column:
    """Within the range, ends included; a row without a date is outside even an open range."""
    day = F.col(column)
    out = day.isNotNull()
    if filters.start_date:
        out &= day >= F.lit(dt.date.fromisoformat(filters.start_date))
    if filters.end_date:
        out &= day <= F.lit(dt.date.fromisoformat(filters.end_date))
    return out


def in_organisation(filters: QueryFilters) -> Column:
    out = F.lit(True)
    for column in ("company", "dept1", "dept2"):
        if wanted := getattr(filters, column):
            out &= F.col(column) == wanted
    return out


def selected(rows: DataFrame, filters: QueryFilters) -> DataFrame:
    """The filter side's rows."""
    return rows.filter(in_dates(filters) & in_organisation(filters))


def keyed(rows: DataFrame) -> DataFrame:
    """Rows with a document and an item."""
    return rows.filter((F.col("doc_no") != "") & (F.col("item_code") != ""))


def with_text(rows: DataFrame, column: str, value: str) -> DataFrame:
    return rows.filter(F.col(column) == F.lit(value))


def split_by_presence(rows: DataFrame, column: str, others: DataFrame, other_column: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``column`` occurs among the others, all remaining rows); a blank never occurs."""
    known = others.select(F.col(other_column).alias(column)).filter(F.col(column) != "").distinct()
    return rows.join(known, column, "left_semi"), rows.join(known, column, "left_anti")


def distinct_text(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).filter(F.col(column) != "").distinct()
