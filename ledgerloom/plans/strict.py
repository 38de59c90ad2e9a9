"""Strict mode: the first unusable cell of a query's sources, by contract order, as an error.

One aggregation over each source looks for malformed cells before the query runs; the query
itself uses null-safe parsers, so nothing depends on the order in which Spark evaluates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import date_invalid, decimal_invalid, is_blank, norm_text, text_date
from ..model import ERP_HEADERS, OA_HEADERS, DataQualityError, QueryFilters
from ..operators.filters import in_organisation, in_dates


def first_defect(raw: DataFrame, source: str, filters: QueryFilters | None, phase: int) -> DataFrame:
    """(phase, step, _ord, field, message) of the first bad cell: dates of all rows come before numbers.

    ``filters`` set: numbers count only on rows that pass them; None: on all rows with a document.
    """
    names = OA_HEADERS if source == "OA" else ERP_HEADERS
    rows = raw.select("*", text_date(F.col("doc_date")).alias("day"))
    keyed = ~is_blank(F.col("doc_no")) & ~is_blank(F.col("item_code"))
    clean = rows.withColumns({c: norm_text(F.col(c)) for c in ("company", "dept1", "dept2")})
    used = keyed & in_dates(filters, "day") & in_organisation(filters) if filters is not None else keyed
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    bad = [F.when(date_invalid(F.col("doc_date")), F.struct(F.lit(phase).alias("phase"), F.lit(0).alias("step"), F.col("_ord").alias("o"), F.lit(0).alias("field"), F.concat(F.lit("日期格式不正确："), text("doc_date")).alias("message")))]
    for i, c in enumerate(("qty", "amount"), 1):
        bad.append(F.when(used & decimal_invalid(F.col(c)), F.struct(F.lit(phase).alias("phase"), F.lit(0).alias("step"), F.col("_ord").alias("o"), F.lit(i).alias("field"), F.concat(F.lit(f"{names[c]}数值格式不正确："), text(c)).alias("message"))))
    return clean.agg(F.min(F.least(*bad)).alias("first"))


def require_clean(primary: DataFrame, counterpart: DataFrame, filters: QueryFilters, primary_source: str = "OA") -> None:
    """Raise :class:`DataQualityError` for the first bad cell: the filter side's, then the counterpart's."""
    other = "ERP" if primary_source == "OA" else "OA"
    for raw, source, used, phase in ((primary, primary_source, filters, 0), (counterpart, other, None, 1)):
        found = first_defect(raw, source, used, phase).first()["first"]
        if found is not None:
            raise DataQualityError(found["message"])
