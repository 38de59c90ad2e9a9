"""Small source tables in canonical text columns, and helpers to compare results."""

from __future__ import annotations

from ledgerloom.sources.tables import canonical

OA_ORDER = ("doc_no", "link_no", "doc_date", "company", "dept1", "dept2", "item_code", "item_name", "qty", "amount")
ERP_ORDER = ("doc_no", "doc_date", "link_no", "company", "dept1", "dept2", "item_code", "item_name", "qty", "amount")
ORG = ("north", "press", "hall 2")
FILTER = {"company": "north", "dept1": "press", "dept2": "hall 2", "start_date": "2026-05-01", "end_date": "2026-05-31"}
_DDL = ", ".join(f"{c} string" for c in OA_ORDER) + ", _ord long, row_label string"


def raw(spark, rows, order=OA_ORDER):
    """Rows in the column order of their side; row labels start at 2 as below a sheet's header."""
    full = [dict(zip(order, r, strict=True)) for r in rows]
    values = [(*(None if d[c] is None else str(d[c]) for c in OA_ORDER), i, str(i + 2)) for i, d in enumerate(full)]
    return spark.createDataFrame(values, _DDL)


def oa(spark, *rows):
    return canonical(raw(spark, rows))


def erp(spark, *rows):
    return canonical(raw(spark, rows, ERP_ORDER))


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]
