"""Deterministic source tables of any size: ten scenarios by row number, one organisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dataset_name(n: int) -> str:
    return f"{n // 1000}k" if n >= 1000 and n % 1000 == 0 else str(n)


def _day(offset):
    return F.concat(F.lit("2026-05-"), F.lpad((offset % 28 + 1).cast("string"), 2, "0")).cast("date")


def _padded(prefix: str, number, width: int):
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def _rows(i, doc_no, link_no, day, item, qty, amount, order) -> list:
    ten = "decimal(28,10)"
    return [
        doc_no.alias("doc_no"), link_no.alias("link_no"), day.alias("doc_date"), F.lit("数控").alias("company"), F.lit("生产").alias("dept1"), F.lit("仓储").alias("dept2"),
        item.alias("item_code"), F.concat(F.lit("物料"), (i % 500).cast("string")).alias("item_name"), qty.cast(ten).alias("qty"), amount.cast(ten).alias("amount"), order.alias("_ord"),
    ]


def generate_oa(spark: SparkSession, n: int) -> DataFrame:
    """``n`` requests, one document and item each."""
    i = F.col("id")
    return spark.range(n).select(*_rows(i, _padded("F", i, 6), _padded("QOUT", i, 6), _day(i), _padded("MAT-", i % 500, 4), F.lit(1), F.lit(10), i))


def generate_erp(spark: SparkSession, n: int) -> DataFrame:
    """Stock movements of ``n`` requests: none for scenario 0, else a mirror (2: other item, 3: double
    quantity), and besides it an unrelated document (1) or a second one of zero (4)."""
    i, kind = F.col("id"), F.col("id") % 10
    item = _padded("MAT-", i % 500, 4)
    base = spark.range(n)
    mirror = base.filter(kind != 0).select(*_rows(i, _padded("QOUT", i, 6), _padded("F", i, 6), _day(i + 1), F.when(kind == 2, F.concat(item, F.lit("-ERP"))).otherwise(item), F.when(kind == 3, 2).otherwise(1), F.lit(10), i * 2))
    alone = _padded("ERPONLY", i, 6)
    unrelated = base.filter(kind == 1).select(*_rows(i, alone, alone, _day(i + 1), _padded("MAT-ERPONLY-", i % 500, 4), F.lit(1), F.lit(10), i * 2 + 1))
    second = base.filter(kind == 4).select(*_rows(i, F.concat(_padded("QOUT", i, 6), F.lit("-B")), _padded("F", i, 6), _day(i + 2), item, F.lit(0), F.lit(0), i * 2 + 1))
    return mirror.unionByName(unrelated).unionByName(second)
