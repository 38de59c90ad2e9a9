"""Document and document-item grain of one side.

What a document shows is first brought to its distinct texts, each with its first order, so that
lists are bounded by distinct values, however many rows a document has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import append_unique, date_key, in_order
from ..shared import dealt, file_bytes

DATE_JOIN, LINK_JOIN = "、", ","
ORG = ("company", "dept1", "dept2")
_LISTED = ("day", "link_no")


def shown_first(c: str) -> Column:
    """The text with its order, null where it is blank: the least of a document's is what it shows."""
    return F.when(F.col(c) != "", F.struct(F.col("_ord").alias("o"), F.col(c).alias("t")))


def first_of(c: str) -> Column:
    return F.coalesce(F.col(c)["t"], F.lit(""))


def doc_grain(rows: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """doc_no: qty, amount, organisation (each first non-blank), doc_date and link_nos (distinct, in order), links, linked (each
    link with its first order), doc_ord.

    With ``met`` (doc_no, cp_qty, cp_amount: what the documents link to) also cp_qty and cp_amount. All of it is dealt out
    once, by document. Rows of a document that show the same are one before anything is listed, so a document's lists are
    bounded by what differs in it.
    """
    own = rows.select("doc_no", "doc_date", "link_no", *ORG, "qty", "amount", "_ord")
    sums = ["qty", "amount"]
    if met is not None:
        own, sums = own.unionByName(met, allowMissingColumns=True), [*sums, "cp_qty", "cp_amount"]
    held = dealt(own, "doc_no", size=file_bytes(rows)).withColumn("day", date_key(F.col("doc_date")))
    parts = held.groupBy("doc_no", "day", "link_no", *ORG).agg(*(F.sum(c).alias(c) for c in sums), F.min("_ord").alias("_ord"))
    docs = parts.groupBy("doc_no").agg(
        *(F.sum(c).alias(c) for c in sums), F.min("_ord").alias("doc_ord"), *(F.min(shown_first(c)).alias(c) for c in ORG), *(F.collect_list(shown_first(c)).alias(c) for c in _LISTED)
    )
    links = F.array_distinct(in_order(F.col("link_no")))
    by_text = docs.withColumn("by_text", F.array_sort(F.transform("link_no", lambda p: F.struct(p["t"].alias("t"), p["o"].alias("o")))))
    linked = F.filter("by_text", lambda p, i: (i == 0) | (p["t"] != F.get("by_text", i - 1)["t"]))
    return by_text.select(
        "doc_no", *sums, *(first_of(c).alias(c) for c in ORG), append_unique(in_order(F.col("day")), DATE_JOIN).alias("doc_date"), append_unique(links, LINK_JOIN).alias("link_nos"), links.alias("links"), linked.alias("linked"), "doc_ord"
    )


def item_grain(rows: DataFrame, document: str = "doc_no") -> DataFrame:
    """(document, item_code): qty, amount, item_name (the first non-blank), item_ord."""
    name = F.coalesce(F.min_by("item_name", F.when(F.col("item_name") != "", F.col("_ord"))), F.lit(""))
    return rows.groupBy(document, "item_code").agg(F.sum("qty").alias("qty"), F.sum("amount").alias("amount"), name.alias("item_name"), F.min("_ord").alias("item_ord"))


def link_frame(rows: DataFrame) -> DataFrame:
    """Distinct (doc_no, link_no) with a link, and the order in which it was first seen."""
    return rows.filter("link_no <> ''").groupBy("doc_no", "link_no").agg(F.min("_ord").alias("link_ord"))


def links_of(rows: DataFrame) -> DataFrame:
    """Distinct (doc_no, link_no) with a link."""
    return rows.filter("link_no <> ''").select("doc_no", "link_no").distinct()
