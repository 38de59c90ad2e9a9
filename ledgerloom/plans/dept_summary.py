"""Department variance summary: documents of one view classified and rolled up by organisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import by_priority, round2, shown
from ..model import EQUAL, ERP_VIEW, ITEMS_DIFFER, NO_ERP, NO_OA, OA_VIEW, QTY_DIFFERS, TYPE_PRIORITY, Direction, QueryFilters
from ..operators.filters import keyed, selected
from ..operators.grain import ORG, first_of, links_of, shown_first
from ..shared import dealt, file_bytes


def difference_type(matched: Column, mismatch: Column, qty_diff: Column, unmatched_type: str) -> Column:
    """The first that holds; amounts never classify."""
    return F.when(~matched, unmatched_type).when(mismatch, ITEMS_DIFFER).when(qty_diff != 0, QTY_DIFFERS).otherwise(EQUAL)


def classified_documents(oa: DataFrame, erp: DataFrame, direction: Direction = Direction.FORWARD, filters: QueryFilters | None = None) -> DataFrame:
    """The filter side's documents with rounded sums, matched and type.

    A document is matched if some link is any document number of the other side, also one whose
    rows all lack an item code. Sums are rounded for each document before they are added up.

    The other side's rows are dealt out once, by document, to meet the links; what they come to is dealt out once with
    the filter side's rows, by that side's document. Items, then documents, are summed up in the tasks that get them.
    """
    forward = direction is Direction.FORWARD
    primary, other = (oa, erp) if forward else (erp, oa)
    rows = keyed(selected(primary, filters or QueryFilters()))
    shipped = other.filter("doc_no <> ''").select(F.col("doc_no").alias("link_no"), "item_code", "qty", "amount")
    theirs = dealt(shipped, "link_no", size=file_bytes(other)).groupBy("link_no", "item_code").agg(F.sum("qty").alias("cp_qty"), F.sum("amount").alias("cp_amount"))
    met = links_of(rows).join(theirs, "link_no").select("doc_no", "item_code", "cp_qty", "cp_amount", F.lit(True).alias("matched"))
    own = rows.select("doc_no", "item_code", "qty", "amount", *ORG, "_ord").unionByName(met, allowMissingColumns=True)
    numbers = ("qty", "amount", "cp_qty", "cp_amount")
    heads = [F.min(shown_first(c)).alias(c) for c in ORG]
    items = dealt(own, "doc_no", size=file_bytes(rows)).groupBy("doc_no", "item_code").agg(*(F.sum(c).alias(c) for c in numbers), F.max("matched").alias("matched"), *heads, F.min("_ord").alias("doc_ord"))
    # a counterpart's rows without an item code make its document known and nothing else
    has_item = F.col("item_code") != ""
    mismatch = has_item & ((round2(F.col("qty")) == 0) != (round2(F.col("cp_qty")) == 0))
    docs = items.groupBy("doc_no").agg(*(F.sum(F.when(has_item, F.col(c))).alias(c) for c in numbers), F.max("matched").alias("matched"), F.max(mismatch).alias("mismatch"), *(F.min(c).alias(c) for c in ORG), F.min("doc_ord").alias("doc_ord"))
    rounded = {c: round2(F.col(c)) for c in numbers}
    oa_side, erp_side = ("", "cp_") if forward else ("cp_", "")
    is_matched = F.coalesce("matched", F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("decimal(38,10)"))
    kind = difference_type(is_matched, F.coalesce("mismatch", F.lit(False)), round2(zero("qty") - zero("cp_qty")), NO_ERP if forward else NO_OA)
    return docs.select(
        *(first_of(c).alias(c) for c in ORG), "doc_no", "doc_ord", is_matched.alias("matched"), kind.alias("type"),
        rounded[f"{oa_side}qty"].alias("oa_qty"), rounded[f"{erp_side}qty"].alias("erp_qty"), rounded[f"{oa_side}amount"].alias("oa_amount"), rounded[f"{erp_side}amount"].alias("erp_cost"),
    )


def unmatched_documents(oa: DataFrame, erp: DataFrame, direction: Direction = Direction.FORWARD, filters: QueryFilters | None = None) -> DataFrame:
    """The documents of :func:`classified_documents` that aren't matched: company, doc_no, type, oa_qty, erp_qty.

    None of their links is a document of the other side, which then has nothing to add up: no item of either side is
    dealt out, only documents and links.
    """
    forward = direction is Direction.FORWARD
    primary, other = (oa, erp) if forward else (erp, oa)
    rows = keyed(selected(primary, filters or QueryFilters()))
    known = other.filter("doc_no <> ''").select(F.col("doc_no").alias("link_no")).distinct()
    matched = links_of(rows).join(known, "link_no", "left_semi").select("doc_no", F.lit(True).alias("matched"))
    parts = rows.groupBy("doc_no", "company").agg(F.sum("qty").alias("qty"), F.min("_ord").alias("_ord")).unionByName(matched, allowMissingColumns=True)
    docs = dealt(parts, "doc_no", size=file_bytes(rows)).groupBy("doc_no").agg(F.sum("qty").alias("qty"), F.min(shown_first("company")).alias("company"), F.max("matched").alias("matched")).filter("matched IS NULL")
    own, none = round2(F.col("qty")), round2(F.lit(None).cast("decimal(38,10)"))
    oa_qty, erp_qty = (own, none) if forward else (none, own)
    return docs.select(first_of("company").alias("company"), "doc_no", F.lit(NO_ERP if forward else NO_OA).alias("type"), oa_qty.alias("oa_qty"), erp_qty.alias("erp_qty"))


def department_summary(oa: DataFrame, erp: DataFrame, direction: Direction = Direction.FORWARD, filters: QueryFilters | None = None, ordered: bool = True) -> DataFrame:
    """Counts, sums (differences are always OA minus ERP) and the types found, by company and departments."""
    docs = classified_documents(oa, erp, direction, filters)
    different = F.col("matched") & F.col("type").isin(ITEMS_DIFFER, QTY_DIFFERS)
    rolled = docs.groupBy("company", "dept1", "dept2").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if("matched").alias("n_matched"), F.count_if(~F.col("matched")).alias("n_unmatched"), F.count_if(different).alias("n_different"),
        *(F.sum(c).alias(c) for c in ("oa_qty", "erp_qty", "oa_amount", "erp_cost")), F.collect_set("type").alias("kinds"), F.min("doc_ord").alias("doc_ord"),
    )
    rolled = rolled.orderBy("doc_ord") if ordered else rolled
    return rolled.select(
        "company", "dept1", "dept2", F.lit(OA_VIEW if direction is Direction.FORWARD else ERP_VIEW).alias("perspective"), "n_docs", "n_matched", "n_unmatched", "n_different",
        shown(F.col("oa_qty")).alias("oa_qty"), shown(F.col("erp_qty")).alias("erp_qty"), shown(F.col("oa_qty") - F.col("erp_qty")).alias("qty_diff"),
        shown(F.col("oa_amount")).alias("oa_amount"), shown(F.col("erp_cost")).alias("erp_cost"), shown(F.col("oa_amount") - F.col("erp_cost")).alias("amount_diff"),
        by_priority(F.col("kinds"), TYPE_PRIORITY).alias("types"),
    )
