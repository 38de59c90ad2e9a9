"""Look up one document from either side, and the numbers one can look up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import date_key, dept_pair, label_of, round2, shown, unique_text
from ..model import (
    ERP_LACKS_ITEM, ITEM_ROW, LOOKUP_ERP, LOOKUP_OA, NO_ERP_DOC, NO_ERP_ITEM_CODE, NO_OA_DOC, NO_OA_ITEM_CODE, OA_LACKS_ITEM, QTY_DIFFERENT, QTY_EQUAL,
)
from ..operators.filters import distinct_text, split_by_presence, with_text

OA_MODE, ERP_MODE = "oa_form_number", "erp_doc_number"
_SIDE = ("doc_no", "link_nos", "date", "company", "dept1", "dept2", "item_code", "item_name", "qty", "amount")


@dataclass
class LookupResult:
    """Rows, or the message that the number is unknown."""

    df: DataFrame | None
    message: str = ""


def _materials(rows: DataFrame) -> DataFrame:
    """One row an item; rows without an item code stay by themselves."""
    order, code = F.col("_ord"), F.col("item_code")
    own = rows.withColumn("day", date_key(F.col("doc_date"))).withColumn("alone", F.when(code == "", order))
    named = F.when(F.col("item_name") != "", order)
    own = own.groupBy("item_code", "alone", "doc_no", "link_no", "day", "company", "dept1", "dept2").agg(F.sum("qty").alias("qty"), F.sum("amount").alias("amount"), F.min_by("item_name", named).alias("item_name"), F.min(named).alias("_named"), F.min("_ord").alias("_ord"))
    return own.groupBy("item_code", "alone").agg(
        F.sum("qty").alias("qty"), F.sum("amount").alias("amount"), unique_text("doc_no", order, ",").alias("doc_no"), unique_text("link_no", order, ",").alias("link_nos"), unique_text("day", order, ",").alias("date"),
        *(unique_text(c, order, ",").alias(c) for c in ("company", "dept1", "dept2")), F.coalesce(F.min_by("item_name", F.col("_named")), F.lit("")).alias("item_name"), F.min("_ord").alias("_ord"),
    )


def _block(oa: DataFrame, erp: DataFrame, number: int, missing_remark: str | None) -> DataFrame:
    """Items of both row sets paired by code, then the rows without one. ``missing_remark``: the
    counterpart's rows are none, which goes before an item's own remark."""
    a, b = _materials(oa), _materials(erp)
    left = lambda d: d.select(*(F.col(c).alias(f"oa_{c}") for c in _SIDE), F.col("_ord").alias("oa_ord"))
    right = lambda d: d.select(*(F.col(c).alias(f"erp_{c}") for c in _SIDE), F.col("_ord").alias("erp_ord"))
    paired = left(a.filter("alone is null")).join(right(b.filter("alone is null")), F.col("oa_item_code") == F.col("erp_item_code"), "full_outer").withColumn("part", F.when(F.col("oa_ord").isNotNull(), 0).otherwise(1))
    rows = paired.unionByName(left(a.filter("alone is not null")).withColumn("part", F.lit(2)), allowMissingColumns=True).unionByName(right(b.filter("alone is not null")).withColumn("part", F.lit(3)), allowMissingColumns=True)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("decimal(38,10)"))
    diff = round2(zero("oa_qty") - zero("erp_qty"))
    own = F.when(F.col("erp_ord").isNull(), ERP_LACKS_ITEM).when(F.col("oa_ord").isNull(), OA_LACKS_ITEM).when(diff == 0, QTY_EQUAL).otherwise(QTY_DIFFERENT)
    remark = F.when(F.col("part") == 2, NO_OA_ITEM_CODE).when(F.col("part") == 3, NO_ERP_ITEM_CODE).otherwise(F.lit(missing_remark) if missing_remark else own)
    texts = [f"{side}_{c}" for side in ("oa", "erp") for c in _SIDE if c not in ("qty", "amount")]
    numbers = [f"{side}_{c}" for side in ("oa", "erp") for c in ("qty", "amount")]
    return rows.select(
        F.lit(number).alias("block"), "part", "oa_ord", "erp_ord", *(F.coalesce(c, F.lit("")).alias(c) for c in texts), *(shown(F.col(c)).alias(c) for c in numbers),
        diff.cast("double").alias("qty_diff"), shown(zero("oa_amount") - zero("erp_amount")).alias("amount_diff"), remark.alias("remark"),
    )


def lookup_rows(oa: DataFrame, erp: DataFrame, mode: str, doc_no: str, ordered: bool = True) -> DataFrame:
    """The rows of one document number, without a check that it exists.

    Rows with a link to an existing counterpart and the others are built as two blocks, so an item
    may stand in both. From the ERP side differences are recomputed from what is shown.
    """
    from_oa = mode == OA_MODE
    main, other = (oa, erp) if from_oa else (erp, oa)
    own = with_text(main, "doc_no", doc_no)
    linked, unlinked = split_by_presence(own, "link_no", other, "doc_no")
    theirs = other.join(distinct_text(linked, "link_no").withColumnRenamed("link_no", "doc_no"), "doc_no", "left_semi")
    none = other.filter(F.lit(False))
    if from_oa:
        blocks = _block(linked, theirs, 0, None).union(_block(unlinked, none, 1, NO_ERP_DOC))
    else:
        blocks = _block(theirs, linked, 0, None).union(_block(none, unlinked, 1, NO_OA_DOC))
        less = lambda a, b: (F.col(a).cast("decimal(28,2)") - F.col(b).cast("decimal(28,2)")).cast("double")
        blocks = blocks.withColumns({"qty_diff": less("erp_qty", "oa_qty"), "amount_diff": less("erp_amount", "oa_amount")})
    blocks = blocks.orderBy("block", "part", "oa_ord", "erp_ord") if ordered else blocks
    sides = [[f"{s}_{c}" for c in _SIDE] for s in (("oa", "erp") if from_oa else ("erp", "oa"))]
    return blocks.select(F.lit(ITEM_ROW).alias("row_type"), F.lit(LOOKUP_OA if from_oa else LOOKUP_ERP).alias("lookup_type"), F.lit(doc_no).alias("matched_doc_no"), *sides[0], *sides[1], "qty_diff", "amount_diff", "remark")


def lookup_document(oa: DataFrame, erp: DataFrame, mode: str, doc_no: str) -> LookupResult:
    main, name = (oa, "OA表单编号") if mode == OA_MODE else (erp, "ERP单据编号")
    if with_text(main, "doc_no", doc_no).isEmpty():
        return LookupResult(None, f"未找到{name}：{doc_no}")
    return LookupResult(lookup_rows(oa, erp, mode, doc_no))


def lookup_suggestions(rows: DataFrame, mode: str, ordered: bool = True) -> DataFrame:
    """mode, doc_no, label of every document number: its dates, companies, departments and counterparts."""
    order = F.col("_ord")
    own = rows.filter("doc_no <> ''").withColumn("day", date_key(F.col("doc_date"))).withColumn("depts", dept_pair(F.col("dept1"), F.col("dept2")))
    own = own.groupBy("doc_no", "day", "company", "depts", "link_no").agg(F.min("_ord").alias("_ord"))
    found = own.groupBy("doc_no").agg(*(unique_text(c, order, ",").alias(c) for c in ("day", "company", "depts", "link_no")), F.min("_ord").alias("_ord"))
    other = F.when(F.col("link_no") != "", F.concat(F.lit("ERP: " if mode == OA_MODE else "OA: "), "link_no")).otherwise("")
    found = found.orderBy("_ord") if ordered else found
    return found.select(F.lit(mode).alias("mode"), "doc_no", label_of(F.col("doc_no"), F.col("day"), F.col("company"), F.col("depts"), other).alias("label"))


def organisation_suggestions(oa: DataFrame, erp: DataFrame, ordered: bool = True) -> DataFrame:
    """field, value: distinct organisation texts of both sides, in Chinese collation order."""
    both = oa.select("company", "dept1", "dept2").union(erp.select("company", "dept1", "dept2"))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("company", "dept1", "dept2"))))
    found = both.distinct().select(pairs.alias("p")).select("p.*").filter("value <> ''").distinct()
    return found.orderBy("field", F.collate("value", "zh")) if ordered else found
