"""Document compare: one side's documents against those of the other side that they link to.

The two views are one plan with the sides swapped. The counterpart is never filtered, and a
counterpart document that several documents link to counts in each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import shown
from ..model import ITEM_ROW, SUMMARY_ROW, QueryFilters
from ..operators.filters import keyed, selected
from ..operators.grain import doc_grain, item_grain
from ..shared import dealt, file_bytes, settled

COLUMNS = ("row_type", "company", "dept1", "dept2", "doc_date", "doc_no", "qty", "amount", "link_nos", "cp_qty", "cp_amount", "qty_diff", "amount_diff", "item_code", "item_name", "remark")
#: What orders an output whose documents may show their items: document, summary before items, own items before others.
EXPANDED_ORDER = ("doc_ord", "below", "alone", "item_ord", "link_ord", "cp_ord")


@dataclass
class DocCompare:
    """One compare: rows of the filtered side, and of the other; parts that an output doesn't use never run."""

    primary: DataFrame
    counterpart: DataFrame

    def summary(self, ordered: bool = True) -> DataFrame:
        """One row a document. Its links are followed to the sums of whole counterpart documents and brought back in one
        line of steps, so each side is read once."""
        return _output(self._summary_rows(), SUMMARY_ROW, ["doc_ord"] if ordered else None)

    def _summary_rows(self) -> DataFrame:
        docs = doc_grain(self.primary)
        theirs = self.counterpart.groupBy(F.col("doc_no").alias("link_no")).agg(F.sum("qty").alias("cp_qty"), F.sum("amount").alias("cp_amount"))
        own = [c for c in docs.columns if c != "links"]
        met = docs.select(*own, F.explode_outer("links").alias("link_no")).join(theirs, "link_no", "left")
        return met.groupBy(*own).agg(F.sum("cp_qty").alias("cp_qty"), F.sum("cp_amount").alias("cp_amount"))

    def documents(self) -> DataFrame:
        """The filtered side's documents as :func:`doc_grain` gives them, without the other side."""
        return doc_grain(self.primary)

    def materials(self, ordered: bool = True) -> DataFrame:
        """Item rows: the document's own items in their order, then those of counterparts alone. What leads to them is kept
        as tables when this is called."""
        return _output(self.items(), ITEM_ROW, list(EXPANDED_ORDER[:1] + EXPANDED_ORDER[2:]) if ordered else None)

    def materials_of(self, doc_no: str) -> DataFrame:
        """The item rows of one document: what an expanded summary row shows."""
        return DocCompare(self.primary.filter(F.col("doc_no") == F.lit(doc_no)), self.counterpart).materials()

    def expanded(self, doc_nos: DataFrame) -> DataFrame:
        """The summary with the items of ``doc_nos`` (one column) below their documents, and the columns of EXPANDED_ORDER
        that put it in order. Without the item rows it is the summary as it was; only chosen documents' items are made."""
        chosen = doc_nos.select(F.col(doc_nos.columns[0]).alias("doc_no")).distinct()
        opened = DocCompare(settled(self.primary.join(chosen, "doc_no", "left_semi"), "opened"), self.counterpart)
        rows = _output(self._summary_rows(), SUMMARY_ROW, None, (*EXPANDED_ORDER[:1],)).withColumn("below", F.lit(0))
        return rows.unionByName(_output(opened.items(), ITEM_ROW, None, (*EXPANDED_ORDER[:1], *EXPANDED_ORDER[2:])).withColumn("below", F.lit(1)), allowMissingColumns=True)

    def items(self) -> DataFrame:
        """(doc_no, item_code) of the filtered side's documents and of those they link to, with both sides' sums and what
        their document shows.

        Three steps, each of which deals rows out once: documents with their links; what the links meet, by the other
        side's document; items, by document. The first two leave narrow tables, and what they shuffled is gone before the
        next begins.
        """
        docs = settled(doc_grain(self.primary).select("doc_no", "company", "dept1", "dept2", "doc_date", "link_nos", "linked", "doc_ord"), "documents")
        size = file_bytes(self.counterpart)
        theirs = dealt(self.counterpart.select(F.col("doc_no").alias("link_no"), "item_code", "item_name", "qty", "amount", "_ord"), "link_no", size=size)
        met = docs.select("doc_no", F.explode("linked").alias("l")).select("doc_no", F.col("l.t").alias("link_no"), F.col("l.o").alias("link_ord"))
        met = settled(met.join(item_grain(theirs, "link_no"), "link_no").select("doc_no", "item_code", F.col("qty").alias("cp_qty"), F.col("amount").alias("cp_amount"), F.col("item_name").alias("cp_name"), "link_ord", F.col("item_ord").alias("cp_ord")), "met")
        own = self.primary.select("doc_no", "item_code", "item_name", "qty", "amount", F.col("_ord").alias("item_ord"))
        rows = dealt(own.unionByName(met, allowMissingColumns=True), "doc_no", size=file_bytes(self.primary) + file_bytes(met))
        met_ord = F.when(F.col("cp_ord").isNotNull(), F.struct("link_ord", "cp_ord"))
        items = rows.groupBy("doc_no", "item_code").agg(
            *(F.sum(c).alias(c) for c in ("qty", "amount", "cp_qty", "cp_amount")), F.min_by("item_name", F.when(F.col("item_name") != "", F.col("item_ord"))).alias("item_name"),
            F.min_by("cp_name", F.when(F.col("cp_name") != "", met_ord)).alias("cp_name"), F.min("item_ord").alias("item_ord"), F.min(met_ord).alias("met_ord"),
        )
        return items.join(docs.drop("linked"), "doc_no").select(
            "doc_no", "item_code", F.coalesce("item_name", "cp_name", F.lit("")).alias("item_name"), "qty", "amount", "cp_qty", "cp_amount", "company", "dept1", "dept2", "doc_date", "link_nos", "doc_ord",
            F.col("item_ord").isNull().alias("alone"), "item_ord", F.col("met_ord.link_ord").alias("link_ord"), F.col("met_ord.cp_ord").alias("cp_ord"),
        )


def _output(rows: DataFrame, row_type: str, order: list[str] | None, keep: tuple[str, ...] = ()) -> DataFrame:
    blank = F.lit("")
    out = rows.orderBy(*order) if order else rows
    item = row_type == ITEM_ROW
    return out.select(
        F.lit(row_type).alias("row_type"), "company", "dept1", "dept2", "doc_date", "doc_no", shown(F.col("qty")).alias("qty"), shown(F.col("amount")).alias("amount"), "link_nos",
        shown(F.col("cp_qty")).alias("cp_qty"), shown(F.col("cp_amount")).alias("cp_amount"), *(shown(_zero(c) - _zero(f"cp_{c}")).alias(f"{c}_diff") for c in ("qty", "amount")),
        (F.col("item_code") if item else blank).alias("item_code"), (F.col("item_name") if item else blank).alias("item_name"), blank.alias("remark"), *keep,
    )


def _zero(c: str):
    return F.coalesce(F.col(c), F.lit(0).cast("decimal(38,10)"))


def compare_documents(primary: DataFrame, counterpart: DataFrame, filters: QueryFilters | None = None) -> DocCompare:
    """Compare ``primary`` under ``filters`` with all of ``counterpart``, both in canonical columns."""
    return DocCompare(keyed(selected(primary, filters or QueryFilters())), keyed(counterpart))
