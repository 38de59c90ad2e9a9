"""Detail compare at form-item grain, and its roll-up by organisation.

Here differences and classes come from rounded sums, and a link that several items of one form
share brings its ERP rows in once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import by_priority, date_key, first_text, round2, shown, unique_text
from ..model import EQUAL, ERP_ONLY_REMARK, ITEMS_DIFFER, NO_ERP, NO_OA, QTY_DIFFERS, TYPE_PRIORITY, Direction, QueryFilters
from ..operators.filters import keyed, selected
from ..shared import dealt, file_bytes, in_slices, settled

_ORG = ("company", "dept1", "dept2")
#: Parts that groups without a form are dealt over.
SPREAD = 64


def _deal(form: Column, item: Column) -> Column:
    """What a form's rows are dealt out by; rows without a form, of which there may be many, over SPREAD parts by item."""
    return F.xxhash64(form, F.when(form == "", F.pmod(F.xxhash64(item), F.lit(SPREAD))).otherwise(0))


def _distinct_grain(rows: DataFrame, keys: list[str], texts: list[str], link: str) -> DataFrame:
    """One row for each value of ``keys`` and ``texts``, with sums, the first order and row texts, and the first link that
    isn't blank with its order. It bounds the ordered lists of a group by its distinct texts, not its rows."""
    order, linked = F.col("_by"), F.when(F.col("link_no") != "", F.col("_by"))
    return rows.groupBy(*keys, *texts).agg(
        F.sum("qty").alias("qty"), F.sum("amount").alias("amount"), *(first_text(c, order).alias(c) for c in (*_ORG, "item_name")), F.min_by("link_no", linked).alias(link), F.min(linked).alias("_linked"), F.min("_by").alias("_by")
    )


def _first_link(link: str) -> Column:
    return F.coalesce(F.min_by(link, F.col("_linked")), F.lit(""))


def oa_groups(rows: DataFrame) -> DataFrame:
    """(form_no, item_code) of OA rows: sums, the first row's texts, the first link that isn't blank, distinct dates."""
    order = F.col("_by")
    own = keyed(rows).withColumn("day", date_key(F.col("doc_date"))).withColumn("_by", F.col("_ord")).withColumn("form_no", F.col("doc_no"))
    return _distinct_grain(own, ["form_no", "item_code"], ["day"], "_link").groupBy("form_no", "item_code").agg(
        F.sum("qty").alias("qty"), F.sum("amount").alias("amount"), *(first_text(c, order).alias(c) for c in (*_ORG, "item_name")), _first_link("_link").alias("link_no"), unique_text("day", order, "、").alias("days"), F.min("_by").alias("_ord")
    )


def erp_groups(rows: DataFrame, order: Column, dealt_by: tuple[str, ...] = ()) -> DataFrame:
    """(form_no, item_code) of ERP rows that carry the form they are grouped under; blank forms are one group an item.
    ``dealt_by`` names columns, settled by these two, that the rows are already dealt out by."""
    own = rows.filter("item_code <> ''").withColumn("day", date_key(F.col("doc_date"))).withColumn("_by", order)
    keys = [*dealt_by, "form_no", "item_code"]
    grain = _distinct_grain(own, keys, ["day", "doc_no"], "source_no")
    return grain.groupBy(*keys).agg(
        F.sum("qty").alias("qty"), F.sum("amount").alias("amount"), *(first_text(c, F.col("_by")).alias(c) for c in (*_ORG, "item_name")), _first_link("source_no").alias("source_no"),
        unique_text("day", F.col("_by"), "、").alias("days"), unique_text("doc_no", F.col("_by"), ",").alias("doc_nos"), F.min("_by").alias("_by"),
    )


def form_links(rows: DataFrame) -> DataFrame:
    """(form_no, doc_no) of OA rows: the documents that a form's items link to, each item by its first link, and the first
    order of an item that links there. Rows are dealt out once, by form."""
    linked = F.when(F.col("link_no") != "", F.col("_ord"))
    own = dealt(keyed(rows).select(F.col("doc_no").alias("form_no"), "item_code", "link_no", "_ord"), "form_no", size=file_bytes(rows))
    items = own.groupBy("form_no", "item_code").agg(F.min_by("link_no", linked).alias("link_no"), F.min("_ord").alias("_ord"))
    return items.filter("link_no <> ''").groupBy("form_no", F.col("link_no").alias("doc_no")).agg(F.min("_ord").alias("link_ord"))


def erp_rows_of_links(oa: DataFrame, erp: DataFrame) -> DataFrame:
    """ERP rows whose document an OA item links to, once for each form and link. The links are kept as a narrow table."""
    return erp.filter("item_code <> ''").join(settled(form_links(oa), "links"), "doc_no")


def erp_rows_of_sources(erp: DataFrame, groups: DataFrame) -> DataFrame:
    """ERP rows whose source form is among the forms of OA groups, grouped under it."""
    return erp.join(groups.select(F.col("form_no").alias("link_no")).distinct(), "link_no", "left_semi").withColumn("form_no", F.col("link_no"))


def erp_only_rows(erp: DataFrame, oa: DataFrame, filters: QueryFilters | None = None) -> DataFrame:
    """Filtered ERP groups whose source form no OA row has. Rows are dealt out once, by form, to see whether it is known;
    those left are grouped in the tasks that got them."""
    form = F.col("form_no")
    own = selected(erp, filters or QueryFilters()).filter("item_code <> ''").withColumn("form_no", F.col("link_no")).withColumn("deal", _deal(form, F.col("item_code")))
    forms = oa.filter("doc_no <> ''").select(F.col("doc_no").alias("form_no")).distinct().withColumn("deal", _deal(form, F.lit("")))
    size = file_bytes(erp)
    left = dealt(own, "deal", "form_no", size=size).join(dealt(forms, "deal", "form_no", size=size), ["deal", "form_no"], "left_anti")
    return erp_groups(left, F.col("_ord"), ("deal",)).drop("deal")


@dataclass
class DetailCompare:
    """OA rows, ERP rows under the form they are compared with, and the ERP rows' order. An ERP group whose form no OA
    group has stands for itself; ``only_shipped`` leaves out OA forms without ERP rows."""

    oa: DataFrame
    erp: DataFrame
    erp_order: Column
    only_shipped: bool = False

    def rows(self, ordered: bool = True, columns: tuple[str, ...] = ()) -> DataFrame:
        """Detail rows, all columns or those named. Large tables are gone through in slices of forms when this is called."""
        kept = lambda df, *more: df.select(*(columns or [c for c in df.columns if c not in _PLACE]), *more)
        run = lambda rows: kept(compare_groups(form_items(rows), self.only_shipped), *(_PLACE if ordered else ()))
        found = in_slices(form_rows(self.oa, self.erp, self.erp_order), _deal(F.col("form_no"), F.col("item_code")), run, "details", size=file_bytes(self.oa) + file_bytes(self.erp))
        return kept(found.orderBy(*_PLACE)) if ordered else found


def detail_compare(oa: DataFrame, erp: DataFrame, direction: Direction = Direction.FORWARD, filters: QueryFilters | None = None) -> DetailCompare:
    """Both sides' rows by form. Forward filters OA and follows its links; reverse filters ERP and looks its source forms up."""
    filters = filters or QueryFilters()
    if direction is Direction.FORWARD:
        own = selected(oa, filters)
        return DetailCompare(own, erp_rows_of_links(own, erp), F.struct("link_ord", "_ord"))
    return DetailCompare(oa, selected(erp, filters).withColumn("form_no", F.col("link_no")), F.col("_ord"), True)


def form_rows(oa: DataFrame, erp: DataFrame, erp_order: Column) -> DataFrame:
    """Rows of both sides with their form, in common columns."""
    common = [*_ORG, "item_name", "qty", "amount", "link_no", date_key(F.col("doc_date")).alias("day")]
    asked = keyed(oa).select(F.col("doc_no").alias("form_no"), "item_code", *common, F.lit("").alias("doc_no"), F.col("_ord").alias("oa_ord"))
    shipped = erp.filter("item_code <> ''").select("form_no", "item_code", *common, "doc_no", erp_order.alias("erp_ord"))
    return asked.withColumn("in_oa", F.lit(True)).unionByName(shipped.withColumn("in_oa", F.lit(False)), allowMissingColumns=True)


def form_items(rows: DataFrame) -> DataFrame:
    """(deal, form_no, item_code) of either side: the columns of :func:`oa_groups` as ``oa_``, those of :func:`erp_groups`
    as ``erp_``, and whether each side has rows.

    Rows of both sides are dealt out once, by form; what follows stays in the tasks that got them: groups, their meeting,
    and what is asked of a whole form. Rows without a form, of which there may be many, are dealt over SPREAD parts by
    item: no OA row has a blank form.
    """
    rows = rows.withColumn("deal", _deal(F.col("form_no"), F.col("item_code"))).repartition("deal")
    order = F.struct("oa_ord", "erp_ord")  # one of them is null for all rows of a side
    # one row for what shows the same: it bounds a group's ordered lists by its distinct texts, not its rows
    linked = F.when(F.col("link_no") != "", order)
    grain = rows.groupBy("deal", "form_no", "item_code", "in_oa", "day", "doc_no").agg(
        F.sum("qty").alias("qty"), F.sum("amount").alias("amount"), F.min_by(F.struct(*_ORG, "item_name"), order).alias("first"), F.min_by("link_no", linked).alias("link"), F.min(linked).alias("linked"), F.min("oa_ord").alias("oa_ord"), F.min("erp_ord").alias("erp_ord")
    )

    def side(prefix: str, mine: Column, link: str) -> list[Column]:
        own = lambda c: F.when(mine, c)
        sums = [F.sum(own(F.col(c))).alias(f"{prefix}_{c}") for c in ("qty", "amount")]
        return [*sums, F.min_by("first", own(order)).alias(f"{prefix}_first"), F.min_by("link", own(F.col("linked"))).alias(f"{prefix}_{link}"), unique_text(f"{prefix}_day", order, "、").alias(f"{prefix}_days"), F.min(f"{prefix}_ord").alias(f"{prefix}_ord"), F.max(mine).alias(f"in_{prefix}")]

    grain = grain.withColumns({"oa_day": F.when(F.col("in_oa"), F.col("day")), "erp_day": F.when(~F.col("in_oa"), F.col("day"))})
    groups = grain.groupBy("deal", "form_no", "item_code").agg(*side("oa", F.col("in_oa"), "link_no"), *side("erp", ~F.col("in_oa"), "source_no"), unique_text("doc_no", order, ",").alias("erp_doc_nos"))
    return groups.select("*", *(F.col(f"{p}_first.{c}").alias(f"{p}_{c}") for p in ("oa", "erp") for c in (*_ORG, "item_name"))).drop("oa_first", "erp_first")


#: What orders detail rows: what OA has, then ERP items that OA lacks, then ERP groups without any OA form.
_PLACE = ("part", "oa_ord", "erp_ord")


def compare_groups(both: DataFrame, only_shipped: bool = False) -> DataFrame:
    """Detail rows, with the columns that order them.

    Whether a form has rows on a side is told by a window over its rows, so each side's groups are made once.
    """
    has = F.col
    form = Window.partitionBy("deal", "form_no")
    both = both.withColumns({"asked": F.max("in_oa").over(form), "shipped": F.max("in_erp").over(form)})
    both = both.filter("shipped") if only_shipped else both
    kind = (
        F.when(~F.col("asked"), NO_OA)
        .when(~has("in_erp") & ~F.col("shipped"), NO_ERP)
        .when(~has("in_oa") | ~has("in_erp"), ITEMS_DIFFER)
        .when(round2(F.col("oa_qty")) != round2(F.col("erp_qty")), QTY_DIFFERS)
        .otherwise(EQUAL)
    )
    rows = both.withColumn("difference_type", kind).withColumn("part", F.when(has("in_oa"), 0).when(F.col("asked"), 1).otherwise(2))
    text = lambda c: F.coalesce(c, F.lit(""))
    either = lambda c: F.coalesce(F.nullif(f"oa_{c}", F.lit("")), text(f"erp_{c}"))
    less = lambda a, b: (round2(F.col(a)) - round2(F.col(b))).cast("double")
    number = F.coalesce(F.nullif("form_no", F.lit("")), text("erp_source_no"))
    return rows.select(
        "difference_type", number.alias("form_no"), text("oa_link_no").alias("oa_link_no"), text("oa_days").alias("oa_date"), text("erp_doc_nos").alias("erp_doc_nos"), text("erp_source_no").alias("erp_source_no"),
        text("erp_days").alias("erp_date"), "item_code", either("item_name").alias("item_name"), *(either(c).alias(c) for c in _ORG),
        shown(F.col("oa_qty")).alias("oa_qty"), shown(F.col("erp_qty")).alias("erp_qty"), less("oa_qty", "erp_qty").alias("qty_diff"),
        shown(F.col("oa_amount")).alias("oa_amount"), shown(F.col("erp_amount")).alias("erp_cost"), less("oa_amount", "erp_amount").alias("amount_diff"),
        F.when(F.col("difference_type") == NO_OA, ERP_ONLY_REMARK).otherwise("").alias("remark"), *_PLACE,
    )


_SUMMED = ("oa_qty", "erp_qty", "oa_amount", "erp_cost")
#: Columns of detail rows that their roll-up reads.
SUMMARY_READS = ("difference_type", *_ORG, *_SUMMED)


def detail_summary(details: DataFrame) -> DataFrame:
    """Detail rows rolled up by company and departments: sums of what the rows show, and the types found."""
    exact = {c: F.sum(F.col(c).cast("decimal(28,2)")) for c in _SUMMED}
    rolled = details.groupBy(*_ORG).agg(*(v.alias(c) for c, v in exact.items()), F.collect_set("difference_type").alias("kinds"))
    return rolled.select(
        *_ORG, shown(F.col("oa_qty")).alias("oa_qty"), shown(F.col("erp_qty")).alias("erp_qty"), shown(F.col("oa_qty") - F.col("erp_qty")).alias("qty_diff"),
        shown(F.col("oa_amount")).alias("oa_amount"), shown(F.col("erp_cost")).alias("erp_cost"), shown(F.col("oa_amount") - F.col("erp_cost")).alias("amount_diff"),
        by_priority(F.col("kinds"), TYPE_PRIORITY).alias("types"),
    )
