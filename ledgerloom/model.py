"""Contracts of the reconciliation engine: headers, parameters, row types, messages."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import DataFrame

#: Canonical columns of both sides, in contract order.
CANONICAL = ("doc_no", "link_no", "doc_date", "company", "dept1", "dept2", "item_code", "item_name", "qty", "amount")

# Source headers of each side, keyed by canonical column, in each side's own order.
OA_HEADERS = {
    "doc_no": "表单编号", "link_no": "金蝶云单据编号", "doc_date": "申请日期", "company": "公司简称", "dept1": "一级部门", "dept2": "二级部门",
    "item_code": "物料代码", "item_name": "物料名称", "qty": "数量", "amount": "实际预算金额mx",
}
ERP_HEADERS = {
    "doc_no": "单据编号", "doc_date": "日期", "link_no": "源单单号", "company": "区分公司简称", "dept1": "一级部门", "dept2": "二级部门",
    "item_code": "物料编码", "item_name": "物料名称", "qty": "实发数量", "amount": "总成本",
}

# Difference types in the order in which summaries list them.
NO_ERP = "OA有申请，ERP无出库"
NO_OA = "ERP出库对应OA未在当前OA数据中找到"
ITEMS_DIFFER = "OA和ERP都有，但物料明细不一致"
QTY_DIFFERS = "OA和ERP都有，但数量不同"
EQUAL = "OA和ERP都有，数量一致"
TYPE_PRIORITY = (NO_ERP, NO_OA, ITEMS_DIFFER, QTY_DIFFERS, EQUAL)

# Texts of results.
ERP_ONLY_REMARK = "请用 ERP 源单单号回 OA 系统补查，或确认 OA 导出表是否包含该流程。"
SUMMARY_ROW, ITEM_ROW = "汇总", "物料"
OA_VIEW, ERP_VIEW = "OA视角", "ERP视角"
NO_OA_ITEM_CODE, NO_ERP_ITEM_CODE = "OA物料编码为空，无法配对", "ERP物料编码为空，无法配对"
ERP_LACKS_ITEM, OA_LACKS_ITEM = "ERP缺少该物料", "OA缺少该物料"
QTY_EQUAL, QTY_DIFFERENT = "数量一致", "数量不同"
NO_ERP_DOC, NO_OA_DOC = "未找到对应ERP单据", "未找到对应OA单据"
LOOKUP_OA, LOOKUP_ERP = "查OA表单编号", "查ERP单据编号"
UNKNOWN, NOT_APPLICABLE = "无确切信息", "不适用"
NO_RESULT = "查询条件没有匹配到 {} 数据。"

# Display headers of the outputs, by internal column.
_ORG = {"company": "公司简称", "dept1": "一级部门", "dept2": "二级部门"}
OA_COMPARE_DISPLAY = {
    "row_type": "行类型", **_ORG, "doc_date": "OA申请日期", "doc_no": "OA单据号", "qty": "OA数量", "amount": "OA金额", "link_nos": "ERP单据号", "cp_qty": "ERP数量",
    "cp_amount": "ERP金额", "qty_diff": "数量差额", "amount_diff": "金额差额", "item_code": "物料编码", "item_name": "物料名称", "remark": "备注",
}
ERP_COMPARE_DISPLAY = OA_COMPARE_DISPLAY | {"doc_date": "ERP日期", "doc_no": "ERP单据号", "qty": "ERP数量", "amount": "ERP金额", "link_nos": "OA单据号", "cp_qty": "OA数量", "cp_amount": "OA金额"}
VARIANCE_DISPLAY = {
    **_ORG, "perspective": "查询视角", "n_docs": "主视角单据数", "n_matched": "已匹配单据数", "n_unmatched": "未匹配单据数", "n_different": "有差异单据数", "oa_qty": "OA数量合计",
    "erp_qty": "ERP实发数量合计", "qty_diff": "数量差额", "oa_amount": "OA实际预算金额mx合计", "erp_cost": "ERP总成本合计", "amount_diff": "金额差额", "types": "差异类型摘要",
}
DETAIL_DISPLAY = {
    "difference_type": "差异类型", "form_no": "OA表单编号", "oa_link_no": "OA金蝶云单据编号", "oa_date": "OA申请日期", "erp_doc_nos": "ERP出库单号", "erp_source_no": "ERP源单单号",
    "erp_date": "ERP日期", "item_code": "物料编码", "item_name": "物料名称", **_ORG, "oa_qty": "OA数量合计", "erp_qty": "ERP实发数量合计", "qty_diff": "数量差额",
    "oa_amount": "OA实际预算金额mx合计", "erp_cost": "ERP总成本合计", "amount_diff": "金额差额", "remark": "备注",
}
DETAIL_SUMMARY_DISPLAY = {**_ORG, **{k: DETAIL_DISPLAY[k] for k in ("oa_qty", "erp_qty", "qty_diff", "oa_amount", "erp_cost", "amount_diff")}, "types": "差异类型摘要"}
_LOOKUP_OA = {
    "oa_doc_no": "OA表单编号", "oa_link_nos": "OA记录的ERP单号", "oa_date": "OA申请日期", "oa_company": "OA公司简称", "oa_dept1": "OA一级部门", "oa_dept2": "OA二级部门",
    "oa_item_code": "OA物料编码", "oa_item_name": "OA物料名称", "oa_qty": "OA数量", "oa_amount": "OA金额",
}
_LOOKUP_ERP = {
    "erp_doc_no": "ERP单据编号", "erp_link_nos": "ERP记录的OA单号", "erp_date": "ERP日期", "erp_company": "ERP公司简称", "erp_dept1": "ERP一级部门", "erp_dept2": "ERP二级部门",
    "erp_item_code": "ERP物料编码", "erp_item_name": "ERP物料名称", "erp_qty": "ERP数量", "erp_amount": "ERP金额",
}
_LOOKUP_HEAD, _LOOKUP_TAIL = {"row_type": "行类型", "lookup_type": "查询类型", "matched_doc_no": "命中单号"}, {"qty_diff": "数量差额", "amount_diff": "金额差额", "remark": "备注"}
LOOKUP_OA_DISPLAY = {**_LOOKUP_HEAD, **_LOOKUP_OA, **_LOOKUP_ERP, **_LOOKUP_TAIL}
LOOKUP_ERP_DISPLAY = {**_LOOKUP_HEAD, **_LOOKUP_ERP, **_LOOKUP_OA, **_LOOKUP_TAIL}
PRECHECK_DISPLAY = {"level": "级别", "source": "数据源", "row_label": "行号", "field": "字段名", "raw": "原值", "issue_type": "问题类型", "reason": "原因", "suggestion": "处理建议"}
DIAGNOSTICS_DISPLAY = {"category": "类别", "stage": "阶段", "rows_in": "输入行数", "rows_out": "输出行数", "ms": "耗时ms", "memory_mb": "内存MB", "note": "说明"}


class Direction(Enum):
    """Which side is filtered and which link is followed."""

    FORWARD = "OA金蝶单号查ERP"
    REVERSE = "ERP源单查OA"

    @classmethod
    def parse(cls, text: object) -> Direction:
        """Blank is the default; anything else must be a label."""
        clean = "" if text is None else str(text).strip()
        for one in cls:
            if clean in (one.value, "") or text is one:
                return one
        raise ValueError(f"查询方向不正确：请填写 {cls.FORWARD.value} 或 {cls.REVERSE.value}")


class OutputKind(Enum):
    VARIANCE = "variance_summary"
    OA_COMPARE = "oa_doc_compare"
    ERP_COMPARE = "erp_doc_compare"

    @classmethod
    def of_name(cls, name: str) -> OutputKind | None:
        """The kind of an output called ``name``, None for any other name."""
        return OUTPUT_NAMES.get(name)

    @property
    def direction(self) -> Direction | None:
        """Document compares fix their direction; the summary leaves it open."""
        return {OutputKind.OA_COMPARE: Direction.FORWARD, OutputKind.ERP_COMPARE: Direction.REVERSE}.get(self)


# Names of outputs.
OUTPUT_NAMES = {"报废差异汇总": OutputKind.VARIANCE, "OA视角单据对比": OutputKind.OA_COMPARE, "ERP视角单据对比": OutputKind.ERP_COMPARE}


class DataQualityError(ValueError):
    """A source cell that a strict query can't use."""


@dataclass(frozen=True)
class QueryFilters:
    """Organisation equality and an inclusive range of dates; an empty string is no restriction."""

    company: str = ""
    dept1: str = ""
    dept2: str = ""
    start_date: str = ""
    end_date: str = ""

    @classmethod
    def parse(cls, values: dict | None = None, **more: object) -> QueryFilters:
        """Trimmed texts and normalised dates; raises if a date is malformed or the range is inverted."""
        from .functions.values import parse_date_key, plain_text

        given = {**(values or {}), **more}
        out = cls(**{k: plain_text(given.get(k)) for k in ("company", "dept1", "dept2")}, **{k: parse_date_key(given.get(k)) for k in ("start_date", "end_date")})
        if out.start_date and out.end_date and out.start_date > out.end_date:
            raise ValueError(f"开始日期不能晚于结束日期：{out.start_date} > {out.end_date}")
        return out


@dataclass(frozen=True)
class QueryState:
    """Filters and direction of one query, as saved beside its output."""

    filters: QueryFilters = field(default_factory=QueryFilters)
    direction: Direction = Direction.FORWARD

    @classmethod
    def parse(cls, values: dict | None, kind: OutputKind | None = None) -> QueryState:
        values = values or {}
        fixed = kind.direction if kind else None
        return cls(QueryFilters.parse(values), fixed or Direction.parse(values.get("direction")))

    def to_dict(self) -> dict[str, str]:
        f = self.filters
        return {"company": f.company, "dept1": f.dept1, "dept2": f.dept2, "start_date": f.start_date, "end_date": f.end_date, "direction": self.direction.value}

    def with_filters(self, **changes: str) -> QueryState:
        return replace(self, filters=replace(self.filters, **changes))


@dataclass
class QueryResult:
    """Rows of a query, or the message shown when there are none."""

    df: DataFrame | None
    message: str = ""
    row_counts: dict[str, int] = field(default_factory=dict)
    held: DataFrame | None = None

    def release(self) -> None:
        """Let go of rows that were kept; the result can still be read, and is then worked out anew."""
        if self.held is not None:
            self.held.unpersist()


def display(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    """The output projection: contract columns in order under their display names."""
    from pyspark.sql import functions as F

    return df.select(*(F.col(c).alias(name) for c, name in headers.items()))
