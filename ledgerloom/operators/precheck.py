"""Data-quality rules over raw (text) tables; bad cells become issue rows and never stop a run.

Each side is read once: its cells are trimmed and parsed once and judged in one pass, which leaves a
narrow table of keys and issues. Duplicate keys and orphans are found in that table.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import norm_text, trimmed_date, trimmed_decimal
from ..model import ERP_HEADERS, OA_HEADERS
from ..shared import large, settled

_log = logging.getLogger(__name__)

ISSUE = ("level", "source", "row_label", "field", "raw", "issue_type", "reason", "suggestion")
ISSUE_DDL = ", ".join(f"{c} string" for c in ISSUE)

# Texts of issues.
ERROR, HINT, SYSTEM = "错误", "提醒", "系统"
BAD_DATE, FIX_DATE = "日期格式不正确", "改为 2026-05-01 或 2026/5/1 这类可识别日期。"
BAD_NUMBER, FIX_NUMBER = "数值格式不正确", "改为普通数字或千分位数字，避免混入文本单位、空格或非法逗号。"
BLANK_KEY, FIX_KEY = "关键字段为空", "补齐该字段，或确认该行是否应从原始数据中删除。"
BLANK_LINK = "金蝶云单据编号为空"
FIX_LINK = "OA金蝶单号查ERP 时，如果该 OA 已经生成金蝶出库单，请补齐金蝶云单据编号；如果尚未生成，可以保留该提醒。"
DUPLICATE, FIX_DUPLICATE = "业务键重复", "如果这些行确实是拆分明细，可以保留；否则检查是否重复导出。"
ORPHAN, ORPHAN_REASON, FIX_ORPHAN = "ERP源单未在OA中找到", "ERP 源单单号在 OA 全量表单编号中找不到。", "作为提醒输出，请用 ERP 源单单号回 OA 系统补查。"
NO_COLUMN, FIX_HEADER = "缺少关键列", "检查表头文字是否与模板完全一致，不要删除、重命名关键列，确认表头行没有被合并单元格或空行破坏。"
FAILED, FIX_SYSTEM = "预验证执行失败", "检查工作簿、工作表名称或宏运行环境。"
CLEAN = (HINT, SYSTEM, "", "", "", "未发现预验证问题", "未发现会阻断查询的预验证问题。", "可以继续运行查询。")

#: (rule number, column, what it checks) by side; numbers give the order of issues.
_CELL_RULES = {
    "OA": ((0, "doc_date", "date"), (2, "qty", "number"), (3, "amount", "number"), (6, "doc_no", "key"), (7, "item_code", "key"), (10, "link_no", "link")),
    "ERP": ((1, "doc_date", "date"), (4, "qty", "number"), (5, "amount", "number"), (8, "link_no", "key"), (9, "item_code", "key")),
}
_KEYS = {"OA": (11, ("doc_no", "item_code")), "ERP": (12, ("link_no", "item_code"))}
_ORPHANS = 13


def headers_of(source: str) -> dict[str, str]:
    return OA_HEADERS if source == "OA" else ERP_HEADERS


def _issue(rule: int, level: str, source: str, row_label: Column, field: str, raw: Column, kind: str, reason: Column, suggestion: str) -> Column:
    texts = (F.lit(level), F.lit(source), row_label, F.lit(field), raw, F.lit(kind), reason, F.lit(suggestion))
    return F.struct(F.lit(rule).alias("rule"), *(t.cast("string").alias(c) for t, c in zip(texts, ISSUE, strict=True)))


def _cell_issue(rule: int, source: str, column: str, check: str) -> Column:
    """The issue of one cell, null if there is none, over the columns of :func:`_parsed`."""
    cell, name, row, blank = F.col(column), headers_of(source)[column], F.col("row_label"), F.col(column) == ""
    if check == "date":
        reason = F.when(blank, "日期不能为空").otherwise(F.concat(F.lit(f"{BAD_DATE}："), F.col(f"raw_{column}")))
        return F.when(F.col(f"bad_{column}"), _issue(rule, ERROR, source, row, name, cell, BAD_DATE, reason, FIX_DATE))
    if check == "number":
        return F.when(F.col(f"bad_{column}"), _issue(rule, ERROR, source, row, name, cell, BAD_NUMBER, F.concat(F.lit(f"{name}{BAD_NUMBER}："), F.col(f"raw_{column}")), FIX_NUMBER))
    if check == "key":
        reason = F.concat(F.lit(f"{source} 第 "), row, F.lit(f" 行 {name} 为空，查询时无法稳定关联或汇总。"))
        return F.when(blank, _issue(rule, ERROR, source, row, name, F.lit(""), BLANK_KEY, reason, FIX_KEY))
    reason = F.concat(F.lit("OA 第 "), row, F.lit(" 行金蝶云单据编号为空，OA金蝶单号查ERP 时会归为 OA有申请，ERP无出库。"))
    return F.when(blank, _issue(rule, HINT, source, row, name, F.lit(""), BLANK_LINK, reason, FIX_LINK))


def _place(raw: DataFrame) -> Column:
    """A row's order in one form for all sources: the file, empty where rows are numbered as a whole, and the number."""
    if "file" in getattr(raw.schema["_ord"].dataType, "names", ()):
        return F.struct(F.col("_ord.file").alias("file"), F.col("_ord.place").cast("decimal(38,0)").alias("place"))
    return F.struct(F.lit("").alias("file"), F.col("_ord").cast("decimal(38,0)").alias("place"))


def _parsed(raw: DataFrame, rules: list[tuple[int, str, str]], keys: tuple[str, ...] = ()) -> DataFrame:
    """_ord, row_label, and of each column that a rule or key needs its trimmed text, whether it is malformed, and how it was written."""
    needed = dict.fromkeys([*(c for _, c, _ in rules), *keys])
    checked = {c: check for _, c, check in rules if check in ("date", "number")}
    trimmed = raw.select(_place(raw).alias("_ord"), F.coalesce("row_label", F.lit("")).alias("row_label"), *(norm_text(F.col(c)).alias(c) for c in needed), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"raw_{c}") for c in checked))
    bad = {"date": lambda c: trimmed_date(F.col(c)).isNull(), "number": lambda c: trimmed_decimal(F.col(c)).isNull()}
    return trimmed.withColumns({f"bad_{c}": bad[check](c) for c, check in checked.items()}) if checked else trimmed


def _found(rules: list[tuple[int, str, str]], source: str) -> Column:
    return F.array_compact(F.array(*(_cell_issue(rule, source, column, check) for rule, column, check in rules)))


def _listed(issues: DataFrame) -> DataFrame:
    return issues.select("_ord", F.explode("issues").alias("i")).select("i.*", "_ord")


def cell_issues(raw: DataFrame, source: str, checks: tuple[str, ...] = ("date", "number", "key", "link")) -> DataFrame:
    """Issues of single cells in one pass over the rows of a side."""
    rules = [(rule, column, check) for rule, column, check in _CELL_RULES[source] if check in checks]
    if not rules:
        return cell_issues(raw, source).filter(F.lit(False))
    return _listed(_parsed(raw, rules).select("_ord", _found(rules, source).alias("issues")))


def keyed_rows(raw: DataFrame, source: str, rules: list[tuple[int, str, str]] | None = None) -> DataFrame:
    """One narrow row a row of a side: its form or source form and item as trimmed texts, its order and label, and with
    ``rules`` its cells' issues."""
    form, item = _KEYS[source][1]
    rows = _parsed(raw, rules or [], (form, item))
    more = [_found(rules, source).alias("issues")] if rules else []
    return rows.select(F.lit(source).alias("source"), F.col(form).alias("form"), F.col(item).alias("item"), "_ord", "row_label", *more)


def _whole(keys: DataFrame) -> DataFrame:
    """Rows of a business key without a blank part."""
    return keys.filter((F.col("form") != "") & (F.col("item") != ""))


def _repeated(keys: DataFrame) -> DataFrame:
    """(source, form, item) of several rows. Those of large tables are kept as a table, so that their size is known before
    rows meet them: where few keys are repeated no row is dealt out for that."""
    found = _whole(keys).groupBy("source", "form", "item").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return settled(found, "repeated") if large(keys) else found


def _duplicates(keys: DataFrame, source: str, repeated: DataFrame) -> DataFrame:
    rule, columns = _KEYS[source]
    own = _whole(keys).filter(F.col("source") == source).select("form", "item", "_ord", "row_label")
    several = repeated.filter(F.col("source") == source).select("form", "item")
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_ord", "row_label"))), lambda r: r["row_label"]), ",")
    grouped = own.join(several, ["form", "item"], "left_semi").groupBy("form", "item").agg(F.min("_ord").alias("_ord"), rows.alias("rows"))
    names = "+".join(headers_of(source)[c] for c in columns)
    issue = _issue(rule, HINT, source, F.col("rows"), names, F.concat_ws(" + ", "form", "item"), DUPLICATE, F.lit(f"{source} 存在相同业务键的多行记录，查询宏会先合并后比较。"), FIX_DUPLICATE)
    return grouped.select("_ord", issue.alias("i")).select("i.*", "_ord")


def duplicate_issues(raw: DataFrame, source: str) -> DataFrame:
    """Business keys of several rows, with their row numbers; a key with a blank part is none.

    Only rows of repeated keys are listed. An issue names every row of its key, so its text grows with them.
    """
    keys = keyed_rows(raw, source)
    return _duplicates(keys, source, _repeated(keys))


def _orphans(keys: DataFrame) -> DataFrame:
    """One aggregation by form tells which forms only ERP rows have."""
    erp, forms = F.col("source") == "ERP", keys.filter("form <> ''")
    by_form = forms.groupBy("form").agg(F.bool_or(~erp).alias("known"), F.min(F.when(erp, F.struct("_ord", "row_label"))).alias("first"))
    issue = _issue(_ORPHANS, HINT, "ERP", F.col("first.row_label"), headers_of("ERP")["link_no"], F.col("form"), ORPHAN, F.lit(ORPHAN_REASON), FIX_ORPHAN)
    return by_form.filter("NOT known").select(F.col("first._ord").alias("_ord"), issue.alias("i")).select("i.*", "_ord")


def orphan_issues(raw_oa: DataFrame, raw_erp: DataFrame) -> DataFrame:
    """ERP source forms that no OA row has: one issue a form, at its first row."""
    return _orphans(keyed_rows(raw_oa, "OA").unionByName(keyed_rows(raw_erp, "ERP")))


def precheck(raw_oa: DataFrame, raw_erp: DataFrame, ordered: bool = True) -> DataFrame:
    """All issues in contract order: rule, side, column, row.

    Each side's rows are read once, when this is called: their keys and cell issues go to a narrow
    table in the shared folder, from which the issues are listed. The sides may come from sources
    of different kinds, whatever form their order has.
    """
    sides = [keyed_rows(raw, source, list(_CELL_RULES[source])) for source, raw in (("OA", raw_oa), ("ERP", raw_erp))]
    keys = settled(sides[0].unionByName(sides[1]), "precheck")
    cells, repeated = _listed(keys.filter(F.size("issues") > 0)), _repeated(keys)
    found = cells.unionByName(_duplicates(keys, "OA", repeated)).unionByName(_duplicates(keys, "ERP", repeated)).unionByName(_orphans(keys))
    return (found.orderBy("rule", "_ord") if ordered else found).select(*ISSUE)


def header_issues(spark: SparkSession, missing: dict[str, list[str]], header_rows: dict[str, str] | None = None) -> DataFrame:
    """One issue a source that lacks required headers; with one, rows aren't checked."""
    rows = []
    for source, names in missing.items():
        total = len(headers_of(source))
        text = f"缺失字段：{'、'.join(names)}。"
        reason = f"{source} 表缺少关键列：缺失 {len(names)}/{total} 个必需字段，无法继续预验证行级数据。 {text}"
        rows.append((ERROR, source, str((header_rows or {}).get(source, "")), "表头", "、".join(names), NO_COLUMN, reason, text + FIX_HEADER))
    return spark.createDataFrame(rows, ISSUE_DDL)


def detection_issue(source: str, error) -> tuple[str, ...]:
    """The issue of a table whose header wasn't found."""
    names = [n for n in error.missing if n]
    text = f"缺失字段：{'、'.join(names)}。" if names else ""
    return (ERROR, source, str(error.row_label), "表头", "、".join(names), error.issue_type, f"{error} {text}".rstrip(), text + FIX_HEADER)


def run_precheck(spark: SparkSession, load_oa, load_erp) -> DataFrame:
    """The whole check: each loader gives (raw rows, missing headers) or raises; the result is never empty."""
    from ..sources.headers import HeaderDetectionError

    loaded, issues, missing = {}, [], {}
    try:
        for source, load in (("OA", load_oa), ("ERP", load_erp)):
            try:
                loaded[source], lacking = load()
                if lacking:
                    missing[source] = lacking
            except HeaderDetectionError as e:
                issues.append(detection_issue(source, e))
        if issues:
            return spark.createDataFrame(issues, ISSUE_DDL)
        if missing:
            return header_issues(spark, missing)
        found = precheck(loaded["OA"], loaded["ERP"])
        return spark.createDataFrame([CLEAN], ISSUE_DDL) if found.isEmpty() else found
    except Exception as e:  # noqa: BLE001 - any other failure is one issue row by contract
        _log.warning("the precheck failed", exc_info=True)
        return spark.createDataFrame([(ERROR, SYSTEM, "", "", "", FAILED, str(e), FIX_SYSTEM)], ISSUE_DDL)
