"""DuckDB SQL equal to the registered queries, written from the rules and not from the plans."""

from __future__ import annotations

from .model import (
    EQUAL, ERP_HEADERS, ERP_LACKS_ITEM, ERP_ONLY_REMARK, ERP_VIEW, ITEM_ROW, ITEMS_DIFFER, LOOKUP_ERP, LOOKUP_OA, NO_ERP, NO_ERP_DOC, NO_OA, NO_OA_DOC, OA_HEADERS, OA_LACKS_ITEM, OA_VIEW, QTY_DIFFERENT,
    QTY_DIFFERS, QTY_EQUAL, SUMMARY_ROW, TYPE_PRIORITY, Direction,
)
from .operators import precheck as rules
from .queries import ERP_DOC, FEW_HEADS, FILTERS, GENERATED, HALF_HEADS, OA_DOC, OPEN_EVERY, SEARCH_TEXT, SEARCHES, SHEETS
from .sources.headers import AMBIGUOUS, NOT_FOUND
from .sources.sheet_source import FAILED, FULL, PRUNED

_SOURCE = """
lines AS (
  SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS part, l_quantity, l_extendedprice, l_discount, l_shipdate, l_suppkey, o_orderdate,
    r_name AS company, n_name AS dept1, c_mktsegment AS dept2, p_name AS item_name,
    'Q' || l_orderkey || CASE WHEN l_orderkey % 10 = 4 AND l_linenumber % 2 = 0 THEN '-B' ELSE '' END AS erp_doc,
    l_orderkey || lpad(l_linenumber::VARCHAR, 2, '0') || lpad(l_partkey::VARCHAR, 9, '0') || lpad(l_suppkey::VARCHAR, 8, '0') || lpad(l_quantity::BIGINT::VARCHAR, 3, '0')
      || lpad(datediff('day', DATE '1970-01-01', l_shipdate::DATE)::VARCHAR, 5, '0') AS place
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
), oa AS (
  SELECT 'F' || k AS doc_no, CASE WHEN k % 20 = 5 THEN '' ELSE erp_doc END AS link_no, o_orderdate::DATE AS doc_date, company, dept1, dept2, 'M' || part AS item_code, item_name,
    l_quantity::DECIMAL(28,10) AS qty, l_extendedprice::DECIMAL(12,2)::DECIMAL(28,10) AS amount, (place || '0')::DECIMAL(38,0) AS ord, k, ln
  FROM lines
), erp AS (
  SELECT erp_doc AS doc_no, 'F' || k AS link_no, l_shipdate::DATE AS doc_date, company, dept1, dept2, 'M' || part || CASE WHEN k % 10 = 2 THEN '-ERP' ELSE '' END AS item_code, item_name,
    (l_quantity + CASE WHEN k % 10 = 3 THEN 1 ELSE 0 END)::DECIMAL(28,10) AS qty, (l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)))::DECIMAL(28,10) AS amount, (place || '0')::DECIMAL(38,0) AS ord, k, ln
  FROM lines WHERE k % 10 <> 0
  UNION ALL
  SELECT 'X' || k, 'X' || k, l_shipdate::DATE, company, dept1, dept2, 'MX' || part, item_name, l_quantity::DECIMAL(28,10),
    (l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)))::DECIMAL(28,10), (place || '1')::DECIMAL(38,0), k, ln
  FROM lines WHERE k % 10 = 1
)"""

_GENERATED = f"""
seq AS (SELECT range AS i FROM range({GENERATED})), oa AS (
  SELECT 'F' || lpad(i::VARCHAR, 6, '0') AS doc_no, 'QOUT' || lpad(i::VARCHAR, 6, '0') AS link_no, make_date(2026, 5, (i % 28 + 1)::INT) AS doc_date, '数控' AS company, '生产' AS dept1, '仓储' AS dept2,
    'MAT-' || lpad((i % 500)::VARCHAR, 4, '0') AS item_code, '物料' || (i % 500) AS item_name, 1::DECIMAL(28,10) AS qty, 10::DECIMAL(28,10) AS amount, i::DECIMAL(38,0) AS ord
  FROM seq
), erp AS (
  SELECT 'QOUT' || lpad(i::VARCHAR, 6, '0') AS doc_no, 'F' || lpad(i::VARCHAR, 6, '0') AS link_no, make_date(2026, 5, ((i + 1) % 28 + 1)::INT) AS doc_date, '数控' AS company, '生产' AS dept1, '仓储' AS dept2,
    'MAT-' || lpad((i % 500)::VARCHAR, 4, '0') || CASE WHEN i % 10 = 2 THEN '-ERP' ELSE '' END AS item_code, '物料' || (i % 500) AS item_name,
    (CASE WHEN i % 10 = 3 THEN 2 ELSE 1 END)::DECIMAL(28,10) AS qty, 10::DECIMAL(28,10) AS amount, (2 * i)::DECIMAL(38,0) AS ord
  FROM seq WHERE i % 10 <> 0
  UNION ALL SELECT 'ERPONLY' || lpad(i::VARCHAR, 6, '0'), 'ERPONLY' || lpad(i::VARCHAR, 6, '0'), make_date(2026, 5, ((i + 1) % 28 + 1)::INT), '数控', '生产', '仓储',
    'MAT-ERPONLY-' || lpad((i % 500)::VARCHAR, 4, '0'), '物料' || (i % 500), 1, 10, 2 * i + 1 FROM seq WHERE i % 10 = 1
  UNION ALL SELECT 'QOUT' || lpad(i::VARCHAR, 6, '0') || '-B', 'F' || lpad(i::VARCHAR, 6, '0'), make_date(2026, 5, ((i + 2) % 28 + 1)::INT), '数控', '生产', '仓储',
    'MAT-' || lpad((i % 500)::VARCHAR, 4, '0'), '物料' || (i % 500), 0, 0, 2 * i + 1 FROM seq WHERE i % 10 = 4
)"""

_FILTER = f"company = '{FILTERS.company}' AND doc_date BETWEEN DATE '{FILTERS.start_date}' AND DATE '{FILTERS.end_date}'"
_R = "round({}, 2)::DOUBLE"


def _r(x: str) -> str:
    return _R.format(x)


def _nonblank(c: str, order: str = "ord") -> str:
    return f"coalesce(arg_min({c}, {order}) FILTER ({c} <> ''), '') AS {c}"


def _compare(p: str, q: str, where: str = "TRUE", source: str = _SOURCE) -> str:
    return f"""WITH {source}, p AS (
  SELECT * FROM {p} WHERE doc_no <> '' AND item_code <> '' AND doc_date IS NOT NULL AND {where}
), q AS (SELECT * FROM {q} WHERE doc_no <> '' AND item_code <> ''
), p_item AS (SELECT doc_no, item_code, sum(qty) AS qty, sum(amount) AS amount, {_nonblank('item_name')} FROM p GROUP BY ALL
), p_link AS (SELECT doc_no, link_no, min(ord) AS link_ord FROM p WHERE link_no <> '' GROUP BY ALL
), days AS (SELECT doc_no, string_agg(d, '、' ORDER BY mo) AS doc_date FROM (SELECT doc_no, strftime(doc_date, '%Y-%m-%d') AS d, min(ord) AS mo FROM p GROUP BY ALL) GROUP BY ALL
), met AS (SELECT doc_no, string_agg(link_no, ',' ORDER BY link_ord) AS link_nos FROM p_link GROUP BY ALL
), sums AS (SELECT doc_no, min(ord) AS doc_ord, sum(qty) AS qty, sum(amount) AS amount, {', '.join(map(_nonblank, ('company', 'dept1', 'dept2')))} FROM p GROUP BY ALL
), p_doc AS (SELECT sums.*, days.doc_date, coalesce(met.link_nos, '') AS link_nos FROM sums JOIN days USING (doc_no) LEFT JOIN met USING (doc_no)
), q_item AS (SELECT doc_no, item_code, sum(qty) AS qty, sum(amount) AS amount, {_nonblank('item_name')}, min(ord) AS item_ord FROM q GROUP BY ALL
), m_item AS (
  SELECT l.doc_no, i.item_code, sum(i.qty) AS qty, sum(i.amount) AS amount, coalesce(arg_min(i.item_name, row(l.link_ord, i.item_ord)) FILTER (i.item_name <> ''), '') AS item_name
  FROM p_link l JOIN q_item i ON l.link_no = i.doc_no GROUP BY ALL
), m_doc AS (SELECT doc_no, sum(qty) AS qty, sum(amount) AS amount FROM m_item GROUP BY ALL
), both_items AS (
  SELECT coalesce(a.doc_no, b.doc_no) AS doc_no, coalesce(a.item_code, b.item_code) AS item_code, coalesce(nullif(a.item_name, ''), b.item_name, '') AS item_name,
    coalesce(a.qty, 0) AS qty, coalesce(a.amount, 0) AS amount, coalesce(b.qty, 0) AS cp_qty, coalesce(b.amount, 0) AS cp_amount
  FROM p_item a FULL JOIN m_item b ON a.doc_no = b.doc_no AND a.item_code = b.item_code
), docs AS (SELECT d.*, coalesce(m.qty, 0) AS cp_qty, coalesce(m.amount, 0) AS cp_amount FROM p_doc d LEFT JOIN m_doc m USING (doc_no))"""


_NUMBERS = ", ".join(f"{_r(c)} AS {c}" for c in ("qty", "amount")) + ", link_nos, " + ", ".join(f"{_r(c)} AS {c}" for c in ("cp_qty", "cp_amount")) + f", {_r('qty - cp_qty')} AS qty_diff, {_r('amount - cp_amount')} AS amount_diff"


def _summary(*args: str) -> str:
    return f"{_compare(*args)} SELECT '{SUMMARY_ROW}' AS row_type, company, dept1, dept2, doc_date, doc_no, {_NUMBERS}, '' AS item_code, '' AS item_name, '' AS remark FROM docs"


def _materials(p: str, q: str, where: str = "TRUE") -> str:
    return f"""{_compare(p, q)} SELECT '{ITEM_ROW}' AS row_type, company, dept1, dept2, doc_date, doc_no, {_NUMBERS}, item_code, item_name, '' AS remark
FROM (SELECT b.*, d.company, d.dept1, d.dept2, d.doc_date, d.link_nos FROM both_items b JOIN docs d USING (doc_no)) WHERE {where}"""


def _classified(forward: bool, where: str = "TRUE", source: str = _SOURCE) -> str:
    p, q = ("oa", "erp") if forward else ("erp", "oa")
    a, b = ("", "cp_") if forward else ("cp_", "")
    return f"""{_compare(p, q, where, source)}, shape AS (SELECT doc_no, bool_or((round(qty, 2) = 0) <> (round(cp_qty, 2) = 0)) AS mismatch FROM both_items GROUP BY ALL
), matched AS (SELECT DISTINCT doc_no FROM p_link WHERE link_no IN (SELECT doc_no FROM {q} WHERE doc_no <> '')
), classed AS (
  SELECT d.company, d.dept1, d.dept2, d.doc_no, d.doc_ord, m.doc_no IS NOT NULL AS matched, round(d.{a}qty, 2) AS oa_qty, round(d.{b}qty, 2) AS erp_qty, round(d.{a}amount, 2) AS oa_amount, round(d.{b}amount, 2) AS erp_cost,
    CASE WHEN m.doc_no IS NULL THEN '{NO_ERP if forward else NO_OA}' WHEN s.mismatch THEN '{ITEMS_DIFFER}' WHEN round(d.qty - d.cp_qty, 2) <> 0 THEN '{QTY_DIFFERS}' ELSE '{EQUAL}' END AS type
  FROM docs d LEFT JOIN shape s USING (doc_no) LEFT JOIN matched m USING (doc_no))"""



def _variance(forward: bool, where: str = "TRUE", source: str = _SOURCE) -> str:
    return f"{_rolled(forward, where, source)} FROM rolled"


def _rolled(forward: bool, where: str = "TRUE", source: str = _SOURCE) -> str:
    kinds = ", ".join(f"'{t}'" for t in TYPE_PRIORITY)
    return f"""{_classified(forward, where, source)}, rolled AS (
  SELECT company, dept1, dept2, count(*) AS n_docs, count(*) FILTER (matched) AS n_matched, count(*) FILTER (NOT matched) AS n_unmatched,
    count(*) FILTER (matched AND type IN ('{ITEMS_DIFFER}', '{QTY_DIFFERS}')) AS n_different, sum(oa_qty) AS oa, sum(erp_qty) AS erp, sum(oa_amount) AS oam, sum(erp_cost) AS erpc, list(DISTINCT type) AS kinds, min(doc_ord) AS doc_ord
  FROM classed GROUP BY company, dept1, dept2)
SELECT company, dept1, dept2, '{OA_VIEW if forward else ERP_VIEW}' AS perspective, n_docs, n_matched, n_unmatched, n_different, {_r('oa')} AS oa_qty, {_r('erp')} AS erp_qty, {_r('oa - erp')} AS qty_diff,
  {_r('oam')} AS oa_amount, {_r('erpc')} AS erp_cost, {_r('oam - erpc')} AS amount_diff, array_to_string(list_filter([{kinds}], lambda t: list_contains(kinds, t)), '、') AS types"""


def _unique(table: str, keys: str, column: str, order: str, delimiter: str, name: str) -> str:
    """A CTE of distinct non-blank texts of a column joined in order of first sight."""
    return f"{name} AS (SELECT {keys}, string_agg(x, '{delimiter}' ORDER BY mo) AS {name} FROM (SELECT {keys}, {column} AS x, min({order}) AS mo FROM {table} WHERE {column} <> '' GROUP BY ALL) GROUP BY ALL)"


def _groups(prefix: str, table: str, order: str, doc_numbers: bool) -> str:
    """CTEs that group rows of (form_no, item_code, …) the way detail compares need."""
    k = "form_no, item_code"
    parts = [_unique(f"{prefix}_rows", k, "day", order, "、", f"{prefix}_days"), _unique(f"{prefix}_rows", k, "doc_no", order, ",", f"{prefix}_docs")]
    return f"""{prefix}_rows AS ({table}), {', '.join(parts)}, {prefix} AS (
  SELECT s.*, coalesce(d.{prefix}_days, '') AS days, coalesce(n.{prefix}_docs, '') AS doc_nos FROM (
    SELECT {k}, sum(qty) AS qty, sum(amount) AS amount, arg_min(company, {order}) AS company, arg_min(dept1, {order}) AS dept1, arg_min(dept2, {order}) AS dept2, arg_min(item_name, {order}) AS item_name,
      coalesce(arg_min(link_no, {order}) FILTER (link_no <> ''), '') AS link_no, min({order}) AS ord FROM {prefix}_rows GROUP BY ALL) s
  LEFT JOIN {prefix}_days d USING (form_no, item_code) LEFT JOIN {prefix}_docs n USING (form_no, item_code))"""


_DAY = "strftime(doc_date, '%Y-%m-%d') AS day"


def _details(forward: bool) -> str:
    oa_rows = f"SELECT doc_no AS form_no, *, {_DAY} FROM oa WHERE doc_no <> '' AND item_code <> ''"
    if forward:
        o = _groups("o", oa_rows, "ord", False)
        links = "links AS (SELECT form_no, link_no AS doc_no, min(ord) AS link_ord FROM o WHERE link_no <> '' GROUP BY ALL)"
        e = _groups("e", f"SELECT l.form_no, e.*, row(l.link_ord, e.ord) AS by_ord, {_DAY} FROM links l JOIN erp e USING (doc_no) WHERE e.item_code <> ''", "by_ord", True)
        return f"WITH {_SOURCE}, {o}, {links}, {e}, only_rows AS (SELECT * FROM e WHERE FALSE)"
    g = _groups("g", f"SELECT link_no AS form_no, *, {_DAY} FROM erp WHERE item_code <> ''", "ord", True)
    o = _groups("o", oa_rows + " AND doc_no IN (SELECT form_no FROM g WHERE form_no <> '')", "ord", False)
    return f"WITH {_SOURCE}, {g}, {o}, e AS (SELECT * FROM g WHERE form_no IN (SELECT form_no FROM o)), only_rows AS (SELECT * FROM g WHERE form_no NOT IN (SELECT form_no FROM o))"


def _detail_rows(forward: bool) -> str:
    either = ", ".join(f"coalesce(nullif(o.{c}, ''), e.{c}, '') AS {c}" for c in ("item_name", "company", "dept1", "dept2"))
    cols = f"""coalesce(nullif(coalesce(o.form_no, e.form_no), ''), e.link_no, '') AS form_no, coalesce(o.link_no, '') AS oa_link_no, coalesce(o.days, '') AS oa_date, coalesce(e.doc_nos, '') AS erp_doc_nos,
  coalesce(e.link_no, '') AS erp_source_no, coalesce(e.days, '') AS erp_date, coalesce(o.item_code, e.item_code) AS item_code, {either},
  round(coalesce(o.qty, 0), 2) AS oq, round(coalesce(e.qty, 0), 2) AS eq, round(coalesce(o.amount, 0), 2) AS oamt, round(coalesce(e.amount, 0), 2) AS ec"""
    return f"""{_details(forward)}, joined AS (
  SELECT CASE WHEN e.form_no IS NULL AND o.form_no NOT IN (SELECT form_no FROM e) THEN '{NO_ERP}' WHEN o.form_no IS NULL OR e.form_no IS NULL THEN '{ITEMS_DIFFER}'
    WHEN round(o.qty, 2) <> round(e.qty, 2) THEN '{QTY_DIFFERS}' ELSE '{EQUAL}' END AS difference_type, {cols}
  FROM o FULL JOIN e ON o.form_no = e.form_no AND o.item_code = e.item_code
  UNION ALL SELECT '{NO_OA}', {cols} FROM only_rows e LEFT JOIN o ON FALSE
), details AS (
  SELECT difference_type, form_no, oa_link_no, oa_date, erp_doc_nos, erp_source_no, erp_date, item_code, item_name, company, dept1, dept2, oq::DOUBLE AS oa_qty, eq::DOUBLE AS erp_qty, (oq - eq)::DOUBLE AS qty_diff,
    oamt::DOUBLE AS oa_amount, ec::DOUBLE AS erp_cost, (oamt - ec)::DOUBLE AS amount_diff, CASE WHEN difference_type = '{NO_OA}' THEN '{ERP_ONLY_REMARK}' ELSE '' END AS remark
  FROM joined)"""


def _detail_summary(forward: bool) -> str:
    kinds = ", ".join(f"'{t}'" for t in TYPE_PRIORITY)
    return f"""{_detail_rows(forward)}, rolled AS (SELECT company, dept1, dept2, sum(oq) AS a, sum(eq) AS b, sum(oamt) AS c, sum(ec) AS d, list(DISTINCT difference_type) AS kinds FROM joined GROUP BY ALL)
SELECT company, dept1, dept2, {_r('a')} AS oa_qty, {_r('b')} AS erp_qty, {_r('a - b')} AS qty_diff, {_r('c')} AS oa_amount, {_r('d')} AS erp_cost, {_r('c - d')} AS amount_diff,
  array_to_string(list_filter([{kinds}], lambda t: list_contains(kinds, t)), '、') AS types FROM rolled"""


_GROUP_COLUMNS = f"form_no, item_code, {_r('qty')} AS qty, {_r('amount')} AS amount, company, item_name, link_no AS source_no, days, doc_nos"


def _lookup(oa_mode: bool, doc: str) -> str:
    main, other = ("oa", "erp") if oa_mode else ("erp", "oa")
    side = lambda t, p: f"""{p}_rows AS ({t}), {', '.join(_unique(f"{p}_rows", "block, item_code", c, "ord", ",", f"{p}_{c}") for c in ("doc_no", "link_no", "day", "company", "dept1", "dept2"))}, {p} AS (
  SELECT s.*, {', '.join(f"coalesce({p}_{c}.{p}_{c}, '') AS {c}" for c in ("doc_no", "link_no", "day", "company", "dept1", "dept2"))} FROM (
    SELECT block, item_code, sum(qty) AS qty, sum(amount) AS amount, {_nonblank("item_name")} FROM {p}_rows GROUP BY ALL) s {' '.join(f"LEFT JOIN {p}_{c} USING (block, item_code)" for c in ("doc_no", "link_no", "day", "company", "dept1", "dept2"))})"""  # noqa: E731
    first = f"SELECT *, {_DAY}, CASE WHEN link_no <> '' AND link_no IN (SELECT doc_no FROM {other}) THEN 0 ELSE 1 END AS block FROM {main} WHERE doc_no = '{doc}'"
    second = f"SELECT *, {_DAY}, 0 AS block FROM {other} WHERE doc_no IN (SELECT link_no FROM x_rows WHERE block = 0 AND link_no <> '')"
    a, b = ("x", "y") if oa_mode else ("y", "x")
    texts = lambda p, s: ", ".join(f"coalesce({p}.{c}, '') AS {s}_{n}" for c, n in (("doc_no", "doc_no"), ("link_no", "link_nos"), ("day", "date"), ("company", "company"), ("dept1", "dept1"), ("dept2", "dept2"), ("item_code", "item_code"), ("item_name", "item_name")))
    diff = lambda c: f"coalesce({a}.{c}, 0) - coalesce({b}.{c}, 0)" if oa_mode else f"round(coalesce({b}.{c}, 0), 2) - round(coalesce({a}.{c}, 0), 2)"
    missing = NO_ERP_DOC if oa_mode else NO_OA_DOC
    return f"""WITH {_SOURCE}, {side(first, 'x')}, {side(second, 'y')}
SELECT '{ITEM_ROW}' AS row_type, '{LOOKUP_OA if oa_mode else LOOKUP_ERP}' AS lookup_type, '{doc}' AS matched_doc_no, {texts(a, 'oa')}, {texts(b, 'erp')}, {_r(f'coalesce({a}.qty, 0)')} AS oa_qty, {_r(f'coalesce({a}.amount, 0)')} AS oa_amount,
  {_r(f'coalesce({b}.qty, 0)')} AS erp_qty, {_r(f'coalesce({b}.amount, 0)')} AS erp_amount, {_r(diff('qty'))} AS qty_diff, {_r(diff('amount'))} AS amount_diff,
  CASE WHEN coalesce({a}.block, {b}.block) = 1 THEN '{missing}' WHEN {b}.block IS NULL THEN '{ERP_LACKS_ITEM}' WHEN {a}.block IS NULL THEN '{OA_LACKS_ITEM}'
    WHEN round({a}.qty - {b}.qty, 2) = 0 THEN '{QTY_EQUAL}' ELSE '{QTY_DIFFERENT}' END AS remark
FROM {a} FULL JOIN {b} ON {a}.block = {b}.block AND {a}.item_code = {b}.item_code"""


def _suggestions(side: str, mode: str, prefix: str) -> str:
    rows = f"s_rows AS (SELECT *, {_DAY}, dept1 || '/' || dept2 AS depts FROM {side} WHERE doc_no <> '')"
    cols = ("day", "company", "depts", "link_no")
    return f"""WITH {_SOURCE}, {rows}, {', '.join(_unique('s_rows', 'doc_no', c, 'ord', ',', f's_{c}') for c in cols)}
SELECT '{mode}' AS mode, doc_no, concat_ws(' | ', doc_no, s_day, s_company, s_depts, '{prefix}: ' || s_link_no) AS label
FROM (SELECT DISTINCT doc_no FROM s_rows) {' '.join(f'LEFT JOIN s_{c} USING (doc_no)' for c in cols)}"""


_RAW = """, raw AS (
  SELECT side, doc_no, CASE WHEN defect = 3 THEN '' ELSE link_no END AS link_no,
    CASE WHEN defect = 0 THEN '2026/2/30' WHEN k % 3 = 0 THEN strftime(doc_date, '%Y-%m-%d') WHEN k % 3 = 1 THEN year(doc_date) || '/' || month(doc_date) || '/' || day(doc_date)
      ELSE ' ' || year(doc_date) || '.' || month(doc_date) || '.' || day(doc_date) || ' 10:30 ' END AS doc_date,
    company, CASE WHEN defect = 2 THEN '' ELSE item_code END AS item_code, CASE WHEN defect = 1 THEN '1,,2' ELSE qty::BIGINT::VARCHAR END AS qty,
    CASE WHEN k % 5 = 0 THEN format('{:,.4f}', amount::DOUBLE) ELSE amount::DECIMAL(28,4)::VARCHAR END AS amount, ord, ord::VARCHAR AS row_label, doc_date AS day, qty AS q, amount AS a, defect
  FROM (SELECT 'OA' AS side, *, CASE WHEN k % 97 = 0 THEN ln % 4 END AS defect FROM oa UNION ALL SELECT 'ERP', *, CASE WHEN k % 97 = 0 THEN ln % 4 END FROM erp))"""


def _issues(select: str) -> str:
    return f"WITH {_SOURCE}{_RAW} {select}"


def _issue(level: str, field: str, raw: str, kind: str, reason: str, suggestion: str, where: str, source: str = "raw") -> str:
    return f"SELECT '{level}' AS level, side AS source, row_label, {field} AS field, {raw} AS raw, '{kind}' AS issue_type, {reason} AS reason, '{suggestion}' AS suggestion FROM {source} WHERE {where}"


def _named(column: str) -> str:
    return f"CASE side WHEN 'OA' THEN '{OA_HEADERS[column]}' ELSE '{ERP_HEADERS[column]}' END"


_DATES = _issue(rules.ERROR, _named("doc_date"), "trim(doc_date)", rules.BAD_DATE, f"'{rules.BAD_DATE}：' || doc_date", rules.FIX_DATE, "defect = 0")
_NUMBERS_BAD = _issue(rules.ERROR, _named("qty"), "qty", rules.BAD_NUMBER, f"{_named('qty')} || '{rules.BAD_NUMBER}：' || qty", rules.FIX_NUMBER, "defect = 1")
_REQUIRED = " UNION ALL ".join(
    _issue(rules.ERROR, _named(c), "''", rules.BLANK_KEY, f"side || ' 第 ' || row_label || ' 行 ' || {_named(c)} || ' 为空，查询时无法稳定关联或汇总。'", rules.FIX_KEY, f"{c} = '' AND side IN ({sides})")
    for c, sides in (("doc_no", "'OA'"), ("item_code", "'OA', 'ERP'"), ("link_no", "'ERP'"))
)
_BLANK_LINKS = _issue(rules.HINT, f"'{OA_HEADERS['link_no']}'", "''", rules.BLANK_LINK, "'OA 第 ' || row_label || ' 行金蝶云单据编号为空，OA金蝶单号查ERP 时会归为 OA有申请，ERP无出库。'", rules.FIX_LINK, "side = 'OA' AND link_no = ''")
_DUPLICATES = f"""SELECT '{rules.HINT}' AS level, side AS source, string_agg(row_label, ',' ORDER BY ord) AS row_label, CASE side WHEN 'OA' THEN '{OA_HEADERS['doc_no']}+{OA_HEADERS['item_code']}' ELSE '{ERP_HEADERS['link_no']}+{ERP_HEADERS['item_code']}' END AS field,
  a || ' + ' || item_code AS raw, '{rules.DUPLICATE}' AS issue_type, side || ' 存在相同业务键的多行记录，查询宏会先合并后比较。' AS reason, '{rules.FIX_DUPLICATE}' AS suggestion
FROM (SELECT side, CASE side WHEN 'OA' THEN doc_no ELSE link_no END AS a, item_code, row_label, ord FROM raw) WHERE a <> '' AND item_code <> '' GROUP BY side, a, item_code HAVING count(*) > 1"""
_ORPHANS = f"""SELECT '{rules.HINT}' AS level, 'ERP' AS source, arg_min(row_label, ord) AS row_label, '{ERP_HEADERS['link_no']}' AS field, link_no AS raw, '{rules.ORPHAN}' AS issue_type, '{rules.ORPHAN_REASON}' AS reason, '{rules.FIX_ORPHAN}' AS suggestion
FROM raw WHERE side = 'ERP' AND link_no <> '' AND link_no NOT IN (SELECT doc_no FROM raw WHERE side = 'OA' AND doc_no <> '') GROUP BY link_no"""

_CANDIDATES = f"SELECT value FROM (SELECT arg_min(p_name, p_partkey) AS value, min(p_partkey) AS o FROM part WHERE p_name <> '' GROUP BY lower(p_name)) WHERE contains(lower(value), '{SEARCH_TEXT}') ORDER BY o LIMIT 30"
_ROWS = "doc_no, link_no, strftime(doc_date, '%Y-%m-%d') AS doc_date, company, dept1, dept2, item_code, item_name, qty::DOUBLE AS qty, amount::DOUBLE AS amount"

_PLACE = "SELECT company, dept1, doc_no, row_number() OVER (PARTITION BY company, dept1 ORDER BY doc_ord) AS place FROM docs"
_DIRECTIONS = ((Direction.FORWARD.value, True), (Direction.REVERSE.value, False))
_ORGANISATIONS = f"WITH {_SOURCE}, b AS (SELECT company, dept1, dept2 FROM oa UNION SELECT company, dept1, dept2 FROM erp) " + " UNION ".join(f"SELECT '{c}' AS field, {c} AS value FROM b WHERE {c} <> ''" for c in ("company", "dept1", "dept2"))

_HEADS = "[" + ", ".join(f"'{h}'" for h in OA_HEADERS.values()) + "]"
#: Rows of the folder of sheets with their numbers: titles, one header row (two of every eighth), then the requests.
_SHEET_ROWS = f"""SELECT sheet, sheet % 4 + 1 + row_number() OVER (PARTITION BY sheet ORDER BY ord) AS row, doc_no, link_no, CASE WHEN defect = 0 THEN '' ELSE strftime(day, '%Y-%m-%d') END AS doc_date, company, item_code,
  CASE WHEN defect = 1 THEN NULL ELSE q END::DOUBLE AS qty, a::DOUBLE AS amount FROM (SELECT *, regexp_extract(doc_no, '[0-9]+$')::BIGINT % {SHEETS} AS sheet FROM raw WHERE side = 'OA')"""
_SHEET_SHAPE = f"""shape AS (SELECT range AS sheet, range % 25 AS kind, range % 4 + 1 AS header_row, list_concat(({_HEADS})[range % 10 + 1 :], ({_HEADS})[: range % 10]) AS turned FROM range({SHEETS})
), found AS (SELECT *, CASE kind WHEN 7 THEN turned[:{FEW_HEADS}] WHEN 8 THEN turned[:{HALF_HEADS}] ELSE turned END AS heads FROM shape)"""
_OPENED = f"""{_compare('oa', 'erp')}, own AS (SELECT doc_no, item_code, min(ord) AS item_ord FROM p GROUP BY ALL
), others AS (SELECT l.doc_no, i.item_code, min(row(l.link_ord, i.item_ord)) AS met FROM p_link l JOIN q_item i ON l.link_no = i.doc_no GROUP BY ALL
), shown AS (
  SELECT '{SUMMARY_ROW}' AS row_type, doc_no, '' AS item_code, company, qty, cp_qty, amount, cp_amount, doc_ord, 0 AS below, NULL AS item_ord, NULL AS met FROM docs
  UNION ALL SELECT '{ITEM_ROW}', b.doc_no, b.item_code, d.company, b.qty, b.cp_qty, b.amount, b.cp_amount, d.doc_ord, 1, o.item_ord, CASE WHEN o.item_ord IS NULL THEN m.met END
  FROM both_items b JOIN docs d USING (doc_no) LEFT JOIN own o ON b.doc_no = o.doc_no AND b.item_code = o.item_code LEFT JOIN others m ON b.doc_no = m.doc_no AND b.item_code = m.item_code
  WHERE regexp_extract(b.doc_no, '[0-9]+$')::BIGINT % {OPEN_EVERY} = 0)
SELECT row_number() OVER (ORDER BY doc_ord, below, item_ord IS NULL, item_ord, met) AS place, row_type, doc_no, item_code, company, {_r('qty')} AS qty, {_r('cp_qty')} AS cp_qty, {_r('qty - cp_qty')} AS qty_diff, {_r('amount - cp_amount')} AS amount_diff FROM shown"""

ORACLE: dict[str, str] = {
    "dept_variance_oa": _variance(True),
    "dept_variance_erp": _variance(False),
    "dept_variance_filtered": _variance(False, _FILTER),
    "oa_doc_compare_summary": _summary("oa", "erp"),
    "erp_doc_compare_summary": _summary("erp", "oa"),
    "oa_doc_compare_material": _materials("oa", "erp"),
    "erp_doc_compare_material": _materials("erp", "oa"),
    "oa_doc_compare_filtered": _summary("oa", "erp", _FILTER),
    "oa_doc_expand": _materials("oa", "erp", f"doc_no = '{OA_DOC}'"),
    "oa_doc_order": f"{_compare('oa', 'erp')} {_PLACE}",
    "erp_doc_order": f"{_compare('erp', 'oa')} {_PLACE}",
    "dept_variance_order": f"SELECT perspective, company, dept1, dept2, row_number() OVER (ORDER BY doc_ord) AS place FROM ({_rolled(True)}, doc_ord FROM rolled)",
    "org_suggestions_order": f"SELECT field, value, row_number() OVER (PARTITION BY field ORDER BY value) AS place FROM ({_ORGANISATIONS})",
    "oa_doc_expand_order": f"WITH {_SOURCE} SELECT doc_no, item_code, row_number() OVER (ORDER BY min(ord)) AS place FROM oa WHERE doc_no = '{OA_DOC}' GROUP BY doc_no, item_code",
    "classified_documents": " UNION ALL ".join(f"(SELECT '{d}' AS direction, type, matched, count(*) AS n FROM ({_classified(f)} SELECT * FROM classed) GROUP BY type, matched)" for d, f in _DIRECTIONS),
    "unmatched_documents": " UNION ALL ".join(f"(SELECT '{d}' AS direction, doc_no, company, oa_qty::DOUBLE AS oa_qty, erp_qty::DOUBLE AS erp_qty FROM ({_classified(f)} SELECT * FROM classed) WHERE type IN ('{NO_ERP}', '{NO_OA}'))" for d, f in _DIRECTIONS),
    "detail_forward": f"{_detail_rows(True)} SELECT * FROM details",
    "detail_reverse": f"{_detail_rows(False)} SELECT * FROM details",
    "detail_summary_forward": _detail_summary(True),
    "detail_summary_reverse": _detail_summary(False),
    "erp_only_rows": f"WITH {_SOURCE}, {_groups('g', f'SELECT link_no AS form_no, *, {_DAY} FROM erp WHERE item_code <> {chr(39) * 2}', 'ord', True)} SELECT {_GROUP_COLUMNS} FROM g WHERE form_no NOT IN (SELECT doc_no FROM oa WHERE doc_no <> '')",
    "erp_rows_for_oa_source": f"WITH {_SOURCE}, {_groups('g', f'SELECT link_no AS form_no, *, {_DAY} FROM erp WHERE item_code <> {chr(39) * 2} AND link_no IN (SELECT doc_no FROM oa WHERE company = {chr(39)}{FILTERS.company}{chr(39)})', 'ord', True)} SELECT {_GROUP_COLUMNS} FROM g",
    "lookup_oa": _lookup(True, OA_DOC),
    "lookup_erp": _lookup(False, ERP_DOC),
    "lookup_suggestions_oa": _suggestions("oa", "oa_form_number", "ERP"),
    "lookup_suggestions_erp": _suggestions("erp", "erp_doc_number", "OA"),
    "org_suggestions": _ORGANISATIONS,
    "candidate_search_contains": _CANDIDATES,
    "candidate_search_bigram": _CANDIDATES,
    "precheck_bad_dates": _issues(_DATES),
    "precheck_bad_numbers": _issues(_NUMBERS_BAD),
    "precheck_required": _issues(_REQUIRED),
    "precheck_blank_link": _issues(_BLANK_LINKS),
    "precheck_duplicates": _issues(_DUPLICATES),
    "precheck_orphans": _issues(_ORPHANS),
    "precheck_all": _issues(" UNION ALL ".join((_DATES, _NUMBERS_BAD, _REQUIRED, _BLANK_LINKS, _DUPLICATES, _ORPHANS))),
    "canonical_totals": f"WITH {_SOURCE}{_RAW} SELECT side, company, CASE WHEN defect = 0 THEN '' ELSE strftime(day, '%Y-%m-%d') END AS day, count(*) AS n, sum(CASE WHEN defect = 1 THEN NULL ELSE q END)::DOUBLE AS qty, round(sum(a), 2)::DOUBLE AS amount FROM raw GROUP BY ALL",
    "normalize_dates": f"WITH {_SOURCE}{_RAW} SELECT DISTINCT doc_date AS raw, CASE WHEN defect = 0 THEN '' ELSE strftime(day, '%Y-%m-%d') END AS day FROM raw UNION ALL SELECT '#' || (range + 34000), strftime(DATE '1899-12-30' + (range + 34000)::INT, '%Y-%m-%d') FROM range(500)",
    "normalize_decimals": f"WITH {_SOURCE}{_RAW}, t AS (SELECT DISTINCT unnest([qty, amount]) AS raw FROM raw) SELECT raw, round(CASE WHEN regexp_full_match(raw, '[-+]?([0-9]+|[0-9]*\\.[0-9]+)|[-+]?[0-9]{{1,3}}(,[0-9]{{3}})+(\\.[0-9]+)?') THEN replace(raw, ',', '')::DECIMAL(28,10) END, 4)::DOUBLE AS value FROM t",
    "normalize_text": "SELECT p_partkey, trim(p_name) AS text, (SELECT string_agg(g, '|' ORDER BY o) FROM (SELECT lower(p_name)[i:i+1] AS g, min(i) AS o FROM range(1, length(p_name)) r(i) GROUP BY g)) AS grams, CASE WHEN length(p_name) <= 9 THEN '''= ' || p_name ELSE left('''= ' || p_name, 9) || '...' END AS note FROM part",
    "append_unique": f"WITH {_SOURCE}, u AS (SELECT doc_no, link_no, min(ord) AS mo FROM oa GROUP BY ALL) SELECT doc_no, coalesce(string_agg(link_no, ',' ORDER BY mo) FILTER (link_no <> ''), '') AS text FROM u GROUP BY doc_no",
    "header_detect": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{h}', '2')" for i, h in enumerate([*OA_HEADERS.values(), "note"])) + ") AS t(place, header, header_row)",
    "table_parse": f"WITH {_SOURCE}{_RAW} SELECT doc_no, link_no, CASE WHEN defect = 0 THEN '' ELSE strftime(day, '%Y-%m-%d') END AS doc_date, company, item_code, CASE WHEN defect = 1 THEN NULL ELSE q END::DOUBLE AS qty, a::DOUBLE AS amount, (ord + 1)::DECIMAL(38,0)::VARCHAR AS row_label FROM raw WHERE side = 'OA'",
    "sheets_parse": f"WITH {_SOURCE}{_RAW} SELECT * FROM ({_SHEET_ROWS}) WHERE sheet % 25 NOT IN (7, 8)",
    "sheets_headers": f"WITH {_SHEET_SHAPE} SELECT sheet, header_row, CASE kind WHEN 7 THEN '{NOT_FOUND}' WHEN 8 THEN '{AMBIGUOUS}' ELSE '' END AS issue_type, len(heads)::INT AS hits, (10 - len(heads))::INT AS n_missing, array_to_string(list_filter({_HEADS}, lambda h: NOT list_contains(heads, h)), ',') AS missing FROM found",
    "sheet_files_rows": f"WITH {_SOURCE}{_RAW}, {_SHEET_SHAPE}, every AS ({_SHEET_ROWS}) SELECT * FROM every WHERE sheet % 25 NOT IN (4, 7, 8) UNION ALL BY NAME SELECT sheet, header_row + 1 + (SELECT count(*) FROM every e WHERE e.sheet = f.sheet) AS row, "
    + ", ".join(f"CASE WHEN turned[1] = '{OA_HEADERS[c]}' THEN 'short' ELSE '' END AS {c}" for c in ("doc_no", "link_no", "company", "item_code")) + f", '' AS doc_date, CASE WHEN turned[1] = '{OA_HEADERS['qty']}' THEN NULL ELSE 0 END::DOUBLE AS qty, CASE WHEN turned[1] = '{OA_HEADERS['amount']}' THEN NULL ELSE 0 END::DOUBLE AS amount FROM found f WHERE kind = 3",
    "sheet_files_report": f"WITH {_SOURCE}{_RAW}, {_SHEET_SHAPE}, sized AS (SELECT sheet, count(*) AS n FROM ({_SHEET_ROWS}) GROUP BY sheet) SELECT sheet, CASE WHEN kind IN (4, 7, 8) THEN '{FAILED}' WHEN kind = 3 THEN '{FULL}' ELSE '{PRUNED}' END AS strategy, kind IN (3, 4, 7, 8) AS has_reason, CASE WHEN kind NOT IN (7, 8) THEN header_row END AS header_row, CASE WHEN kind IN (4, 7, 8) THEN 0 ELSE coalesce(n, 0) + (kind = 3)::BIGINT END AS n_rows, CASE WHEN kind NOT IN (7, 8) THEN 11::BIGINT END AS n_columns FROM found LEFT JOIN sized USING (sheet)",
    "matrix_shapes": """WITH o AS (SELECT o_orderkey, o_orderkey::VARCHAR AS k, o_custkey::VARCHAR AS c, o_orderstatus AS s FROM orders), m AS (
  SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN [[c]] WHEN 1 THEN [[s]] WHEN 2 THEN [[k, s, NULL, 'true']] WHEN 3 THEN [[k, c], [s]] WHEN 4 THEN [[k], ['1.5', s], [], ['x']] ELSE [] END AS r FROM o
), rows AS (SELECT o_orderkey, (generate_subscripts(r, 1) - 1)::INT AS row_at, unnest(r) AS cells FROM m) SELECT o_orderkey, row_at, (generate_subscripts(cells, 1) - 1)::INT AS col_at, unnest(cells) AS cell FROM rows""",
    "oa_output_place": f"{_compare('oa', 'erp')} SELECT row_number() OVER (ORDER BY doc_ord) AS place, doc_no, company FROM docs",
    "oa_output_with_items": _OPENED,
    "search_index_fields": f"WITH {_SOURCE}, c AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, {f if f in ('company', 'dept1', 'dept2') else 'doc_no'} AS value, min(ord) AS o FROM {'erp' if f == 'erp' else 'oa'} GROUP BY ALL" for f in ("company", "dept1", "dept2", "oa", "erp")) + "), q AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{f}', '{t}')" for f, t in SEARCHES) + ") AS t(field, query)) SELECT field, query, value FROM c JOIN q USING (field) WHERE value <> '' AND contains(lower(value), lower(query)) QUALIFY row_number() OVER (PARTITION BY field, query ORDER BY o) <= 30",
    "benchmark_generator_oa": f"WITH {_GENERATED} SELECT {_ROWS} FROM oa",
    "benchmark_generator_erp": f"WITH {_GENERATED} SELECT {_ROWS} FROM erp",
    "benchmark_dept_variance": _variance(True, source=_GENERATED),
    "benchmark_dept_variance_erp": _variance(False, source=_GENERATED),
}
