import pytest
from pyspark.sql import functions as F

from ledgerloom.model import EQUAL, ITEMS_DIFFER, NO_ERP, NO_OA, QTY_DIFFERS, DataQualityError, Direction, OutputKind, QueryFilters, QueryState
from ledgerloom.operators.grain import item_grain
from ledgerloom.plans.dept_summary import department_summary
from ledgerloom.plans.detail import detail_compare, detail_summary, erp_groups, oa_groups
from ledgerloom.plans.doc_compare import COLUMNS, compare_documents
from ledgerloom.plans.engine import ReconEngine
from ledgerloom.plans.lookup import ERP_MODE, OA_MODE, _materials, lookup_document, lookup_suggestions
from ledgerloom.sources.generator import generate_erp, generate_oa

from .cases import ERP_ORDER, FILTER, ORG, erp, oa, raw, values

FILTERS = QueryFilters.parse(FILTER)


def pair(spark):
    """One request of three items, of which the movement books one short, one over and one not at all; another month's pair."""
    return (
        oa(spark, ("R-17", "S-40", "2026/5/9", *ORG, "bolt", "Bolt M6", 12, 30), ("R-17", "S-40", "2026/5/9", *ORG, "nut", "Nut M6", 7, 3.5), ("R-17", "S-40", "2026/5/9", *ORG, "pin", "Pin", 1, 9), ("R-18", "S-41", "2026/7/2", *ORG, "nut", "Nut M6", 4, 2)),
        erp(spark, ("S-40", "2026/5/11", "R-17", *ORG, "bolt", "Bolt M6", 11, 27.5), ("S-40", "2026/5/11", "R-17", *ORG, "nut", "Nut M6", 9, 4.5), ("S-41", "2026/7/3", "R-18", *ORG, "nut", "Nut M6", 4, 2)),
    )


def test_both_views(spark):
    a, b = pair(spark)
    found = compare_documents(a, b, FILTERS)
    assert values(found.summary(), *COLUMNS) == [("汇总", *ORG, "2026-05-09", "R-17", 20, 42.5, "S-40", 20, 32, 0, 10.5, "", "", "")]
    assert values(found.materials(), "item_code", "qty", "amount", "cp_qty", "cp_amount") == [("bolt", 12, 30, 11, 27.5), ("nut", 7, 3.5, 9, 4.5), ("pin", 1, 9, 0, 0)]
    found = compare_documents(b, a, FILTERS)
    assert values(found.summary(), *COLUMNS) == [("汇总", *ORG, "2026-05-11", "S-40", 20, 32, "R-17", 20, 42.5, 0, -10.5, "", "", "")]
    assert values(found.materials_of("S-40"), "item_code", "qty", "cp_qty") == [("bolt", 11, 12), ("nut", 9, 7), ("pin", 0, 1)]


def test_several_counterparts(spark):
    """Links in the order of first sight; what only a counterpart has comes after the document's own items."""
    a = oa(spark, ("R-3", "S-8", "2026/5/4", *ORG, "disc", "", 6, 18), ("R-3", "S-5", "2026/5/6", *ORG, "wire", "", 2.5, 5), ("R-3", "S-8", "2026/5/4", *ORG, "gear", "", 1, 40))
    b = erp(spark, ("S-5", "2026/5/7", "", *ORG, "wire", "", 2.5, 5), ("S-5", "2026/5/7", "", *ORG, "tape", "Tape", 8, 16), ("S-8", "2026/5/8", "", *ORG, "disc", "", 6, 18), ("S-8", "2026/5/8", "", *ORG, "gear", "", 2, 80))
    found = compare_documents(a, b)
    assert values(found.summary(), "qty", "amount", "doc_date", "link_nos", "cp_qty", "cp_amount", "qty_diff", "amount_diff") == [(9.5, 63, "2026-05-04、2026-05-06", "S-8,S-5", 18.5, 119, -9, -56)]
    assert values(found.materials(), "item_code", "item_name", "qty", "cp_qty") == [("disc", "", 6, 6), ("wire", "", 2.5, 2.5), ("gear", "", 1, 2), ("tape", "Tape", 0, 8)]


def test_a_link_that_several_documents_share_counts_in_each(spark):
    a = oa(spark, *((f"R-{i}", "S-1", "2026/5/4", *ORG, "disc", "", 3, 9) for i in range(3)))
    b = erp(spark, ("S-1", "2026/5/7", "", *ORG, "disc", "", 4, 12))
    assert values(compare_documents(a, b).summary(), "doc_no", "qty", "cp_qty") == [(f"R-{i}", 3, 4) for i in range(3)]


def test_differences_come_from_raw_sums(spark):
    a, b = oa(spark, ("A", "B", "2026/5/1", *ORG, "M", "", "1.005", 0)), erp(spark, ("B", "2026/5/1", "A", *ORG, "M", "", "0.004", 0))
    assert values(compare_documents(a, b).summary(), "qty", "cp_qty", "qty_diff") == [(1.01, 0, 1.0)]


def test_department_totals_come_from_rounded_documents(spark):
    a = oa(spark, *(("A%d" % i, "", "2026/5/1", *ORG, "M", "", "1.005", 0) for i in range(2)))
    assert values(department_summary(a, erp(spark)), "oa_qty", "n_unmatched", "types") == [(2.02, 2, NO_ERP)]


def test_department_views(spark):
    a = oa(spark, ("R-1", "S-1", "2026/5/2", *ORG, "disc", "", 9, 45), ("R-2", "S-7", "2026/5/3", *ORG, "disc", "", 4, 20), ("R-3", "S-3", "2026/5/3", *ORG, "gear", "", 5, 60))
    b = erp(spark, ("S-1", "2026/5/20", "R-1", *ORG, "disc", "", 6, 30), ("S-3", "2026/5/21", "R-3", *ORG, "gear", "", 5, 60))
    columns = ("perspective", "n_docs", "n_matched", "n_unmatched", "n_different", "oa_qty", "erp_qty", "qty_diff", "oa_amount", "erp_cost", "amount_diff", "types")
    assert values(department_summary(a, b, filters=FILTERS), *columns) == [("OA视角", 3, 2, 1, 1, 18, 11, 7, 125, 90, 35, f"{NO_ERP}、{QTY_DIFFERS}、{EQUAL}")]
    a = oa(spark, ("R-1", "", "2024/12/31", *ORG, "disc", "", 9, 45))
    b = erp(spark, ("S-1", "2026/5/20", "R-1", *ORG, "disc", "", 6, 30), ("S-9", "2026/5/25", "R-0", *ORG, "wire", "", 2, 7))
    assert values(department_summary(a, b, Direction.REVERSE, FILTERS), *columns) == [("ERP视角", 2, 1, 1, 1, 9, 8, 1, 45, 37, 8, f"{NO_OA}、{QTY_DIFFERS}")]


def test_shape_mismatch_and_zero_counterpart(spark):
    a = oa(spark, ("A", "B", "2026/5/1", *ORG, "M1", "", 1, 1))
    b = erp(spark, ("B", "2026/5/1", "A", *ORG, "M2", "", 1, 1))
    assert values(department_summary(a, b), "n_matched", "n_different", "qty_diff", "types") == [(1, 1, 0, ITEMS_DIFFER)]
    a, b = oa(spark, ("A", "B", "2026/5/1", *ORG, "M1", "", 0, 0)), erp(spark, ("B", "2026/5/1", "A", *ORG, "M1", "", 0, 0))
    assert values(department_summary(a, b), "n_matched", "n_different", "types") == [(1, 0, EQUAL)]
    b = erp(spark, ("B", "2026/5/1", "A", *ORG, "", "", 9, 9))  # a document without item codes is matched, with nothing in it
    a = oa(spark, ("A", "B", "2026/5/1", *ORG, "M1", "", 1, 1))
    assert values(department_summary(a, b), "n_matched", "types") == [(1, ITEMS_DIFFER)]


def test_detail_rounds_before_it_compares(spark):
    a = oa(spark, *(("A", "B", "2026/5/1", *ORG, "M", "", "0.335", 0) for _ in range(3)), ("A", "B", "2026/5/1", *ORG, "N", "", "1.004", 0))
    b = erp(spark, ("B", "2026/5/1", "A", *ORG, "M", "", "1.01", 0), ("B", "2026/5/1", "A", *ORG, "N", "", "1.005", 0))
    rows = values(detail_compare(a, b).rows(), "item_code", "oa_qty", "difference_type", "qty_diff")
    assert rows == [("M", 1.01, EQUAL, 0), ("N", 1.0, QTY_DIFFERS, -0.01)]


def test_detail_counts_a_shared_link_once_and_keeps_order(spark):
    a = oa(spark, ("F", "", "2026/5/1", *ORG, "M", "", 1, 1), ("F", "Q2", "2026/5/1", *ORG, "M", "", 1, 1), ("F", "Q2", "2026/5/1", *ORG, "N", "", 1, 1), ("G", "", "2026/5/1", *ORG, "M", "", 1, 1))
    b = erp(spark, ("Q2", "2026/5/3", "F", "other", "", "", "M", "", 2, 2), ("Q2", "2026/5/4", "F", "other", "", "", "N", "", 1, 1))
    rows = values(detail_compare(a, b, filters=FILTERS).rows(), "form_no", "item_code", "oa_link_no", "erp_qty", "difference_type")
    assert rows == [("F", "M", "Q2", 2, EQUAL), ("F", "N", "Q2", 1, EQUAL), ("G", "M", "", 0, NO_ERP)]


def test_detail_reverse(spark):
    a = oa(spark, ("F1", "", "2020/1/1", "x", "y", "z", "M", "", 1, 1))
    b = erp(spark, ("Q1", "2026/5/3", "F1", *ORG, "M", "", 1, 1), ("Q2", "2026/5/3", "F1", *ORG, "N", "", 1, 1), ("Q3", "2026/5/3", "", *ORG, "M", "", 1, 1), ("Q4", "2026/6/3", "F1", *ORG, "M", "", 5, 1))
    rows = detail_compare(a, b, Direction.REVERSE, FILTERS).rows()
    assert values(rows, "item_code", "oa_qty", "erp_qty", "difference_type") == [("M", 1, 1, EQUAL), ("N", 0, 1, ITEMS_DIFFER), ("M", 0, 1, NO_OA)]
    assert {r.types for r in detail_summary(rows).collect()} == {EQUAL, f"{NO_OA}、{ITEMS_DIFFER}"}


def test_detail_lists_are_built_from_distinct_rows(spark):
    """A hot group's ordered lists take one entry a date and document, however many rows it has."""
    rows = [(f"Q{i % 2}", f"2026/5/{3 + i % 3}", "", *ORG, "M", ("", "n")[i > 4], 1, 1) for i in range(300)]
    found = erp_groups(erp(spark, *rows).withColumn("form_no", F.col("link_no")), F.col("_ord"))
    assert [(r.qty, r.item_name, r.source_no, r.days, r.doc_nos) for r in found.collect()] == [(300, "", "", "2026-05-03、2026-05-04、2026-05-05", "Q0,Q1")]
    links = oa(spark, *(("F", ("", "E2", "E1")[i % 3], f"2026/5/{1 + i % 2}", *ORG, "M", "", 1, 1) for i in range(90)))
    assert [(r.qty, r.link_no, r.days) for r in oa_groups(links).collect()] == [(90, "E2", "2026-05-01、2026-05-02")]
    for df, keys in ((found, ("day", "doc_no")), (oa_groups(links), ("day",)), (_materials(links), ("doc_no", "link_no", "day", "company"))):
        steps = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in x]
        lists = next(i for i, x in enumerate(steps) if "collect_list" in x)
        below = steps[lists + 1].split("Aggregate [")[1].split("]")[0]
        assert all(k in below for k in keys)


def test_lookup(spark):
    own = ("2026/5/14", *ORG)
    a = oa(spark, ("R-5", "S-2", *own, "cog", "", 14, 7), ("R-5", "S-2", *own, "lid", "", 2, 3), ("R-5", "S-0", *own, "rod", "", 6, 6), ("R-5", "S-2", *own, "", "spare a", 1, 2), ("R-5", "S-2", *own, "", "spare b", 3, 2))
    b = erp(spark, ("S-2", "2026/5/15", "R-5", *ORG, "cog", "", 9, 4.5), ("S-2", "2026/5/15", "R-5", *ORG, "cap", "", 5, 1))
    rows = values(lookup_document(a, b, OA_MODE, "R-5").df, "oa_item_code", "erp_item_code", "qty_diff", "remark")
    assert rows == [("cog", "cog", 5, "数量不同"), ("lid", "", 2, "ERP缺少该物料"), ("", "cap", -5, "OA缺少该物料"), ("", "", 1, "OA物料编码为空，无法配对"), ("", "", 3, "OA物料编码为空，无法配对"), ("rod", "", 6, "未找到对应ERP单据")]
    rows = lookup_document(a, b, ERP_MODE, "S-2").df
    assert rows.columns[3:5] == ["erp_doc_no", "erp_link_nos"]
    assert values(rows.filter("erp_item_code = 'cog'"), "qty_diff", "amount_diff") == [(-5, -2.5)]
    assert lookup_document(a, b, OA_MODE, "x").message == "未找到OA表单编号：x"
    assert lookup_document(a, b, ERP_MODE, "x").message == "未找到ERP单据编号：x"


def test_suggestions(spark):
    a = oa(spark, ("R-6", "S-4", "2026/5/30", "north", "press", "hall 2", "cog", "", 1, 1), ("R-6", "S-3", "2026/6/1", "north", "press", "", "lid", "", 1, 1))
    assert values(lookup_suggestions(a, OA_MODE), "label") == [("R-6 | 2026-05-30,2026-06-01 | north | press/hall 2,press | ERP: S-4,S-3",)]
    b = erp(spark, *((f"S-{i}", "2026/5/1", "", *o, "cog", "", 1, 1) for i, o in enumerate((("上海", "研发", "二楼"), ("北京", "采购", ""), ("上海", "财务", "一楼")))))
    found = ReconEngine(a.limit(0), b).organisation_suggestions()
    assert found == {"company": ["北京", "上海"], "dept1": ["财务", "采购", "研发"], "dept2": ["二楼", "一楼"]}


def test_generator_expectations(spark):
    n = 10_000
    a, b = generate_oa(spark, n), generate_erp(spark, n)
    assert (a.count(), b.count()) == (n, 11_000)
    forward, reverse = department_summary(a, b).first(), department_summary(a, b, Direction.REVERSE).first()
    assert (forward.n_docs, forward.n_matched, forward.n_unmatched, forward.n_different) == (10_000, 9_000, 1_000, 2_000)
    assert (forward.oa_qty, forward.erp_qty, forward.oa_amount, forward.erp_cost) == (10_000, 10_000, 100_000, 90_000)
    assert (reverse.n_docs, reverse.n_matched, reverse.n_unmatched, reverse.n_different) == (11_000, 10_000, 1_000, 3_000)
    assert (reverse.oa_qty, reverse.erp_qty, reverse.oa_amount, reverse.erp_cost) == (10_000, 11_000, 100_000, 100_000)
    counts = lambda d: {r.difference_type: r["count"] for r in detail_compare(a, b, d).rows(False).groupBy("difference_type").count().collect()}
    assert counts(Direction.FORWARD) == {NO_ERP: 1000, ITEMS_DIFFER: 2000, QTY_DIFFERS: 1000, EQUAL: 7000}
    assert counts(Direction.REVERSE) == {NO_OA: 1000, ITEMS_DIFFER: 2000, QTY_DIFFERS: 1000, EQUAL: 7000}
    assert (compare_documents(a, b).materials(False).count(), compare_documents(b, a).materials(False).count()) == (11_000, 12_000)


def test_engine(spark):
    a, b = pair(spark)
    engine = ReconEngine(a, b)
    found = engine.run(OutputKind.VARIANCE, QueryState(FILTERS))
    assert found.df.columns[0] == "公司简称" and found.df.count() == 1
    assert engine.run(OutputKind.ERP_COMPARE, QueryState(FILTERS.parse(company="none"))).message == "查询条件没有匹配到 ERP 数据。"
    assert values(engine.expand(OutputKind.OA_COMPARE, "R-17"), "item_code") == [("bolt",), ("nut",), ("pin",)]
    with pytest.raises(ValueError, match="不支持的输出页类型"):
        engine.run("x")
    stages = {r.stage for r in engine.diagnostics().collect()}
    assert {"read_oa", "variance_summary", "spark"} <= stages


def test_strict_runs_name_the_first_bad_cell(spark):
    good = ("A", "B", "2026/5/1", *ORG, "M", "", 1, 1)
    rows = raw(spark, [good, ("A", "B", "2026/5/1", *ORG, "M", "", "1,,2", 1), ("A", "B", "2026/2/30", *ORG, "M", "", 1, 1)])
    other = raw(spark, [("B", "x", "A", *ORG, "M", "", 1, 1)], ERP_ORDER)
    from ledgerloom.sources.tables import canonical

    engine = ReconEngine(canonical(rows), canonical(other), raw_oa=rows, raw_erp=other)
    with pytest.raises(DataQualityError, match="数量数值格式不正确：1,,2"):
        engine.run(OutputKind.OA_COMPARE, strict_cells=True)
    with pytest.raises(DataQualityError, match="日期格式不正确：x"):
        engine.run(OutputKind.ERP_COMPARE, strict_cells=True)
    assert engine.run(OutputKind.OA_COMPARE).df.count() == 1


@pytest.mark.parametrize(("query", "most"), [("oa_doc_compare_summary", 2), ("oa_doc_compare_material", 4), ("detail_forward", 3), ("detail_reverse", 3), ("dept_variance_oa", 4), ("lookup_suggestions_oa", 1), ("precheck_bad_dates", 2), ("precheck_orphans", 2)])
def test_plans_read_the_canonical_table_few_times(spark, query, most):
    """The order lines are joined once a session; no plan goes back to them."""
    from ledgerloom.queries import QUERIES

    plan = QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "lineitem" not in plan
    assert plan.count("FileScan parquet") <= most
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_precheck_reads_each_side_once(spark):
    """Both sides' canonical rows are scanned by one job; what follows reads the narrow table it leaves."""
    from ledgerloom.queries import QUERIES
    from ledgerloom.sources.warehouse import canonical_table

    sf = "/root/testdata/sf0.001"
    canonical_table(spark, sf)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("precheck", "")
    try:
        found = QUERIES["precheck_all"](spark, sf)
        written = tracker.getJobIdsForGroup("precheck")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(written) == 1
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "canonical-" not in plan and plan.count("FileScan parquet") <= 6


@pytest.mark.parametrize(("direction", "most"), [(Direction.REVERSE, 1), (Direction.FORWARD, 5)])
def test_details_deal_wide_rows_out_once(spark, direction, most):
    """Groups, their meeting and what is asked of a whole form stay in the tasks that rows were dealt to."""
    rows = [("F1", "Q1", "2026/5/1", *ORG, "M", "", 1, 1)]
    a, b = oa(spark, *rows), erp(spark, ("Q1", "2026/5/1", "F1", *ORG, "M", "", 1, 1))
    plan = detail_compare(a, b, direction).rows(ordered=False)._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("Exchange hashpartitioning") <= most


def test_reverse_leaves_out_forms_that_nothing_was_shipped_for(spark):
    a = oa(spark, ("F1", "", "2026/5/1", *ORG, "M", "", 1, 1), ("F1", "", "2026/5/1", *ORG, "N", "", 2, 1), ("F2", "", "2026/5/1", *ORG, "M", "", 4, 1))
    b = erp(spark, ("Q1", "2026/5/1", "F1", *ORG, "M", "", 1, 1), ("Q2", "2026/5/2", "", *ORG, "M", "", 8, 1))
    rows = values(detail_compare(a, b, Direction.REVERSE).rows(), "form_no", "item_code", "oa_qty", "erp_qty", "difference_type")
    assert rows == [("F1", "M", 1, 1, EQUAL), ("F1", "N", 2, 0, ITEMS_DIFFER), ("", "M", 0, 8, NO_OA)]


def test_items_are_dealt_out_once(spark):
    """The first name that isn't blank, whatever is dealt where; one exchange from rows to items."""
    found = item_grain(oa(spark, ("F1", "", "2026/5/1", *ORG, "M", "", 1, 1), ("F1", "", "2026/5/1", *ORG, "M", "b", 2, 1), ("F1", "", "2026/5/1", *ORG, "M", "a", 4, 1)))
    assert values(found, "qty", "item_name") == [(7, "b")]
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
