"""Rows are dealt out once, in as many parts as their size needs."""

import re
import time

import pytest

from ledgerloom import shared
from ledgerloom.model import Direction, QueryFilters
from ledgerloom.operators.grain import doc_grain
from ledgerloom.operators.place import with_place
from ledgerloom.operators.precheck import DUPLICATE, precheck
from ledgerloom.plans.dept_summary import classified_documents, unmatched_documents
from ledgerloom.plans.detail import SUMMARY_READS, detail_compare, detail_summary, erp_only_rows
from ledgerloom.plans.doc_compare import compare_documents
from ledgerloom.plans.engine import ReconEngine
from ledgerloom.sources.tables import canonical

from .cases import ERP_ORDER, ORG, raw

OTHER = ("south", "", "hall 9")
OA = [
    ("F1", "Q1", "2026/5/1", *ORG, "M1", "a", 1, 10), ("F1", "Q2", "2026/5/2", *OTHER, "M2", "b", 2, 20), ("F2", "", "2026/5/1", *ORG, "M1", "a", 3, 1), ("F3", "Q9", "2026/5/1", "", "", "", "M1", "a", 4, 1),
    ("F3", "Q8", "2026/5/3", *ORG, "M1", "a", 5, 1), ("F4", "Q4", "2026/5/1", *ORG, "M1", "a", 1, 1), ("F5", "Q7", "2026/5/1", *ORG, "", "a", 1, 1), ("F6", "Q6", "2026/5/1", *ORG, "M1", "a", 0, 1),
]
ERP = [
    ("Q1", "2026/5/1", "F1", *ORG, "M1", "a", 1, 10), ("Q2", "2026/5/1", "F1", *ORG, "M2", "b", 1, 10), ("Q2", "2026/5/4", "F1", *ORG, "M2", "b", 1, 10), ("Q4", "2026/5/1", "F4", *ORG, "", "a", 1, 1),
    ("X1", "2026/5/1", "X1", *ORG, "M1", "a", 1, 1), ("X2", "2026/5/1", "", *ORG, "M1", "a", 1, 1), ("Q6", "2026/5/1", "F6", *ORG, "M3", "c", 0, 0), ("X3", "", "", *ORG, "M1", "a", 1, 1),
]


def sides(spark):
    return canonical(raw(spark, OA)), canonical(raw(spark, ERP, ERP_ORDER))


def dealt_by(df) -> list[str]:
    """What each shuffle of a plan deals rows out by."""
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString()))


def test_summary_deals_items_by_document_alone(spark):
    for direction in Direction:
        df = classified_documents(*sides(spark), direction)
        found = dealt_by(df)
        assert found.count("doc_no") == 1
        assert not [keys for keys in found if "item_code" in keys]
    docs = {r["doc_no"]: (r["company"], r["dept1"], r["dept2"], r["matched"], float(r["oa_qty"]), float(r["erp_qty"])) for r in classified_documents(*sides(spark)).collect()}
    assert docs["F1"] == ("north", "press", "hall 2", True, 3.0, 3.0)
    assert docs["F3"] == ("north", "press", "hall 2", False, 9.0, 0.0)
    assert docs["F4"] == ("north", "press", "hall 2", True, 1.0, 0.0)


def test_compare_deals_rows_by_document_alone(spark):
    oa, erp = sides(spark)
    df = compare_documents(erp, oa).summary(ordered=False)
    found = dealt_by(df)
    assert found.count("doc_no") == 2  # its own rows, and the other side's documents
    assert not [keys for keys in found if "day" in keys or "link_no, company" in keys]
    assert {r["doc_no"]: (r["doc_date"], r["link_nos"], r["qty"], r["cp_qty"]) for r in df.collect()} == {
        "Q1": ("2026-05-01", "F1", 1.0, 3.0), "Q2": ("2026-05-01、2026-05-04", "F1", 2.0, 3.0), "X1": ("2026-05-01", "X1", 1.0, 0.0), "X2": ("2026-05-01", "", 1.0, 0.0), "Q6": ("2026-05-01", "F6", 0.0, 0.0),
    }


def test_unmatched_documents_without_items(spark):
    for direction in Direction:
        for filters in (QueryFilters(), QueryFilters(company="north")):
            found = unmatched_documents(*sides(spark), direction, filters)
            assert not [keys for keys in dealt_by(found) if "item_code" in keys]
            want = classified_documents(*sides(spark), direction, filters).filter("NOT matched").select(*found.columns)
            rows = sorted(map(tuple, found.collect()))
            assert rows and rows == sorted(map(tuple, want.collect()))


def test_erp_only_rows_are_dealt_out_once(spark):
    oa, erp = sides(spark)
    df = erp_only_rows(erp, oa)
    assert {keys for keys in dealt_by(df)} <= {"deal, form_no", "form_no"}
    assert sorted((r["form_no"], r["item_code"], float(r["qty"])) for r in df.collect()) == [("", "M1", 1.0), ("X1", "M1", 1.0)]


def test_parts_grow_with_files(spark, tmp_path, monkeypatch):
    path, few = str(tmp_path / "t"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.range(2000).selectExpr("id", "uuid() AS t").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    size = shared.file_bytes(df)
    assert size == sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    monkeypatch.setattr(shared, "BYTES_A_PART", -(-size // 9))
    assert (shared.parts_for(spark, 0), shared.parts_for(spark, size)) == (few, 9)
    assert shared.dealt(df, "id", size=size).rdd.getNumPartitions() == 9


def shuffle_files(spark) -> set[str]:
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}


def gone(spark, before: set[str], seconds: float = 10) -> bool:
    """Whether no shuffle file is left but those that were there; files go by a message, so this waits for them."""
    until = time.monotonic() + seconds
    while (more := shuffle_files(spark) - before) and time.monotonic() < until:
        time.sleep(0.1)
    return not more


def test_steps_of_items_leave_no_shuffle(spark):
    oa, erp = sides(spark)
    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_before = shuffle_files(spark), spark.conf.get(conf)
    df = compare_documents(erp, oa).materials(ordered=False)
    assert gone(spark, before) and spark.conf.get(conf) == set_before
    found = dealt_by(df)
    assert not [keys for keys in found if "item_code" in keys]
    assert found.count("doc_no") <= 2  # items, and the documents' table
    assert sorted((r["doc_no"], r["item_code"], r["qty"], r["cp_qty"]) for r in df.collect()) == [
        ("Q1", "M1", 1.0, 1.0), ("Q1", "M2", 0.0, 2.0), ("Q2", "M1", 0.0, 1.0), ("Q2", "M2", 2.0, 2.0), ("Q6", "M1", 0.0, 0.0), ("Q6", "M3", 0.0, 0.0), ("X1", "M1", 1.0, 0.0), ("X2", "M1", 1.0, 0.0),
    ]


def test_links_with_their_first_order(spark):
    rows = [("F1", link, "2026/5/1", *ORG, "M1", "a", 1, 1) for link in ("Q2", "", "Q1", "Q2", "Q10", "Q1")]
    (found,) = doc_grain(canonical(raw(spark, rows))).collect()
    assert found["links"] == ["Q2", "Q1", "Q10"]
    assert {(p["t"], int(p["o"])) for p in found["linked"]} == {("Q2", 0), ("Q1", 2), ("Q10", 4)}
    assert len(found["linked"]) == 3


def test_details_in_slices_equal_those_at_once(spark, tmp_path, monkeypatch):
    for side, rows, order in (("oa", OA, None), ("erp", ERP, ERP_ORDER)):
        canonical(raw(spark, rows, *([order] if order else []))).write.parquet(str(tmp_path / side))
    oa, erp = (spark.read.parquet(str(tmp_path / side)) for side in ("oa", "erp"))
    conf, confs = "spark.sql.maxConcurrentOutputFileWriters", lambda: spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    for direction in Direction:
        want = [tuple(r) for r in detail_compare(oa, erp, direction).rows().collect()]
        rolled = sorted(map(tuple, detail_summary(detail_compare(oa, erp, direction).rows()).collect()))
        before, set_before = shuffle_files(spark), confs()
        monkeypatch.setattr(shared, "BYTES_A_SLICE", (shared.file_bytes(oa) + shared.file_bytes(erp)) // 4)
        found = detail_compare(oa, erp, direction).rows()
        assert gone(spark, before) and spark.conf.get(conf) == set_before
        assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()  # it is a table by now
        assert [tuple(r) for r in found.collect()] == want
        assert sorted(map(tuple, detail_summary(detail_compare(oa, erp, direction).rows(False, SUMMARY_READS)).collect())) == rolled
        monkeypatch.undo()


def test_diagnostics_keep_no_copies_and_no_shuffles(spark, monkeypatch):
    oa, erp = sides(spark)
    monkeypatch.setattr(type(oa), "persist", lambda *_: pytest.fail("both sides are copied"))
    before = shuffle_files(spark)
    rows = ReconEngine(oa, erp).diagnostics().collect()
    assert gone(spark, before)
    assert [(r.stage, r.rows_out) for r in rows if r.category == "阶段耗时"] == [("read_oa", "8"), ("read_erp", "8"), ("variance_summary", "1"), ("oa_doc_compare", "5"), ("erp_doc_compare", "5")]


def test_placing_rows_leaves_no_shuffle(spark):
    before = shuffle_files(spark)
    found = with_place(spark.range(2000).selectExpr("id", "hash(id) AS k").repartition(3, "k"), "k")
    assert gone(spark, before)
    rows = sorted((r["place"], r["k"]) for r in found.collect())
    assert [p for p, _ in rows] == list(range(1, 2001)) and [k for _, k in rows] == sorted(k for _, k in rows)


def test_steps_of_the_other_view_leave_no_shuffle(spark):
    oa, erp = sides(spark)
    before = shuffle_files(spark)
    df = compare_documents(oa, erp).materials(ordered=False)
    assert gone(spark, before)
    found = dealt_by(df)
    assert found.count("doc_no") <= 2 and not [keys for keys in found if "item_code" in keys]
    assert sorted((r["doc_no"], r["item_code"], r["qty"], r["cp_qty"]) for r in df.collect()) == [
        ("F1", "M1", 1.0, 1.0), ("F1", "M2", 2.0, 2.0), ("F2", "M1", 3.0, 0.0), ("F3", "M1", 9.0, 0.0), ("F4", "M1", 1.0, 0.0), ("F6", "M1", 0.0, 0.0), ("F6", "M3", 0.0, 0.0),
    ]


def test_rows_of_large_tables_are_not_dealt_out_to_find_repeated_keys(spark, monkeypatch):
    twice = [*OA, ("F1", "Q1", "2026/5/1", *ORG, "M1", "a", 1, 10)]
    both = raw(spark, twice), raw(spark, ERP, ERP_ORDER)
    want = sorted(map(tuple, precheck(*both, ordered=False).collect()))
    monkeypatch.setattr(shared, "BYTES_A_SLICE", 1)
    before = shuffle_files(spark)
    found = precheck(*both, ordered=False)
    assert gone(spark, before)
    assert len([keys for keys in dealt_by(found) if "item" in keys]) == 2  # only what is repeated, on each side
    assert sorted((r["source"], r["row_label"]) for r in found.collect() if r["issue_type"] == DUPLICATE) == [("ERP", "3,4"), ("OA", "2,10"), ("OA", "5,6")]
    assert sorted(map(tuple, found.collect())) == want
