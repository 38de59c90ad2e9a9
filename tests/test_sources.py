import pytest
from pyspark.sql import functions as F

from ledgerloom.model import ERP_HEADERS, OA_HEADERS, Direction, OutputKind, QueryState
from ledgerloom.operators.precheck import CLEAN, precheck, run_precheck
from ledgerloom.operators.search import bigram_index, distinct_candidates, distinct_suggestions, indexed_search, search
from ledgerloom.plans.engine import ReconEngine
from ledgerloom.sinks import error_frame, output_paths, read_metadata, read_report, write_diagnostics, write_lookup, write_output, write_precheck
from ledgerloom.sources.headers import HeaderDetectionError, detect_header
from ledgerloom.sources.tables import EmptyTableError, canonical, has_content, matrix_frame, parse_table, read_full, read_table
from ledgerloom.streaming.ingest import RAW_DDL, ingest, raw_stream

from .cases import ERP_ORDER, ORG, raw

HEADS = list(OA_HEADERS.values())


def test_header_below_titles():
    found = detect_header([["title"], ["note", ""], [*HEADS[::-1], " x "]], HEADS, first_row=1)
    assert (found.row, found.row_label, found.index[HEADS[0]]) == (2, "3", 9)
    assert detect_header([HEADS[:9]], HEADS).missing(HEADS) == HEADS[9:]


@pytest.mark.parametrize(
    ("rows", "kind"),
    [([HEADS[:4]], "无法识别表头"), ([], "无法识别表头"), ([HEADS[:6], HEADS[:6]], "表头识别不唯一"), ([[*HEADS, HEADS[0]]], "关键列重复")],
)
def test_header_failures(rows, kind):
    with pytest.raises(HeaderDetectionError) as e:
        detect_header(rows, HEADS)
    assert e.value.issue_type == kind and str(e.value).startswith(kind)


def test_header_ties():
    assert detect_header([HEADS, HEADS], HEADS).row == 0  # complete ties: the first
    assert detect_header([HEADS[:6], [*HEADS[:6], "more"]], HEADS).row == 1  # more filled cells


def test_parse_table(spark):
    sheet = matrix_frame(spark, [["t"], [*HEADS, "", "x"], ["F1", 12345.0, "2026/5/1", *ORG, "M", "n", "1,000", 2.5, "lost", "y"], [" ", None], ["F2"]])
    rows, meta = parse_table(sheet, OA_HEADERS, first_row=10)
    assert meta.header_row == "11"
    typed = canonical(rows).orderBy("_ord").collect()
    assert [(r.doc_no, r.link_no, r.row_label, float(r.qty)) for r in typed] == [("F1", "12345", "12", 1000.0), ("F2", "", "14", 0.0)]
    named, _ = parse_table(sheet, OA_HEADERS, prune=False)
    assert "x" in named.columns and named.first().row_label == "相对 UsedRange 第 3 行"
    assert has_content(sheet) and not has_content(matrix_frame(spark, [[" "], [None]]))


def test_read_table_prunes_and_falls_back(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).select(*(F.lit("1").alias(h) for h in HEADS), F.lit(0).alias("extra"), "id").write.parquet(path)
    rows, meta = read_table(spark, path, OA_HEADERS, order="id")
    assert meta.strategy == "pruned_columns"
    assert "extra" not in rows._jdf.queryExecution().executedPlan().toString()
    rows, meta = read_table(spark, path, ERP_HEADERS)
    assert meta.strategy == "full_read_fallback" and "单据编号" in meta.fallback_reason
    assert canonical(rows).count() == 3


def test_rows_of_files_are_called_by_their_number(spark, tmp_path):
    """However the files are split, a row's label is its own row below the header; files tell theirs apart."""
    heads = [F.concat(F.lit("v"), F.col("id")).alias(h) for h in HEADS]
    one, several = str(tmp_path / "one"), str(tmp_path / "several")
    spark.range(3000).coalesce(1).select(*heads, "id").write.option("parquet.block.size", 1024).parquet(one)
    spark.range(40).repartition(4).select(*heads).write.parquet(several)
    rows, _ = read_table(spark, one, OA_HEADERS)
    assert all(r.row_label == str(int(r.doc_no[1:]) + 2) for r in rows.repartition(5).collect())
    assert [r.row_label for r in rows.orderBy("_ord").collect()] == [str(i + 2) for i in range(3000)]
    rows, _ = read_table(spark, several, OA_HEADERS)
    labels = [r.row_label for r in rows.collect()]
    assert len(set(labels)) == 40 and all(":" in x for x in labels)
    rows, _ = read_table(spark, one, OA_HEADERS, order="id")
    assert rows.filter("row_label <> cast(_ord as string)").isEmpty()


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_rows_of_text_files_have_numbers_too(spark, tmp_path, fmt):
    """Files cut into many blocks, in any order: each row keeps its place."""
    heads = [F.concat(F.lit("v"), F.col("id")).alias(h) for h in HEADS]
    one, several, first = str(tmp_path / "one"), str(tmp_path / "several"), 2 if fmt == "csv" else 1
    spark.range(3000).coalesce(1).select(*heads).write.option("header", "true").format(fmt).save(one)
    spark.range(400).repartition(4).select(*heads).write.option("header", "true").format(fmt).save(several)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows, _ = read_table(spark, one, OA_HEADERS, fmt=fmt)
        assert rows.rdd.getNumPartitions() > 4
        assert all(r.row_label == str(int(r.doc_no[1:]) + first) for r in rows.collect())
        assert [r.row_label for r in rows.orderBy("_ord").collect()] == [str(i + first) for i in range(3000)]
        rows, _ = read_table(spark, several, OA_HEADERS, fmt=fmt)
        labels = [r.row_label for r in rows.collect()]
        assert len(set(labels)) == 400 and all(":" in x for x in labels)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_precheck_of_sources_of_different_kinds(spark, tmp_path):
    """A CSV and a Parquet source, and one with numbers of its own: the issues, not a failure."""
    ok = ("F1", "Q1", "2026/5/1", *ORG, "M", "", 1, 1)
    named = lambda rows, heads, *order: raw(spark, rows, *order).coalesce(1).select(*(F.col(c).cast("string").alias(h) for c, h in heads.items()))
    named([ok, ok], OA_HEADERS).write.option("header", "true").csv(str(tmp_path / "oa"))
    named([("Q1", "z", "F7", *ORG, "M", "", 1, 1)], ERP_HEADERS, ERP_ORDER).write.parquet(str(tmp_path / "erp"))
    want = [("ERP", "2", "日期格式不正确"), ("OA", "2,3", "业务键重复"), ("ERP", "2", "ERP源单未在OA中找到")]
    load = lambda side, heads, fmt: (read_table(spark, str(tmp_path / side), heads, fmt=fmt)[0], [])
    found = run_precheck(spark, lambda: load("oa", OA_HEADERS, "csv"), lambda: load("erp", ERP_HEADERS, "parquet"))
    assert [(r.source, r.row_label, r.issue_type) for r in found.collect()] == want
    sheet = matrix_frame(spark, [["t"], list(ERP_HEADERS.values()), ["Q1", "z", "F7", *ORG, "M", "", 1, 1]])
    found = run_precheck(spark, lambda: load("oa", OA_HEADERS, "csv"), lambda: (parse_table(sheet, ERP_HEADERS, first_row=1)[0], []))
    assert [(r.source, r.issue_type) for r in found.collect()] == [(s, t) for s, _, t in want]


def test_the_canonical_table_follows_its_source(spark, tmp_path):
    """Replaced source files, and a table that is gone, are seen by the next query; a session can remove its tables."""
    import shutil

    import duckdb

    from ledgerloom.queries import QUERIES
    from ledgerloom.sources.warehouse import canonical_table, forget_tables

    for name in ("lineitem", "orders", "customer", "nation", "region", "part"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", f"{tmp_path}/{name}.parquet")
    total = lambda: sum(r.n for r in QUERIES["canonical_totals"](spark, str(tmp_path)).collect())
    before, table = total(), canonical_table(spark, str(tmp_path))
    assert canonical_table(spark, str(tmp_path)) is table
    duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet' LIMIT 100) TO '{tmp_path}/lineitem.parquet'")
    after = total()
    assert 0 < after <= 300 < before
    shutil.rmtree(canonical_table(spark, str(tmp_path)).scratch_path.removeprefix("file://").removeprefix("file:"))
    assert total() == after
    path = canonical_table(spark, str(tmp_path)).scratch_path.removeprefix("file://")
    forget_tables(spark)
    assert not __import__("os").path.exists(path)


def test_precheck_names_rows_of_files(spark, tmp_path):
    ok = [("F1", "Q1", "2026/5/1", *ORG, "M", "", 1, 1), ("F1", "Q1", "2026/5/1", *ORG, "M", "", 1, 1)]
    for side, heads, rows, order in (("oa", OA_HEADERS, ok, None), ("erp", ERP_HEADERS, [("Q1", "z", "F7", *ORG, "M", "", 1, 1)], ERP_ORDER)):
        df = raw(spark, rows, order) if order else raw(spark, rows)
        df.coalesce(1).select(*(F.col(c).alias(h) for c, h in heads.items())).write.parquet(str(tmp_path / side))
    sides = [read_table(spark, str(tmp_path / side), heads)[0] for side, heads in (("oa", OA_HEADERS), ("erp", ERP_HEADERS))]
    assert [(r.source, r.row_label, r.issue_type) for r in precheck(*sides).collect()] == [("ERP", "2", "日期格式不正确"), ("OA", "2,3", "业务键重复"), ("ERP", "2", "ERP源单未在OA中找到")]


def test_empty_and_missing_tables_are_errors_with_their_name(spark, tmp_path):
    blank = str(tmp_path / "blank")
    spark.range(3).select(F.lit(" ").alias("a"), F.lit(None).cast("string").alias("b")).write.parquet(blank)
    for path in (blank, str(tmp_path / "none")):
        with pytest.raises(EmptyTableError, match="^requests："):
            read_full(spark, path, name="requests")
        with pytest.raises(EmptyTableError, match="^requests："):
            read_table(spark, path, OA_HEADERS, name="requests")


def test_a_key_of_very_many_rows(spark):
    """One document and item on 200,000 rows: what lists hold is bounded by distinct texts, not rows."""
    from ledgerloom.plans.dept_summary import department_summary
    from ledgerloom.plans.detail import detail_compare
    from ledgerloom.plans.doc_compare import compare_documents

    own = canonical(raw(spark, [("F1", f"Q{i % 3}", f"2026/5/{1 + i % 2}", *ORG, "M", "", 1, 1) for i in range(6)]).drop("row_label"))
    many = spark.range(200_000).select(F.col("id").alias("n")).join(own, F.pmod("n", F.lit(6)) == F.col("_ord")).drop("_ord").withColumnRenamed("n", "_ord")
    blank = many.withColumns({"link_no": F.lit(""), "doc_no": F.concat(F.lit("Q"), F.pmod("_ord", F.lit(3)))})
    found = compare_documents(many, blank).summary().collect()
    assert [(r.qty, r.cp_qty, r.link_nos, r.doc_date) for r in found] == [(200_000, 200_000, "Q0,Q1,Q2", "2026-05-01、2026-05-02")]
    assert department_summary(many, blank).first().n_matched == 1
    alone = detail_compare(many.limit(0), blank, Direction.REVERSE).rows().collect()
    assert [(r.erp_qty, r.erp_doc_nos, r.erp_date) for r in alone] == [(200_000, "Q0,Q1,Q2", "2026-05-01、2026-05-02")]


def test_canonical_types(spark):
    df = spark.createDataFrame([(1.0, "l", 45000.7, "c", "d", "e", 2.0, "n", 1.5, None, 0)], "doc_no double, link_no string, doc_date double, company string, dept1 string, dept2 string, item_code double, item_name string, qty double, amount double, _ord long")
    r = canonical(df).first()
    assert (r.doc_no, str(r.doc_date), r.item_code, float(r.qty), float(r.amount)) == ("1", "2023-03-15", "2", 1.5, 0.0)


def issues(spark, oa_rows, erp_rows):
    return [tuple(r) for r in precheck(raw(spark, oa_rows), raw(spark, erp_rows, ERP_ORDER)).collect()]


def test_precheck_rules(spark):
    ok = ("F1", "Q1", "2026/5/1", *ORG, "M", "", 1, 1)
    mirror = ("Q1", "2026/5/1", "F1", *ORG, "M", "", 1, 1)
    assert issues(spark, [ok], [mirror]) == []
    found = issues(spark, [ok, ok, ("", "", "", *ORG, "", "", "x", "")], [mirror, ("Q2", "z", "F999", *ORG, "N", "", 1, "1,,2"), ("Q2", "2026/5/1", "F999", *ORG, "P", "", 1, 1)])
    assert [(i[0], i[1], i[2], i[3], i[5]) for i in found] == [
        ("错误", "OA", "4", "申请日期", "日期格式不正确"), ("错误", "ERP", "3", "日期", "日期格式不正确"), ("错误", "OA", "4", "数量", "数值格式不正确"), ("错误", "ERP", "3", "总成本", "数值格式不正确"),
        ("错误", "OA", "4", "表单编号", "关键字段为空"), ("错误", "OA", "4", "物料代码", "关键字段为空"), ("提醒", "OA", "4", "金蝶云单据编号", "金蝶云单据编号为空"),
        ("提醒", "OA", "2,3", "表单编号+物料代码", "业务键重复"), ("提醒", "ERP", "3", "源单单号", "ERP源单未在OA中找到"),
    ]
    assert found[0][6] == "日期不能为空" and found[7][4] == "F1 + M"


def test_precheck_whole_run(spark):
    ok = raw(spark, [("F1", "Q1", "2026/5/1", *ORG, "M", "", 1, 1)])
    mirror = raw(spark, [("Q1", "2026/5/1", "F1", *ORG, "M", "", 1, 1)], ERP_ORDER)
    assert [tuple(r) for r in run_precheck(spark, lambda: (ok, []), lambda: (mirror, [])).collect()] == [CLEAN]
    found = run_precheck(spark, lambda: (ok, ["数量"]), lambda: (mirror, [])).collect()
    assert [(r.issue_type, r.raw) for r in found] == [("缺少关键列", "数量")]
    found = run_precheck(spark, lambda: detect_header([["a"]], HEADS), lambda: detect_header([], HEADS)).collect()
    assert [(r.source, r.issue_type) for r in found] == [("OA", "无法识别表头"), ("ERP", "无法识别表头")]
    found = run_precheck(spark, lambda: 1 / 0, lambda: (mirror, [])).collect()
    assert [(r.source, r.issue_type) for r in found] == [("系统", "预验证执行失败")]


def test_search(spark):
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(["铜管接头", "阀门", "铜管弯头", "垫片", "XyZ", "xyz", " "])], "v string, _ord long")
    c = distinct_candidates(rows, "v")
    names = lambda df: [r.value for r in df.orderBy("_ord").collect()]
    assert names(c) == ["铜管接头", "阀门", "铜管弯头", "垫片", "XyZ"]
    index = bigram_index(c)
    for q in ("管接", "", "Y", "yz", "铜管接头", "qq", "zy"):
        assert names(search(c, q)) == names(indexed_search(c, index, q)), q
    assert names(search(c, "铜管")) == ["铜管接头", "铜管弯头"]
    assert len(names(search(c, "", limit=2))) == 2
    s = spark.createDataFrame([("A", None, 0), ("a", "x", 1), ("A", "y", 2)], "doc_no string, label string, _ord long")
    assert [(r.doc_no, r.label) for r in distinct_suggestions(s).orderBy("_ord").collect()] == [("A", "A"), ("a", "x")]


def test_sinks_guard_foreign_outputs(spark, tmp_path):
    path, df = str(tmp_path / "out"), spark.range(2)
    state = QueryState.parse({"company": "a"})
    write_output(df, path, OutputKind.VARIANCE, state)
    assert read_metadata(spark, path) == (OutputKind.VARIANCE.value, state)
    write_output(df, path, OutputKind.VARIANCE)
    with pytest.raises(FileExistsError):
        write_output(df, path, OutputKind.OA_COMPARE)
    assert read_metadata(spark, str(tmp_path / "none")) is None


def test_reports_keep_their_title_and_status(spark, tmp_path):
    issues = precheck(raw(spark, [("", "Q1", "x", *ORG, "M", "", 1, 1)]), raw(spark, [("Q1", "2026/5/1", "F9", *ORG, "M", "", 1, 1)], ERP_ORDER))
    path = str(tmp_path / "precheck")
    write_precheck(issues, path)
    write_precheck(issues, path)
    assert read_report(spark, path) == ("precheck", "报废差异预验证", "发现 3 条预验证问题")
    clean = run_precheck(spark, lambda: (raw(spark, [("F1", "Q1", "2026/5/1", *ORG, "M", "", 1, 1)]), []), lambda: (raw(spark, [("Q1", "2026/5/1", "F1", *ORG, "M", "", 1, 1)], ERP_ORDER), []))
    write_precheck(clean, str(tmp_path / "clean"))
    assert read_report(spark, str(tmp_path / "clean")) == ("precheck", "报废差异预验证", "未发现预验证问题")
    assert spark.read.parquet(path).columns[0] == "级别"
    with pytest.raises(FileExistsError):
        write_diagnostics(spark.range(1), path)
    a, b = raw(spark, [("F1", "Q1", "2026/5/1", *ORG, "M", "", 1, 1)]), raw(spark, [("Q1", "2026/5/1", "F1", *ORG, "M", "", 1, 1)], ERP_ORDER)
    engine = ReconEngine(canonical(a), canonical(b))
    write_lookup(engine.lookup("oa_form_number", "F1"), str(tmp_path / "lookup"))
    write_diagnostics(engine.diagnostics(), str(tmp_path / "diagnostics"))
    assert read_report(spark, str(tmp_path / "diagnostics"))[0] == "diagnostics"
    assert spark.read.parquet(str(tmp_path / "lookup")).count() == 1
    write_lookup(engine.lookup("oa_form_number", "none"), str(tmp_path / "nothing"))
    assert read_report(spark, str(tmp_path / "nothing")) is None
    assert [(r.label, r.message) for r in error_frame(spark, "why").collect()] == [("错误", "why")]


def test_an_output_is_expanded_under_its_saved_state(spark, tmp_path):
    a = canonical(raw(spark, [("F1", "Q1", "2026/5/1", *ORG, "M", "", 1, 1), ("F1", "Q1", "2026/6/1", *ORG, "N", "", 1, 1)]))
    b = canonical(raw(spark, [("Q1", "2026/5/1", "F1", *ORG, "M", "", 1, 1)], ERP_ORDER))
    engine, state = ReconEngine(a, b), QueryState.parse({"end_date": "2026-05-31"})
    path = output_paths(str(tmp_path))[OutputKind.OA_COMPARE]
    found = engine.run(OutputKind.OA_COMPARE, state, count_materials=True)
    assert found.row_counts == {"source_rows": 3, "rows": 1, "material_rows": 1}
    write_output(found.df, path, OutputKind.OA_COMPARE, state)
    found.release()
    assert [r.item_code for r in engine.expand_output(path, "F1").collect()] == ["M"]
    with pytest.raises(ValueError, match="no document compare"):
        engine.expand_output(str(tmp_path), "F1")
    assert engine.run(OutputKind.OA_COMPARE, QueryState.parse({"company": "none"})).row_counts == {"source_rows": 3, "rows": 0}


def test_stream_ingest(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    raw(spark, [("F1", "Q1", "2026/5/1", *ORG, "M", "", "1,000", 1)]).select(*[c.split()[0] for c in RAW_DDL.split(", ")]).write.parquet(source)
    ingest(raw_stream(spark, source), target, str(tmp_path / "cp")).awaitTermination()
    assert [(r.doc_no, float(r.qty), r.ingested_month) for r in spark.read.parquet(target).collect()] == [("F1", 1000.0, "2026-05")]


def test_a_write_that_is_cut_short_leaves_the_output_as_it_was(spark, tmp_path, monkeypatch):
    """Killed after the old folder has moved and before the new one has: rows and state are still a pair."""
    from ledgerloom import store
    from ledgerloom.sinks import read_output

    path, state = str(tmp_path / "out"), QueryState.parse({"company": "a"})
    write_output(spark.range(2), path, OutputKind.VARIANCE, state)
    rename = store.Store.rename

    def killed(self, source, to):
        if "__staged-" in source:
            raise KeyboardInterrupt
        rename(self, source, to)

    monkeypatch.setattr(store.Store, "rename", killed)
    monkeypatch.setattr(store.Store, "delete", lambda self, p: None)  # a dead process cleans nothing up
    with pytest.raises(KeyboardInterrupt):
        store.commit(spark, store.write_staged(spark.range(5), path), path, {"kind": OutputKind.VARIANCE.value})
    monkeypatch.undo()
    assert not store.Store(spark, path).exists(path)
    assert read_output(spark, path).count() == 2 and read_metadata(spark, path) == (OutputKind.VARIANCE.value, state)
    write_output(spark.range(7), path, OutputKind.VARIANCE)
    assert read_output(spark, path).count() == 7 and read_metadata(spark, path) == (OutputKind.VARIANCE.value, QueryState())
    assert not store.Store(spark, path).exists(path + "__old")
    monkeypatch.setattr(store.Store, "rename", lambda self, a, b: (_ for _ in ()).throw(OSError("no")) if "__staged-" in a else rename(self, a, b))
    with pytest.raises(OSError, match="no"):
        write_output(spark.range(9), path, OutputKind.VARIANCE, state)
    assert read_output(spark, path).count() == 7 and read_metadata(spark, path)[1] == QueryState()


def test_failed_writes_are_tried_in_parts(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from ledgerloom import store

    save, tries = DataFrameWriter.save, []

    def failing(n):
        def run(self, *args, **kwargs):
            tries.append(1)
            if len(tries) in n:
                raise RuntimeError(f"try {len(tries)}")
            return save(self, *args, **kwargs)

        return run

    monkeypatch.setattr(DataFrameWriter, "save", failing({1}))
    staged = store.write_staged(spark.range(100), str(tmp_path / "a"))
    assert sorted(r.id for r in spark.read.parquet(staged).collect()) == list(range(100)) and len(tries) == 9
    tries.clear()
    monkeypatch.setattr(DataFrameWriter, "save", failing({1, 4}))
    with pytest.raises(OSError, match="整块写入失败：.*try 1。分块写入失败：第 3 块 .*try 4"):
        store.write_staged(spark.range(100), str(tmp_path / "b"))
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("b")]


def test_one_run_writes_and_counts(spark, tmp_path):
    a = canonical(raw(spark, [("F1", "Q1", "2026/5/1", *ORG, "M", "", 1, 1), ("F2", "Q2", "2026/6/1", *ORG, "N", "", 1, 1)]))
    b = canonical(raw(spark, [("Q1", "2026/5/1", "F1", *ORG, "M", "", 1, 1)], ERP_ORDER))
    path, runs = str(tmp_path / "o"), spark._jsparkSession.sharedState().statusStore()
    engine = ReconEngine(a, b, source_rows=3)
    before = runs.executionsCount()
    found = engine.write(OutputKind.OA_COMPARE, path)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert runs.executionsCount() - before == 1
    assert found.row_counts == {"rows": 2, "source_rows": 3} and found.df.count() == 2
    none = engine.write(OutputKind.OA_COMPARE, path, QueryState.parse({"company": "none"}))
    assert none.df is None and none.message == "查询条件没有匹配到 OA 数据。" and none.row_counts["rows"] == 0
    assert read_metadata(spark, path) == (OutputKind.OA_COMPARE.value, QueryState())


def test_catalog_takes_over_older_names(spark, tmp_path):
    from ledgerloom.sinks import setup_outputs

    write_output(spark.range(2), str(tmp_path / "报废差异明细"), OutputKind.VARIANCE)
    paths = setup_outputs(spark, str(tmp_path))
    assert spark.read.parquet(paths[OutputKind.VARIANCE]).count() == 2
    assert {p.name for p in tmp_path.iterdir()} == {"报废差异汇总", "OA视角单据对比", "ERP视角单据对比"}
    write_output(spark.range(3), paths[OutputKind.OA_COMPARE], OutputKind.OA_COMPARE)
    write_output(spark.range(3), str(tmp_path / "查询面板"), OutputKind.VARIANCE)
    setup_outputs(spark, str(tmp_path))
    assert spark.read.parquet(paths[OutputKind.VARIANCE]).count() == 2 and (tmp_path / "查询面板").exists()


def test_dimensions_come_from_footers(spark, tmp_path):
    from ledgerloom.sources.tables import dimensions

    spark.range(40).withColumn("x", F.lit(1)).repartition(4).write.parquet(str(tmp_path / "t"))
    (tmp_path / "t" / "broken.parquet").write_bytes(b"no")
    found = dimensions(spark, str(tmp_path / "t")).collect()
    good = [r for r in found if r.n_rows is not None]
    assert len(found) == 5 and sum(r.n_rows for r in good) == 40 and {r.n_columns for r in good} == {2} and all(r.n_bytes > 0 for r in found)


def test_diagnostics_name_every_executor(spark):
    from ledgerloom.metrics import Recorder, executor_peaks

    assert [name for name, _ in executor_peaks(spark)] == ["driver"]
    rows = [r for r in Recorder(spark).frame(spark).collect() if r.category == "执行器内存"]
    assert [r.stage for r in rows] == ["driver"]
