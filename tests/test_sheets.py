import csv
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.values import plain_text
from ledgerloom.model import OA_HEADERS
from ledgerloom.operators.place import with_place
from ledgerloom.queries import SHEETS, sheet_folder
from ledgerloom.sources.headers import HeaderDetectionError, detect_header
from ledgerloom.sources.shapes import json_matrix
from ledgerloom.sources.sheet_source import FAILED, FULL, PRUNED, read_sheet_files
from ledgerloom.sources.sheets import TOO_WIDE, blocks_of, first_cells, raw_cells, read_sheets, with_blocks

HEADS = list(OA_HEADERS.values())


def write(folder, name, rows):
    with open(f"{folder}/{name}", "w", newline="") as f:
        csv.writer(f).writerows(rows)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Sheets with titles, blank lines, other column orders, quotes, no rows, and headers that fail in each way; and what a
    reader of single sheets makes of each."""
    path, rng, want, bad = str(tmp_path_factory.mktemp("sheets")), random.Random(1), {}, {}
    for s in range(14):
        rows, order = [[f"t{s}"] for _ in range(s % 4)] + [[]] * (s % 3), rng.sample(HEADS, 10)
        order = order[:4] if s == 5 else order[:8] if s == 6 else order
        rows.append([*order, "note"])
        if s == 7:
            rows[-1:] = [order[:6], order[:6]]
        if s == 8:
            rows[-1] = [*order, order[0]]
        for i in range((0, 3, 300)[s % 3]):
            rows.append([] if i % 50 == 9 else [f" v{s}-{i}" if j else "" for j in range(len(order))] + ([f'x,"{i}"\t'] if i % 7 else [""] * 3))
        write(path, f"s{s}.csv", rows)
        try:
            h = detect_header(rows, HEADS, first_row=1)
        except HeaderDetectionError as e:
            bad[f"s{s}.csv"] = (e.issue_type, str(e), e.row_label)
            continue
        for i, r in enumerate(rows):
            if i > h.row and any(plain_text(c) for c in r[: len(h.cells)]):
                want[f"s{s}.csv", str(i + 1)] = [r[k] if (k := h.index.get(x, 99)) < len(r) else "" for x in HEADS]
    open(f"{path}/s99.csv", "w").close()
    return path, want, bad


@pytest.mark.parametrize(("block", "most_blocks"), [(None, 100_000), ("3000", 100_000), ("3000", 0)])
def test_every_file_has_its_own_header(spark, folder, block, most_blocks):
    """However files are cut, and whether blocks are broadcast or joined."""
    path, want, bad = folder
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        found = read_sheets(spark, path, OA_HEADERS, most_blocks=most_blocks)
        name = lambda f: os.path.basename(f)
        got = {(name(r._file), r.row_label): [r[c] or "" for c in OA_HEADERS] for r in found.rows.collect()}
        assert got == want
        assert {name(r._file): (r.issue_type, r.message, r.row_label) for r in found.issues.collect()} == bad
        assert [r._ord.place for r in found.rows.filter(F.col("_file").endswith("s2.csv")).orderBy("_ord").collect()] == [int(k[1]) - 1 for k in want if k[0] == "s2.csv"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_wide_rows_and_empty_folders(spark, tmp_path):
    write(tmp_path, "a.csv", [HEADS, ["v"] * 10, ["v"] * 12, [""] * 10 + ["", "x"], ["v"]])
    found = read_sheets(spark, str(tmp_path), OA_HEADERS, columns=10)
    assert sorted((r.row_label, r.issue_type) for r in found.issues.collect()) == [("3", TOO_WIDE), ("4", TOO_WIDE)]
    assert sorted(r.row_label for r in found.rows.collect()) == ["2", "3", "5"]
    write(tmp_path, "a.csv", [])
    found = read_sheets(spark, str(tmp_path), OA_HEADERS)
    assert found.rows.collect() == found.headers.collect() == found.issues.collect() == []


def test_a_broken_file_leaves_its_reason_and_the_rest_is_read(spark, tmp_path):
    good = [["title"], [*HEADS[::-1], "x"], *([f"v{i}"] * 11 for i in range(25_000))]
    write(tmp_path, "good.csv", good)
    write(tmp_path, "late.csv", [*good, ["short"]])
    write(tmp_path, "lacking.csv", [HEADS[:7], ["a"] * 7])
    write(tmp_path, "none.csv", [["a"]])
    write(tmp_path, "quoted.csv", [HEADS, ['two\nlines, "q"', *["v"] * 9], [*["w"] * 10]])
    with open(f"{tmp_path}/bytes.csv", "wb") as f:
        f.write((",".join(HEADS) + "\n" + "v," * 9 + "v\n").encode() * 1 + b"\xff\xfe," * 9 + b"\xff\n")
    rows, report = read_sheet_files(spark, str(tmp_path), OA_HEADERS)
    how = {os.path.basename(r.file): r for r in report.collect()}
    assert {k: (r.strategy, r.n_rows) for k, r in how.items()} == {"good.csv": (PRUNED, 25_000), "late.csv": (FULL, 25_001), "lacking.csv": (FULL, 1), "none.csv": (FAILED, 0), "quoted.csv": (PRUNED, 2), "bytes.csv": (FAILED, 0)}
    assert all((r.reason == "") == (r.strategy == PRUNED) for r in how.values())
    assert "缺失字段" in how["lacking.csv"].reason and "无法识别表头" in how["none.csv"].reason and "行列数不一致" in how["late.csv"].reason
    got = rows.withColumn("name", F.element_at(F.split("_file", "/"), -1))
    assert {r.name: r["count"] for r in got.groupBy("name").count().collect()} == {k: r.n_rows for k, r in how.items() if r.n_rows}
    assert all(r.doc_no == f"v{int(r.row_label) - 3}" for r in got.filter("name = 'good.csv'").collect())
    assert {(r.row_label, r.doc_no, r.item_code, r._strategy) for r in got.filter("name = 'late.csv' AND _ord.place >= 25001").collect()} == {("25002", "v24999", "v24999", FULL), ("25003", None, None, FULL)}
    assert [(r.row_label, r.doc_no) for r in got.filter("name = 'quoted.csv'").orderBy("_ord").collect()] == [("2", 'two\nlines, "q"'), ("3", "w")]


def test_matrices_of_any_shape(spark):
    lines = ["1", '"t"', "null", "true", "[]", "[1,2.50,null]", "[[1],[2,3]]", '[[1],2,[],"x"]', '{"a":1}', '[{"a":[1]},1]', "[[[1,2]]]", "no json", "", '[1e400,"\\u00e9"]', None, "[[],[]]"]

    def brute(text):
        try:
            v = json.loads(text)
        except ValueError:
            return [[text]]
        if not isinstance(v, list):
            return [[v]]
        return [m if isinstance(m, list) else [m] for m in v] if any(isinstance(m, list) for m in v) else [v] if v else []

    shown = lambda c: None if c is None else c if isinstance(c, str) else json.dumps(c, separators=(",", ":"))
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    got = {(r._ord.line, r._ord.row): r.cells for r in json_matrix(df, "line", "n").collect()}
    want = {(i, k): [shown(c) for c in row] for i, t in enumerate(lines) if t is not None and "e400" not in t for k, row in enumerate(brute(t))}
    want[5, 0][1] = "2.5"
    assert {k: v for k, v in got.items() if k[0] != 13} == want and got[13, 0][1] == "é"


def test_places_of_a_whole_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("mine").alias("_note")).repartition(7)
    got = with_place(df, "k")
    assert got.columns == ["k", "_note", "place"]
    assert all(r.place == r.k + 1 for r in got.collect())
    assert with_place(df.limit(0), "k").collect() == []
    assert sorted(r.place for r in with_place(df.withColumn("k", F.lit(1)), "k").collect()) == list(range(1, 5001))


def test_headers_parse_first_lines_only(spark, folder):
    """Lines below those that are looked at for headers are counted, never cut into cells; the others are as they were."""
    blocks = blocks_of(raw_cells(spark, folder[0]))
    first = first_cells(spark, folder[0], blocks, 20)
    above, below = (plan := first._jdf.queryExecution().optimizedPlan().toString())[: plan.index("Join")], plan[plan.index("Join") :]
    assert "from_csv" in above and "from_csv" not in below
    rows = lambda df: sorted((r._file, r._place, r.cells) for r in df.collect())
    assert rows(first) == rows(with_blocks(raw_cells(spark, folder[0]), blocks).filter("_place < 20").select("_file", "_place", "cells"))


def test_each_sheet_is_sorted_by_a_task_of_its_own(spark):
    """Sheets that share a task would add up in its memory."""
    path = sheet_folder(spark, "/root/testdata/sf0.001").removeprefix("file://")
    tasks = {f: {p.split("-")[1] for p in os.listdir(f"{path}/{f}") if p.startswith("part-")} for f in os.listdir(path) if f.startswith("sheet=")}
    assert len(tasks) == SHEETS and all(len(t) == 1 for t in tasks.values())
    assert len(set.union(*tasks.values())) == SHEETS
