import pytest
from pyspark.sql import functions as F

import ledgerloom.operators.index as operators_index
from ledgerloom.operators.index import CandidateIndex, grams_of, part_of
from ledgerloom.operators.search import search

from .test_dealt import gone, shuffle_files

ROWS = [("铜管接头", 3), ("阀门", 1), ("铜管弯头", 2), ("垫片", 9), ("XyZ", 5), ("xyz", 4), (" ", 0), ("a", 7), ("banana", 8), (None, 10), ("é_%\\", 11)]
TEXTS = ["管接", "", "Y", "yz", "铜管接头", "qq", "zy", "铜管", "an", "nana", "banana ", "a", "_%", "é_"]


def named(df):
    return [(r.value, int(r._ord)) for r in df.collect()]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "value string, _ord long").withColumn("field", F.lit("f")).union(spark.createDataFrame([("banana split", 1, "g")], "value string, _ord long, field string"))


def test_stored_index_finds_what_a_scan_finds(spark, rows, tmp_path):
    index = CandidateIndex(spark, str(tmp_path / "i"))
    assert index.search("f", "an").collect() == [] and index.batches() == 0
    assert index.add(rows) == 9
    all_of = index._done("values", "value string, _ord decimal(38,0), field string, batch int").filter("field = 'f'").select("value", "_ord")
    for text in TEXTS:
        assert named(index.search("f", text)) == named(search(all_of, text)), text
    assert named(index.search("g", "an")) == [("banana split", 1)]
    assert len(named(index.search("f", "", 2))) == 2


def test_batches_add_only_what_is_new(spark, rows, tmp_path):
    """In two batches as in one; a batch that died before its end is as if it had not been, and its rest is written over."""
    whole, two = CandidateIndex(spark, str(tmp_path / "a")), CandidateIndex(spark, str(tmp_path / "b"))
    whole.add(rows)
    assert two.add(rows.filter("_ord < 5 OR field = 'g'")) == 5
    half = rows.filter("_ord > 7")
    write, done = CandidateIndex._write, []

    def dying(self, df, table, *by):
        done.append(table)
        if table == "grams":
            raise RuntimeError("lost")
        write(self, df, table, *by)

    CandidateIndex._write = dying
    try:
        with pytest.raises(RuntimeError):
            two.add(half)
    finally:
        CandidateIndex._write = write
    assert two.batches() == 1 and named(two.search("f", "nana")) == []
    assert two.add(rows) == 4 and two.add(rows) == 0
    for text in TEXTS:
        assert named(two.search("f", text)) == named(whole.search("f", text)), text


def test_a_query_reads_its_rarest_gram_alone(spark, rows, tmp_path):
    index = CandidateIndex(spark, str(tmp_path / "i"))
    index.add(rows)
    plan = index.search("f", "管接")._jdf.queryExecution().executedPlan().toString()
    assert index.rarest("f", "管接头") in grams_of("管接头") and index.rarest("f", "管x") is None
    assert plan.count("FileScan") == 1 and "struct<gram:string,value:string" in plan
    filters = plan.split("PartitionFilters")[1]
    assert all(f"isnotnull({c}" in filters for c in ("batch", "field", "part"))
    files = index.matches("f", "管接").inputFiles()
    assert all(f"part={part_of('管接')}" in f for f in index.matches("f", "管接").select("value", F.input_file_name().alias("f")).toPandas()["f"]) and files


def test_postings_of_a_large_batch_are_dealt_over_pieces(spark, rows, tmp_path, monkeypatch):
    """More candidates make more pieces of a gram's postings, not larger ones; what is found stays."""
    whole, cut = CandidateIndex(spark, str(tmp_path / "a")), CandidateIndex(spark, str(tmp_path / "b"))
    many = rows.select("field", "value", "_ord").union(spark.range(300).selectExpr("'f'", "concat('banana ', id)", "id + 100"))
    whole.add(many)
    monkeypatch.setattr(operators_index, "VALUES_A_PIECE", 20)
    cut.add(many)
    files = lambda index: index.matches("f", "banana").select(F.input_file_name()).distinct().count()
    assert files(whole) == 1 and files(cut) > 8
    for text in (*TEXTS, "banana 1", "a 29"):
        assert named(cut.search("f", text, 500)) == named(whole.search("f", text, 500)), text


def test_postings_of_a_large_batch_are_never_shuffled(spark, rows, tmp_path, monkeypatch):
    """Candidates are dealt out before their grams are told, and nothing that was shuffled stays once a table is written."""
    plans, write = {}, CandidateIndex._write
    monkeypatch.setattr(CandidateIndex, "_write", lambda self, df, table, *by: (plans.setdefault(table, df._jdf.queryExecution().optimizedPlan().toString()), write(self, df, table, *by)))
    monkeypatch.setattr(operators_index, "VALUES_A_PIECE", 4)
    index = CandidateIndex(spark, str(tmp_path / "i"))
    assert index.add(rows) == 9
    before = shuffle_files(spark)
    write(index, rows.selectExpr("value AS gram", "1L AS n", "field", "7 AS batch").repartition(2, "gram"), "more", "field", "batch")
    assert gone(spark, before)
    steps = plans["postings"].splitlines()
    assert next(i for i, x in enumerate(steps) if "Generate explode" in x) < next(i for i, x in enumerate(steps) if "RepartitionByExpression" in x)
    assert plans["postings"].count("RepartitionByExpression") == 1
