import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import langid, neardup, packing, pii, quality
from ledgerloom.llm.common import discard, scratch, shared_dir
from ledgerloom.llm.queries import ORACLE, QUERIES, vocabulary_path

from .conftest import ordered

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_each_document_once(spark, name):
    df = QUERIES[name](spark, SF)
    key, table = {"op3": ("conv_id", "conversations"), "op12": ("page_id", "pages")}.get(name.split("_")[0], ("doc_id", "documents"))
    want = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()} | ({-7} if key == "conv_id" else set())
    got = [r[0] for r in df.select(key).collect()]
    assert set(got) == want
    assert name.startswith("op10") or len(got) == len(want)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for one in ("conversations", "documents"):
        con.sql(f"CREATE VIEW {one} AS SELECT * FROM '{SF}/{one}.parquet'")
    df, want = QUERIES[name](spark, SF), con.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert ordered([tuple(r[c] for c in columns) for r in df.collect()]) == ordered([tuple(r[i] for i in places) for r in want.fetchall()])


def test_pipeline_stages(spark, tmp_path):
    """Each stage keeps rows of its input as they are, its decisions hold, and run() gives the last one's rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        held.append(docs)
        if i < 3:
            assert docs.columns == columns
            assert docs.exceptAll(before).isEmpty()
            assert 0 < docs.count() <= before.count()
    dedup, clean, pieces = held[2:]
    assert dedup.count() < held[0].count()
    classes = {r.nid: r.class_id for r in neardup.classes(held[1]).collect()}
    assert sorted(r.doc_id for r in dedup.collect()) == sorted(set(classes.values()))
    texts = {r.doc_id: r.text for r in dedup.collect()}
    assert {r.doc_id: r.text for r in clean.collect()} == {i: pii.redacted(t) for i, t in texts.items()}
    assert {r.doc_id for r in pieces.collect()} == texts.keys()
    parts = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert parts(corpus_pipeline.run(spark, SF)) == parts(pieces)


@pytest.fixture(scope="module")
def awkward(docs, labels, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("awkward"))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_on_awkward_rows(spark, awkward, tmp_path):
    """Nulls, empty, blank, letterless and long texts, copies, repeated rows, clashing columns: each stage against brute force."""
    from tokenizers import Tokenizer

    from .test_models import brute_language
    from .test_neardup import brute

    docs, kept = spark.read.parquet(f"{awkward}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, awkward).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append(docs)
    source = spark.read.parquet(f"{awkward}/documents.parquet")
    rows = lambda df: ordered([tuple(r) for r in df.collect()])
    model = langid.train(source, langid.training_rows())
    fits = {r.text: langid.Labeller(model).label([r.text])[0][3] for r in source.select("text").distinct().collect()}
    assert rows(kept[0]) == ordered([tuple(r) for r in source.collect() if brute_language(model, r.text, langid.SWITCH_PENALTY)[0] != "und" and fits[r.text] >= langid.LEAST_FIT])
    scores = quality.score_documents(kept[0].withColumn("doc_id", F.xxhash64("text")), spark.read.parquet(f"{awkward}/labels.parquet").limit(0))
    assert scores.count() == kept[0].count()  # every row has a score, so what goes was judged
    trained = quality.train(quality.document_statistics(kept[0]), spark.read.parquet(f"{awkward}/labels.parquet"), usable=quality.training_rows())
    good = lambda t: trained.score(quality.statistics(t)[None])[0] >= 0.5
    assert rows(kept[1]) == ordered([tuple(r) for r in kept[0].collect() if good(r.text)])
    with_id = [(r.doc_id if r.doc_id is not None else -1, r.text) for r in kept[1].collect()]
    want = brute(with_id)
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept[2].collect()) == sorted(set(want.values()))
    assert rows(kept[3].select("doc_id", "text")) == ordered([(r.doc_id, pii.redacted(r.text)) for r in kept[2].collect()])
    tokenizer = Tokenizer.from_file(vocabulary_path())
    ids = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1] for r in kept[3].collect()}
    pieces = kept[4].collect()
    assert {r.doc_id: r.doc_tokens for r in pieces} == {i: len(x) for i, x in ids.items()}
    for r in pieces:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in pieces) == sum(map(len, ids.values()))
    filled = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= packing.WINDOW


def test_pipeline_on_an_empty_table(spark, none, labels, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_whole_corpus_uses_only_the_folder_all_share(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    table = scratch(spark.range(3), "numbers")
    assert table.count() == 3
    discard(table)
    assert not spark._jvm.java.io.File(table.scratch_path.removeprefix("file://")).exists()
