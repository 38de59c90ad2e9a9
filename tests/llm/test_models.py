"""Language, quality and language-model scores: brute-force versions, held-out accuracy, awkward rows."""

import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import langid, quality, suffixtree

from .conftest import ordered

SF = "/root/testdata/sf0.01"


def test_viterbi_equals_trying_every_labelling():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = rng.integers(0, 6, 4)
        scores = rng.normal(size=(int(sizes.sum()), 3)) * 3
        labels, at = langid.viterbi(scores, sizes, 1.5), 0
        for n in sizes.tolist():
            value = lambda way, own: sum(own[i, c] for i, c in enumerate(way)) - 1.5 * sum(a != b for a, b in itertools.pairwise(way))
            own = scores[at : at + n]
            best = max((value(w, own) for w in itertools.product(range(3), repeat=n)), default=0.0)
            assert value(labels[at : at + n].tolist(), own) == pytest.approx(best)
            at += n


def test_languages_of_awkward_rows(docs, none):
    model = langid.train(docs, F.lit(True))
    found = langid.label_documents(docs, model).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == docs.count()
    assert all(got[i].lang_pred == ("aa", "bb")[i % 2] for i in range(60))
    assert {got[i].lang_pred for i in (200, 201, 202, 203)} == {"und"}
    assert all(0 <= r.score <= 1 for r in found)
    assert langid.label_documents(none, model).count() == 0
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()}.isdisjoint({200, 201, 202, 203})
    blank = langid.train(none, F.lit(True))
    assert {r.lang_pred for r in langid.label_documents(docs, blank).collect()} == {"und"}


def test_mixed_text_is_cut_into_spans(docs):
    model = langid.train(docs, F.lit(True))
    label = langid.Labeller(model).label(["stone river walking house under kivi joki talon alla kirkas aamu kerätä"])[0]
    assert label[2] == [(0, 5, "aa"), (5, 7, "bb")]
    assert label[0] == "bb"


def test_words_are_cut_where_the_script_changes():
    assert langid.words_of("石头河流stone石头 plain (α)β,г1д x2石été") == ["石头河流", "stone", "石头", "plain", "(α)β", ",г1д", "x", "2石", "été"]
    rng = np.random.default_rng(5)
    alphabet = "ab é石河αβгд12,.カ한"
    for _ in range(500):
        text = "".join(rng.choice(list(alphabet), int(rng.integers(0, 30))))
        assert "".join(langid.words_of(text)) == "".join(text.split())
        for word in langid.words_of(text):
            assert len({s for s in map(langid.script_of, word) if s}) <= 1
    model = langid.fit(["en", "zh"], [("en", w, 5) for w in ("stone", "river")] + [("zh", w, 5) for w in ("石头", "河流")])
    label = langid.Labeller(model, 2.0).label(["石头河流stone石头"])[0]
    assert label[2] == [(0, 1, "zh"), (1, 1, "en"), (2, 1, "zh")] and label[0] == "zh"


def test_a_model_of_many_languages_is_small():
    """Its size goes with the words, not with words times languages; scores are those of dense tables."""
    import pickle

    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(4000)]
    counts = [(f"l{i % 500:03}", w, int(rng.integers(1, 9))) for i, w in enumerate(words)]
    model = langid.fit(sorted({c[0] for c in counts}), counts)
    assert len(pickle.dumps(model)) < 2_000_000
    few = langid.fit(["l000", "l001", "l002"], [c for c in counts if c[0] in ("l000", "l001", "l002")])
    table = {w: [sum(n for lang, x, n in counts if x == w and lang == one) for one in few.languages] for w in few.words}
    totals = [sum(v[i] for v in table.values()) + 0.5 * (len(table) + 1) for i in range(3)]
    for w, v in table.items():
        logs = [math.log((c + 0.5) / t) for c, t in zip(v, totals, strict=True)]
        assert few.score(w) == pytest.approx([max(x - max(logs), -langid.WORD_RANGE) for x in logs])


def brute_language(model, text, penalty):
    """Language, score and fit of a text by trying nothing but the recurrence itself, word by word."""
    words = langid.words_of(text or "")
    n, cores = len(model.languages), [langid.letters_of(w) for w in words]
    scores = [model.score(c) if c else (0.0,) * n for c in cores]
    best, came = [0.0] * n, []
    for k, own in enumerate(scores):
        way = [c if best[c] >= max(best) - penalty else best.index(max(best)) for c in range(n)] if k else list(range(n))
        best = [best[w] - (penalty if k and w != c else 0) + own[c] for c, w in enumerate(way)]
        came.append(way)
    label, labels = best.index(max(best)) if words else 0, []
    for way in reversed(came):
        labels.append(label)
        label = way[label]
    labels.reverse()
    mass = [sum(len(c) for c, x in zip(cores, labels, strict=True) if x == i) for i in range(n)]
    if not sum(mass):
        return langid.UNKNOWN, 0.0
    chosen = mass.index(max(mass))
    share = lambda s: math.exp(s[chosen]) / sum(map(math.exp, s))
    return model.languages[chosen], sum(share(s) * len(c) for s, c in zip(scores, cores, strict=True)) / sum(mass)


def test_predictions_equal_brute_force(spark, docs):
    model = langid.train(docs, F.lit(True))
    texts = [r.text for r in docs.select("text").collect() if len(r.text or "") < 5000]
    texts += ["stone river kivi joki", "kivi stone joki river", "talon", "12 talon under 7", "a b c"]
    for text, (lang, score, _, fit) in zip(texts, langid.Labeller(model).label(texts), strict=True):
        want = brute_language(model, text, langid.SWITCH_PENALTY)
        assert (lang, pytest.approx(score, abs=1e-5)) == want, text
        assert 0 <= fit <= 1 and fit >= score - 1e-6 or lang == langid.UNKNOWN or score <= 1


def test_many_languages_and_rare_ones(spark):
    """Two hundred languages, one of them with a single document, however few documents a language may give."""
    rows = [(200 * k + i, " ".join(f"{chr(97 + i // 20)}{chr(97 + i % 20)}word{chr(97 + j)}" for j in range(12)), f"l{i:03d}") for i in range(200) for k in range(1 if i == 133 else 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True), max_docs=6)
    found = langid.label_documents(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.99 * len(found)
    assert {r.lang_pred for r in found if r.lang == "l133"} == {"l133"}


def test_evenly_mixed_texts_are_kept(spark):
    words = {f"l{i}": [f"{chr(97 + i)}{c}{d}x" for c in "abcdef" for d in "ghi"] for i in range(6)}
    docs = spark.createDataFrame([(i, " ".join(words[f"l{i}"] * 3), f"l{i}") for i in range(6)] + [(9, " ".join(w for x in words.values() for w in x), None)], "doc_id long, text string, lang string")
    kept = langid.keep_identified(docs, langid.train(docs, F.lit(True)))
    assert {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, 4, 5, 9}


def test_held_out_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.label_documents(docs, langid.train(docs, langid.training_rows())).join(docs.select("doc_id", "lang"), "doc_id").filter(~langid.training_rows() & F.col("lang").isNotNull() & (F.col("lang_pred") != "und"))
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.93


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.score_documents(docs, labels, usable=quality.training_rows()).join(labels, "doc_id").filter(~quality.training_rows()).collect()
    good, bad = ([r.score for r in found if r.quality == q] for q in (1, 0))
    area = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert area > 0.85
    assert np.mean([r.predicted == r.quality for r in found]) > 0.8


def test_quality_of_awkward_rows(spark, docs, none, labels):
    found = quality.score_documents(docs, labels).collect()
    assert len(found) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert len({r.score for r in found if r.doc_id in (200, 201, 202)}) == 1
    assert quality.score_documents(none, labels).count() == 0
    assert {r.score for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    model = quality.train(quality.document_statistics(docs), labels)
    assert quality.keep_good(docs, model).columns == docs.columns
    assert (np.diff(model.levels) >= 0).all()


def test_equations_equal_one_solve(spark, docs, labels):
    stats = quality.document_statistics(docs)
    model = quality.train(stats, labels)
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("y")).filter("y <> 0.5").select("doc_id", (F.col("y") > 0.5).cast("double").alias("y"))
    rows = stats.join(marks, "doc_id").collect()
    z = model.lifted(np.array([r.x for r in rows]))
    want = np.linalg.solve(z.T @ z + quality.RIDGE * len(rows) * np.eye(z.shape[1]), z.T @ np.array([float(r.y) for r in rows]))
    assert np.abs(z @ want - z @ model.weights).max() < 1e-6


def test_scores_equal_a_plain_fit(docs, labels):
    """Ridge on all rows, calibrated across folds by pooling adjacent violators, worked out at once in numpy."""
    stats = quality.document_statistics(docs)
    model = quality.train(stats, labels)
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("y")).filter("y <> 0.5").select("doc_id", (F.col("y") > 0.5).cast("double").alias("y"))
    rows = stats.join(marks, "doc_id").select("x", "y", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(quality.FOLDS)).alias("fold")).collect()
    x, y, fold = (np.array([r[c] for r in rows]) for c in ("x", "y", "fold"))
    y, z = y.astype(float), model.lifted(x)
    raw = np.zeros(len(y))
    for k in range(quality.FOLDS):
        own = fold != k
        raw[fold == k] = z[fold == k] @ np.linalg.solve(z[own].T @ z[own] + quality.RIDGE * own.sum() * np.eye(z.shape[1]), z[own].T @ y[own])
    step = np.rint((np.clip(raw, -0.5, 1.5) + 0.5) * quality.GRID)
    blocks = [[s, s, (step == s).sum(), y[step == s].sum()] for s in np.unique(step)]
    at = 0
    while at + 1 < len(blocks):
        low, high = blocks[at], blocks[at + 1]
        if low[3] * high[2] >= high[3] * low[2]:
            blocks[at : at + 2] = [[low[0], high[1], low[2] + high[2], low[3] + high[3]]]
            at = max(0, at - 1)
        else:
            at += 1
    ends = np.array([s / quality.GRID - 0.5 for b in blocks for s in (b[0], b[1] + 1e-6)])
    levels = np.maximum.accumulate([(b[3] + 0.5) / (b[2] + 1) for b in blocks for _ in (0, 1)])
    assert np.allclose(model.steps, ends, atol=1.5 / quality.GRID)
    assert np.allclose(model.levels, levels, atol=0.02)
    got = {r.doc_id: r.score for r in quality.scored(stats, model).collect()}
    want = {r.doc_id: float(np.interp(z0, model.steps, model.levels)) for r, z0 in ((r, model.raw(np.array([r.x]))[0]) for r in stats.collect())}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


def words_of(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))] + [b""]


def brute_tree(rows):
    """Scores by a tree of dictionaries over whole contexts, as the module's text describes it."""
    depth, start = suffixtree.DEPTH, "start"
    texts = [(i, words_of(t)) for i, t in rows]
    train = [w for i, w in texts if i is None or i % 7 != 2]
    unigrams = Counter(x for w in train for x in w)
    total, distinct = sum(unigrams.values()), len(unigrams)
    root = lambda x: (unigrams[x] + 1) / (total + distinct + 1)

    def contexts(words, i):
        full = [start, *words[:i]]
        return [tuple(full[len(full) - d :]) for d in range(1, min(depth, len(full)) + 1)]

    nexts = [defaultdict(Counter) for _ in range(depth + 1)]
    for words in train:
        for i, x in enumerate(words):
            for c in contexts(words, i):
                nexts[len(c)][c][x] += 1
    states = {}

    def probability(context, x):
        for c in [context[k:] for k in range(len(context))]:
            if c in states:
                mass, rest = states[c]
                return mass.get(x, 0.0) + rest * probability(c[1:], x)
        return root(x)

    for d in range(1, depth + 1):
        new = {}
        for c, counted in nexts[d].items():
            n, kept = sum(counted.values()), {x: k for x, k in counted.items() if k >= suffixtree.LEAST_NEXT}
            if n < suffixtree.LEAST_CONTEXT or not kept:
                continue
            expected = {x: probability(c[1:], x) for x in kept}
            other = n - sum(kept.values())
            gain = 2 * sum(k * math.log(k / n / expected[x]) for x, k in kept.items())
            gain += 2 * other * math.log(other / n / max(1 - sum(expected.values()), 1e-9)) if other else 0
            if gain > len(kept) + 3 * math.sqrt(2 * len(kept)):
                new[c] = ({x: (k - suffixtree.DISCOUNT) / n for x, k in kept.items()}, (suffixtree.DISCOUNT * len(kept) + other) / n)
        states |= new
    score = lambda words: sum(math.log10(probability((contexts(words, i) or [()])[-1], x)) for i, x in enumerate(words))
    base = lambda words: sum(math.log10(root(x)) for x in words)
    return [(i, len(w), sum(unigrams[x] > 0 for x in w), total, base(w), score(w)) for i, w in texts], len(states)


@pytest.mark.parametrize(
    ("head", "held", "wide", "shard"),
    [(200_000, 400_000, 1, 10**9), (200_000, 400_000, 150, 3000), (40, 400_000, 540, 3000), (40, 0, 540, 3000), (0, 0, 150, 10**9), (25, 30, 60, 1000), (70, 200, 300, 2000)],
)
def test_scores_equal_a_brute_force_tree(spark, docs, rows, monkeypatch, head, held, wide, shard):
    """One shard or several, wide contexts or none, any number of words and next words held: the same scores."""
    monkeypatch.setattr(suffixtree, "HEAD", head)
    monkeypatch.setattr(suffixtree, "ENTRIES_HELD", held)
    monkeypatch.setattr(suffixtree, "WIDE_PART", wide)
    monkeypatch.setattr(suffixtree, "SHARD_TOKENS", shard)
    got = suffixtree.score_documents(docs, F.coalesce(F.col("doc_id") % 7 != 2, F.lit(True))).collect()
    want, states = brute_tree([r[:2] for r in rows])
    assert states > 100
    got, want = ordered([tuple(r) for r in got]), ordered(want)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[4:] == pytest.approx(b[4:], rel=1e-12, abs=1e-6)


def test_a_context_that_only_held_out_texts_have(spark, monkeypatch):
    """It is wide by all tokens, so its tokens are dealt by longer suffixes, and it is no state."""
    monkeypatch.setattr(suffixtree, "WIDE_PART", 10)
    monkeypatch.setattr(suffixtree, "SHARD_TOKENS", 500)
    rows = [(i, f"word{i % 7} stone river") for i in range(60)] + [(2 + 7 * i, " ".join(f"hot w{i}x{k}" for k in range(40))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    source = suffixtree.whole_texts(docs).withColumn("training", F.col("doc_id") % 7 != 2)
    counts = source.sparkSession.createDataFrame(suffixtree.word_counts(source).collect(), "word binary, n long, m long")
    top, _ = suffixtree.planted(source, counts)
    assert len(top.levels[0].keys) and not top.levels[0].stays[np.searchsorted(top.levels[0].keys, suffixtree.folded(np.zeros(1, np.uint64), np.array([top.words.index(b"hot")])))].any()
    parts = suffixtree.dealt(source, spark.sparkContext.broadcast(top), 50, 5).filter("tokens is not null").collect()
    sizes = Counter()
    for r in parts:
        sizes[r.shard] += len(suffixtree.unpacked(bytes(r.tokens))[0].code)
    assert max(sizes.values()) < sum(sizes.values()) / 4
    got = suffixtree.score_documents(docs, F.col("doc_id") % 7 != 2).collect()
    assert sorted(r.score for r in got) == pytest.approx(sorted(x[5] for x in brute_tree(rows)[0]), abs=1e-6)


def test_words_by_columns_are_those_of_each_text():
    texts = ["", " \n\t ", "A b\x0bC  d\x1fe ", "  ÄÖ x y z Z", "one", "a\x00b a\x00B", "x\xa0y\u2003z \r\f"]
    for own in (texts, ["x y"], [""], []):
        sizes, number, words = suffixtree.numbered(pa.array(["zz", *own], pa.string()).slice(1))
        found = iter([words[i] for i in number.tolist()])
        assert [list(itertools.islice(found, n)) for n in sizes.tolist()] == [suffixtree.tokens(x) for x in own]


def test_keys_are_asked_for_in_packs(spark, docs, monkeypatch):
    """One row for each bin, kind and part of what is told, however many keys there are; each key of a bin in one of them."""
    monkeypatch.setattr(suffixtree, "HEAD", 10)
    source = suffixtree.whole_texts(docs).withColumn("training", F.lit(True))
    top, _ = suffixtree.planted(source, suffixtree.word_counts(source).localCheckpoint())
    shipped = spark.sparkContext.broadcast(top)
    parts = suffixtree.dealt(source, shipped, 12, 3).repartition(3, "bin").localCheckpoint()
    want = {}
    for r in parts.filter("tokens is not null").collect():
        want.setdefault(r.bin, set()).update(suffixtree.rare_of(bytes(r.tokens)).tolist())
    rows = suffixtree.asked(parts, shipped, 4).filter(F.col("kind") == suffixtree._WORD).collect()
    assert len(rows) == len({(r.bin, r.part) for r in rows}) <= 12 < sum(map(len, want.values()))
    got = [(r.bin, x, r.part) for r in rows for x in np.cumsum(suffixtree._read(bytes(r.keys), np.int64)).tolist()]
    assert sorted((b, x) for b, x, _ in got) == sorted((b, x) for b, own in want.items() for x in own)
    assert all(x % 4 == part for _, x, part in got)


def test_scores_of_nothing(docs, none):
    assert suffixtree.score_documents(none, F.lit(True)).count() == 0
    alone = suffixtree.score_documents(docs, F.lit(False)).collect()
    assert all(r.score == 0 and r.train_tokens == 0 for r in alone)


def test_codes_are_the_same_in_spark_and_python(spark):
    words = [b"", b"a", b"stone", bytes(range(256)), b"x" * 1000]
    df = spark.createDataFrame([(bytearray(w),) for w in words], "w binary").select("w", suffixtree.rare_code(F.col("w")).alias("code"))
    codes = suffixtree.Codes()
    assert all(codes[bytes(r.w)] == r.code for r in df.collect())


def test_the_tree_helps_on_texts_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = suffixtree.score_documents(docs, suffixtree.training_rows()).filter(~suffixtree.training_rows()).agg(F.sum("base_score"), F.sum("score")).first()
    assert found[1] > found[0]
