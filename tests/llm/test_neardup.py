import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import neardup

from .conftest import WORDS, prose


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def counted(text):
    words = (text or "").split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def probability(x, y):
    """The probability Jaccard similarity by its definition."""
    every = x.keys() | y.keys()
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in every) for i in x.keys() & y.keys())


def brute(rows, by_count=True):
    """The least id of each row's class, comparing all pairs; by sets alone or by both measures."""
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    own = [(i, text or "", shingles(text), counted(text)) for i, text in rows]
    held, uneven = defaultdict(list), []
    for i, text, s, n in own:
        top(i)
        odd = by_count and len(set(n.values())) > 1
        near = [r for k in held.values() for r in k] if odd else held[len(s) // 40] + held[len(s) // 40 - 1] + held[len(s) // 40 + 1] + uneven
        for j, other, o, m in near:
            if text == other or (s and o and len(s & o) >= 0.8 * len(s | o)) or (s & o and (odd or len(set(m.values())) > 1) and by_count and probability(n, m) >= 0.8):
                a, b = sorted((top(i), top(j)))
                up[b] = a
        held[len(s) // 40].append((i, text, s, n))
        if odd:
            uneven.append((i, text, s, n))
    return {i: top(i) for i, _, _, _ in own}


FOUND = {}


@pytest.mark.parametrize("small", [neardup.SMALL_BUCKET, 2, 6])
def test_classes_equal_all_pairs(spark, monkeypatch, small):
    """Chains and stars of edited texts, some with lines that repeat; once with every bucket taken for a large one. The same
    classes whatever counts as large."""
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small)
    monkeypatch.setattr(neardup, "CELL", 8)
    monkeypatch.setattr(neardup, "HUBS", 2)
    monkeypatch.setattr(neardup, "HOT_BUCKET", small)  # so that buckets are dealt over several tasks
    rng, rows = random.Random(11), []
    vocabulary = [f"w{i}" for i in range(500)]
    for family in range(12):
        words = prose(rng, 90, vocabulary).split()
        for _ in range(12):
            rows.append((len(rows) * 3 % 1009, " ".join(words)))
            if family % 2:
                words = list(words)
            words[rng.randrange(90)] = rng.choice(vocabulary)
    for family in range(6):
        line, text = prose(rng, 30, vocabulary), prose(rng, 60, vocabulary)
        rows += [(3000 + 10 * family + k, f"{line} " * (3 + k) + (text if k % 2 else prose(rng, 8 * k, vocabulary))) for k in range(8)]
    rows += [(2000 + i, t) for i, t in enumerate(["", "", None, "a b", "a b", "a b c", "a  b"])]
    got = {r.nid: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    near = sum(got[i] == want[i] for i in want)
    assert near >= 0.97 * len(want)  # buckets meet by chance, 0.8 itself nearly always
    texts = dict(rows)
    for i, c in got.items():
        assert want[c] == want[i]  # never a link that isn't there
    assert len({got[i] for i, t in texts.items() if not (t or "")}) == 1
    assert FOUND.setdefault("classes", got) == got


def test_probability_jaccard_equals_its_definition():
    rng = random.Random(8)
    for _ in range(200):
        x, y = ({k: rng.randint(1, 9) for k in range(12) if rng.random() < 0.7} for _ in range(2))
        a, b = (np.array([v.get(k, 0) for k in range(12)], float) for v in (x, y))
        assert neardup.probability_jaccard(a, b) == pytest.approx(probability(Counter(x), Counter(y)))


def test_weights_count(spark):
    """Texts that are alike in what they repeat, and differ in much that they say once, are linked by their counts alone."""
    rng, rows, vocabulary = random.Random(31), [], [f"v{i}" for i in range(5000)]
    for pair in range(20):
        line = prose(rng, 40, vocabulary)
        rows += [(2 * pair + k, f"{line} " * 30 + prose(rng, 40, vocabulary)) for k in range(2)]
    rows += [(100 + k, prose(rng, 40, vocabulary)) for k in range(20)]
    got = {r.nid: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) == {i: i - i % 2 if i < 40 else i for i, _ in rows}
    assert all(v == k for k, v in brute(rows, by_count=False).items())


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(4)
    weights = rng.integers(1, 6, (2, 300))
    weights[1, :200] = weights[0, :200]
    weights[1, 280:] = 0
    doc, place = np.nonzero(weights)
    with np.errstate(over="ignore"):
        hashes = neardup.mixed(place.astype(np.uint64) + np.uint64(99))
        found = neardup.probminhash(doc, hashes, weights[doc, place], 2, 4096)
    a, b = weights.astype(float)
    both = (a > 0) & (b > 0)
    want = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in np.flatnonzero(both))
    assert abs((found[0] == found[1]).mean() - want) < 0.03


def test_components_of_paths_and_random_links(spark):
    rng = random.Random(5)
    for edges in ([(i, i + 1) for i in range(300)], [(rng.randrange(400), rng.randrange(400)) for _ in range(300)], []):
        up = {}

        def top(x, up=up):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in edges:
            if a != b:
                x, y = sorted((top(a), top(b)))
                up[y] = x
        frame, want = spark.createDataFrame(edges, "a long, b long"), {n: top(n) for n in list(up)}
        assert {r.nid: r.label for r in neardup.components(frame).collect()} == want
        first = neardup.components(frame.filter("a < 150"))
        assert {r.nid: r.label for r in neardup.extended(first, frame.filter("a >= 150")).collect()} == want


def test_awkward_rows(spark, docs, none, rows):
    found = neardup.classes(docs).collect()
    assert len(found) == len(rows)
    got = {r.nid: r.class_id for r in found}
    assert got[100] == got[101] == got[0] == 0
    assert got[201] == got[200] == 200
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) == len(set(got.values()))
    assert neardup.classes(none).count() == neardup.keep_one(none).count() == 0


def test_a_long_text_and_its_near_copy(spark):
    words = prose(random.Random(2), 20_000, WORDS["aa"]).split()
    words = [f"{w}{i}" for i, w in enumerate(words)]
    other = [*words[:-40], *(["new"] * 40)]
    got = {r.nid: r.class_id for r in neardup.classes(spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "x")], "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_copies_that_differ_in_how_often_a_line_repeats(spark):
    """Their sets share over 0.8, their counts a tenth or less: all pairs still meet."""
    rng, rows, vocabulary = random.Random(21), [], [f"v{i}" for i in range(5000)]
    for pair in range(20):
        text, line = prose(rng, 304, vocabulary), prose(rng, 12, vocabulary)
        rows += [(2 * pair, text), (2 * pair + 1, text + f" {line}" * 200)]
    got = {r.nid: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(40)} == brute(rows) == brute(rows, by_count=False)


def test_ids_that_clash_keep_their_texts(spark):
    """Two texts under one id are two texts; rows that repeat in both are one."""
    rng, vocabulary = random.Random(3), [f"v{i}" for i in range(5000)]
    one, two, other = (prose(rng, 80, vocabulary) for _ in range(3))
    near = f"{two} end"
    rows = [(5, one), (5, two), (5, two), (7, near), (8, other), (8, other), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = neardup.keep_one(docs).collect()
    texts = [r.text or "" for r in kept]
    assert sorted(texts) in [sorted(x) for x in (["", one, two, other], ["", one, near, other])]
    found = neardup.classes(docs).collect()
    assert len(found) == len(rows)
    of = defaultdict(set)
    for r in found:
        of[r.nid].add(r.class_id)
    assert len(of[5]) == 2 and of[7] < of[5] and of[8] == {8}


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("a", "x y z"), ("b", "x y z"), ("c", "q"), (None, "q")], "doc_id string, text string")
    kept = neardup.keep_one(docs)
    assert kept.count() == 2 and kept.schema == docs.schema
    assert len({r.class_id for r in neardup.classes(docs).collect()}) == 2


def test_agreeing_registers_of_similar_texts():
    """Of pairs at 0.8 nearly none falls below what is asked, of pairs at 0.4 nearly none reaches it."""
    rng = np.random.default_rng(1)
    for share, reached in ((0.8, 1.0), (0.4, 0.0)):
        same = rng.random((4000, neardup.BANDS * neardup.ROWS)) < share
        one = rng.integers(0, 1 << 62, same.shape, dtype=np.uint64)
        other = np.where(same, one, one + np.uint64(1))
        found = neardup.agreeing(neardup.band_keys(one, neardup.BANDS), neardup.band_keys(other, neardup.BANDS))
        assert (found == same.sum(1)).all()
        assert abs((found >= neardup.least_agreeing(0.8, same.shape[1])).mean() - reached) < 0.01
