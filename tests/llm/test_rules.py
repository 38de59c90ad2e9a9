import math
import random
import re
import zlib
from collections import Counter

from ledgerloom.llm import rules

from .conftest import ordered


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, repeats = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeats, len(inside)


def test_counts_equal_brute_force(spark, docs, rows):
    more = [(900, "a b a b a b a\n# $ %\n# $ %\n\x0b\n\x0b", None, None, 0), (901, "é\U0001f600   x y z x y z", None, None, 0)]
    got = rules.judge(docs.unionByName(spark.createDataFrame(more, docs.select("doc_id", "text", "lang", "source", "n_chars").schema), allowMissingColumns=True), spark.createDataFrame([], "doc_id long, quality int"))
    want = []
    for doc_id, text, *_ in [*rows, *more]:
        counts = brute(text)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        want.append((doc_id, *counts, failed, not failed))
    assert ordered([(r.doc_id, *(r[c] for c in rules.COUNTS), r.base_failed, r.kept) for r in got.collect()]) == ordered(want)


def test_learns_a_planted_rule(spark):
    data = [(i, float(i % 10) / 10, float(i * 37 % 100), int(not (i % 10 >= 7 and i * 37 % 100 < 60))) for i in range(3000)]
    stats = spark.createDataFrame([(a, b, c) for a, b, c, _ in data], "doc_id long, x double, y double")
    marks = spark.createDataFrame([(a, q) for a, _, _, q in data], "doc_id long, quality int")
    found = rules.learn(stats, marks, statistics=("x", "y"))
    judged = {r.doc_id: r.k for r in stats.select("doc_id", found.keeps().alias("k")).collect()}
    assert sum(judged[a] == bool(q) for a, _, _, q in data) / len(data) > 0.97
    assert all(len(r.conditions) <= rules.MOST_CONDITIONS for r in found.rules)


def brute_rules(rows, names):
    """The same covering by counting every threshold over plain rows (bad, grow, values)."""

    def quantiles(values):
        values = sorted(values)
        return {values[max(0, math.ceil(i / rules.CUTS * len(values)) - 1)] for i in range(rules.CUTS + 1)} if values else set()

    def holds(row, conditions):
        return all((row[2][s] > cut) == above for s, above, cut in conditions)

    cuts = {s: sorted(quantiles([r[2][s] for r in rows]) | quantiles([r[2][s] for r in rows if r[0]])) for s in names}
    found = []
    while len(found) < rules.MOST_RULES:
        left = [r for r in rows if not any(holds(r, c) for c in found)]
        conditions = []
        while len(conditions) < rules.MOST_CONDITIONS:
            part = [r for r in left if r[1] and holds(r, conditions)]
            p0 = sum(r[0] for r in part)
            n0 = len(part) - p0
            if p0 < rules.LEAST_COVER or not n0:
                break
            best, choice = 1e-9, None
            for s in names:
                for cut in cuts[s]:
                    for above in (False, True):
                        in_it = [r[0] for r in part if (r[2][s] > cut) == above]
                        p, n = sum(in_it), len(in_it) - sum(in_it)
                        gain = p * (math.log2((p + 1e-9) / (p + n + 1e-9)) - math.log2((p0 + 1e-9) / (p0 + n0 + 1e-9))) if p else 0.0
                        if gain > best:
                            best, choice = gain, (s, above, cut)
            if choice is None:
                break
            conditions.append(choice)
        if not conditions:
            break
        aside = [r for r in left if not r[1]]
        counted = []
        for k in range(1, len(conditions) + 1):
            p = sum(r[0] for r in aside if holds(r, conditions[:k]))
            counted.append((p, sum(holds(r, conditions[:k]) for r in aside) - p))
        worth = [(p - n) / max(1, p + n) for p, n in counted]
        k = worth.index(max(worth)) + 1
        p, n = counted[k - 1]
        if p < rules.LEAST_COVER or p / (p + n) < rules.LEAST_PRECISION:
            break
        found.append(conditions[:k])
    return found


def test_rules_equal_brute_force(spark):
    """Three statistics, noisy labels of two causes: the same conditions in the same order."""
    rng = random.Random(15)
    data = []
    for i in range(2500):
        x, y, z = rng.random(), rng.randint(0, 30) / 10, rng.gauss(0, 1)
        bad = (x > 0.8 and y < 2) or (z > 1.2 and y >= 2)
        data.append((i, x, y, z, int(bad != (rng.random() < 0.05))))
    stats = spark.createDataFrame([d[:4] for d in data], "doc_id long, x double, y double, z double")
    marks = spark.createDataFrame([(d[0], 1 - d[4]) for d in data], "doc_id long, quality int")
    found = rules.learn(stats, marks, statistics=("x", "y", "z"))
    rows = [(bool(bad), zlib.crc32(str(i).encode()) % 7 < 5, {"x": x, "y": y, "z": z}) for i, x, y, z, bad in data]
    want = brute_rules(rows, ("x", "y", "z"))
    assert len(want) >= 2
    assert [[(c.statistic, c.above, c.cut) for c in r.conditions] for r in found.rules] == want
    judged = {r.doc_id: r.n for r in stats.select("doc_id", found.number().alias("n")).collect()}
    first = lambda row: next((k for k, cs in enumerate(want, 1) if all((row[s] > cut) == above for s, above, cut in cs)), 0)
    assert judged == {d[0]: first(r[2]) for d, r in zip(data, rows, strict=True)}


def test_empty_table_and_no_python(spark, none, docs, labels):
    assert rules.judge(none, labels).count() == 0
    plan = rules.document_counts(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan
