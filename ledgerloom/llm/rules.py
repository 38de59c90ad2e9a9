"""Quality rules learned as a decision list, in DataFrame operations alone.

Sequential covering: each rule grows by the threshold that adds most information about the
rejected label, is pruned on rows set aside, and takes the rows it covers out of the rest. The
ordered rules become one Spark conditional expression over document statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, id_fold, scratch

#: Labelled rows the rules are learned from at most, picked by a hash of their ids.
LABELLED_ROWS = 200_000
#: Thresholds tried for a statistic: so many quantiles.
CUTS = 24
MOST_RULES, MOST_CONDITIONS = 8, 4
#: A rule stands if, on rows set aside, it rejects at least so many and is right so often.
LEAST_COVER, LEAST_PRECISION = 5, 0.8

SPACES = r"[\x20\x09-\x0D]+"
_SPACE_CHARS = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("log_words", "chars_a_word", "symbols_a_word", "dup_lines_a_line", "repeat_share", "distinct_share", "upper_share", "digit_share", "marks_a_word", "bars_a_word", "other_share")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words lying in a 3-word window that occurs twice or more.

    Windows are sorted with their positions, those equal to a neighbour are repeats, and each
    start adds the words that no earlier start has covered. Texts whose windows all differ,
    which a set of window hashes shows, skip that.
    """
    at = F.size(words) - 2

    def of_windows(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def starts(rows: Column) -> Column:
            same = lambda i, j: F.get(rows, i)["w"] == F.get(rows, j)["w"]
            twice = F.filter(F.transform(rows, lambda r, i: F.when(F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), r["i"])), lambda x: x.isNotNull())
            return F.array_sort(twice)

        def covered(first: Column) -> Column:
            gaps = F.zip_with(first, F.slice(first, F.lit(2), F.greatest(F.size(first) - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(3)))
            return F.when(F.size(first) > 0, F.aggregate(gaps, F.lit(0), lambda s, g: s + F.coalesce(g, F.lit(3)))).otherwise(0)

        return _let(_let(placed, starts), covered)

    leads = F.slice(words, F.lit(1), F.greatest(at, F.lit(0)))
    hashes = F.transform(leads, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    exact = F.transform(leads, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)))
    differ = _let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when((at < 2) | differ, 0).otherwise(_let(exact, of_windows))


def document_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the counts, the rates) of every document; null text has no words.

    Counts: n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word
    that equal an earlier line), n_repeat_words (words in repeated 3-word windows).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    among = lambda chars: (F.length("rest") - F.length(F.translate("rest", chars, "")))
    spaces = F.lit(_SPACE_CHARS)
    bare = F.btrim("text", spaces)
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, spaces) != "")
    rest = F.regexp_replace("text", r"[a-z\x20\x09-\x0D]+", "")  # holds all that is counted by character below
    held = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select("doc_id", words.alias("words"), lines.alias("lines"), rest.alias("rest"))
    counted = held.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        among(_SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        among("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        among("0123456789").alias("n_digits"),
        among("!?").alias("n_marks"),
        among("|").alias("n_bars"),
        F.length(F.regexp_replace("rest", r"[\p{L}\p{N}\x20\x09-\x0D.,;:!?'\"()-]+", "")).alias("n_others"),
    )
    by = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")
    return counted.select(
        "doc_id",
        *COUNTS,
        F.log1p("n_words").alias("log_words"),
        by("word_chars", "n_words").alias("chars_a_word"),
        by("n_symbols", "n_words").alias("symbols_a_word"),
        by("n_dup_lines", "n_lines").alias("dup_lines_a_line"),
        by("n_repeat_words", "n_words").alias("repeat_share"),
        by("n_distinct", "n_words").alias("distinct_share"),
        by("n_upper", "word_chars").alias("upper_share"),
        by("n_digits", "word_chars").alias("digit_share"),
        by("n_marks", "n_words").alias("marks_a_word"),
        by("n_bars", "n_words").alias("bars_a_word"),
        by("n_others", "word_chars").alias("other_share"),
    )


@dataclass(frozen=True)
class Condition:
    """``statistic <= cut`` or ``statistic > cut``."""

    statistic: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.statistic) > F.lit(self.cut) if self.above else F.col(self.statistic) <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that holds rejects the row, and a row that meets none is kept."""

    rules: tuple[Rule, ...]

    def number(self) -> Column:
        """The number of the first rule that holds, from 1; 0 if none does."""
        out = F.lit(0)
        for i, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(rule.column(), F.lit(i)).otherwise(out)
        return out

    def keeps(self) -> Column:
        return self.number() == 0


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information that a condition adds about the rejected rows it leaves covered."""
    return p * (math.log2((p + 1e-9) / (p + n + 1e-9)) - math.log2((p0 + 1e-9) / (p0 + n0 + 1e-9))) if p else 0.0


def _cuts_below(value: Column, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value))


def learn(stats: DataFrame, labels: DataFrame, *, usable: Column | None = None, label_col: str = "quality", id_col: str = "doc_id", statistics: tuple[str, ...] = RATES) -> DecisionList:
    """Learn rules that recognise label 0 from (doc_id, statistics) rows and a table of labels.

    Every step is one aggregation of the labelled rows by (statistic, quantile bin), so the
    driver gets at most ``len(statistics) * (CUTS + 1)`` rows a step however large the table is.
    Documents with several labels count once, by majority, and not at all at a tie; a repeated
    document counts as often as it occurs; of equal gains the first statistic and the lowest cut
    wins. No labelled row, and an empty table, give an empty list, which keeps everything.
    """
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).filter("y is not null and doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.avg("y").alias("y")).filter("y <> 0.5").select("doc_id", (F.col("y") < 0.5).alias("bad"))
    rows = stats.join(marks, "doc_id")
    labelled = rows = scratch((rows.filter(usable) if usable is not None else rows).select("doc_id", "bad", *statistics), "labelled")
    total = rows.select(F.lit(1)).count()
    if total > LABELLED_ROWS:
        rows = rows.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("rules")), F.lit(1 << 20)) < math.ceil(LABELLED_ROWS / total * (1 << 20)))
    rows = rows.select("bad", (id_fold("doc_id", 7) < 5).alias("grow"), *statistics)
    chances = [i / CUTS for i in range(CUTS + 1)]
    seen = rows.agg(*(F.percentile_approx(s, chances, 5000).alias(s) for s in statistics), *(F.percentile_approx(F.when(F.col("bad"), F.col(s)), chances, 5000).alias(f"bad_{s}") for s in statistics)).first()
    if not total or seen[statistics[0]] is None:
        return DecisionList(())
    cuts = {s: sorted({*seen[s], *(seen[f"bad_{s}"] or ())}) for s in statistics}
    names = list(statistics)
    bins = [_cuts_below(F.col(s), cuts[s]).alias(f"bin_{s}") for s in names]
    left = scratch(rows.select("bad", "grow", *names, F.array(*bins).alias("bins")).repartition(8), "binned")

    def tally(part: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
        spread = part.select("bad", F.posexplode("bins").alias("statistic", "bin"))
        found = spread.groupBy("statistic", "bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
        return {(r.statistic, r.bin): (r.p, r.n) for r in found.collect()}

    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        open_rows = left.filter(DecisionList(tuple(rules)).keeps())
        conditions: list[Condition] = []
        while len(conditions) < MOST_CONDITIONS:
            counted = tally(open_rows.filter("grow").filter(Rule(tuple(conditions), 0.0).column()))
            p0 = sum(p for (s, _), (p, _) in counted.items() if s == 0)
            n0 = sum(n for (s, _), (_, n) in counted.items() if s == 0)
            if p0 < LEAST_COVER or not n0:
                break
            best, choice = 1e-9, None
            for s, name in enumerate(names):
                p = n = 0
                for b, cut in enumerate(cuts[name]):
                    add = counted.get((s, b), (0, 0))
                    p, n = p + add[0], n + add[1]
                    for above, (cp, cn) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        if (gain := _gain(cp, cn, p0, n0)) > best:
                            best, choice = gain, Condition(name, above, float(cut))
            if choice is None:
                break
            conditions.append(choice)
        if not conditions:
            break
        held = [F.count_if(F.col("bad") & Rule(tuple(conditions[:k]), 0.0).column()).alias(f"p{k}") for k in range(1, len(conditions) + 1)]
        held += [F.count_if(~F.col("bad") & Rule(tuple(conditions[:k]), 0.0).column()).alias(f"n{k}") for k in range(1, len(conditions) + 1)]
        aside = open_rows.filter(~F.col("grow")).agg(*held).first()
        worth = [(aside[f"p{k}"] - aside[f"n{k}"]) / max(1, aside[f"p{k}"] + aside[f"n{k}"]) for k in range(1, len(conditions) + 1)]
        k = max(range(len(worth)), key=lambda i: (worth[i], -i)) + 1
        good, wrong = aside[f"p{k}"], aside[f"n{k}"]
        if good < LEAST_COVER or good / (good + wrong) < LEAST_PRECISION:
            break
        rules.append(Rule(tuple(conditions[:k]), good / (good + wrong)))
    discard(labelled, left)
    return DecisionList(tuple(rules))


def judge(docs: DataFrame, labels: DataFrame, *, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every document, base_failed, rule (the number of the rule that rejects it, else 0) and kept.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated windows. Null,
    empty and blank texts fail it. Repeated rows are judged alike; an empty table gives no rows.
    """
    stats = scratch(document_counts(docs, id_col=id_col, text_col=text_col), "counts")
    found = learn(stats, labels, usable=usable)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select("doc_id", *COUNTS, failed.alias("base_failed"), found.number().alias("rule"), (~failed & found.keeps()).alias("kept"))
