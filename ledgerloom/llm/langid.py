"""Language identification of mixed-language text.

White-space words are cut where their script changes, so texts without spaces are mixed text too.
Script ranges narrow the candidate languages of a word, words score each candidate (by corpus
counts, else by their character trigrams), and a Viterbi pass with a penalty for every switch
labels spans. A document's language is the one whose spans hold most letters.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHARS_AT_ONCE, arrow_of, bounded, discard, id_fold, most_frequent, rows_out, scratch, type_of, whole_texts

UNKNOWN = "und"
#: Log-probability that a change of language between two words costs.
SWITCH_PENALTY = 6.0
#: Documents the model is fitted on for each language at most (about), picked by a hash of their ids.
TRAINING_DOCS = 10_000
#: Words that the model keeps for a language, the most frequent ones, and for all languages together (but LEAST_WORDS for
#: each); other words are scored by their trigrams.
WORDS_A_LANGUAGE, WORDS_IN_ALL, LEAST_WORDS = 25_000, 2_000_000, 1_000
#: Scores (words times languages) that a task keeps.
SCORES_HELD = 1_000_000
#: What one word can count for or against a language at most.
WORD_RANGE = 8.0
#: How well words have to fit the languages of their own spans for a text to pass as identified.
LEAST_FIT = 0.3

# First and last code points of letters by script (Unicode blocks).
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x531, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}


@cache
def script_of(char: str) -> str | None:
    """The script of a letter, None for everything else and for letters outside the table."""
    if not char.isalpha():
        return None
    at = ord(char)
    return next((name for name, ranges in SCRIPTS.items() if any(a <= at <= b for a, b in ranges)), None)


def _cuts() -> re.Pattern:
    """Places between letters of two scripts, whatever stands between them but white space."""
    own = {name: "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in ranges) for name, ranges in SCRIPTS.items()}
    every = "".join(own.values())
    return re.compile("|".join(f"(?<=[{chars}])(?=[^{every}]*+(?![{chars}])[{every}])" for chars in own.values()))


_CUT = _cuts()
#: Letters of all scripts but the first; texts without any have nothing to cut.
_OTHERS = re.compile("[" + "".join(f"\\U{a:08x}-\\U{z:08x}" for name, ranges in SCRIPTS.items() if name != "latin" for a, z in ranges) + "]")


def pieces_of(word: str) -> list[str]:
    """A white-space word, cut where its script changes; what stands between two scripts goes with the newer one."""
    return [word] if word.isascii() else [p for p in _CUT.split(word) if p]


def words_of(text: str) -> list[str]:
    """White-space words of a text, cut where their script changes."""
    words = text.split()
    return words if text.isascii() or not _OTHERS.search(text) else list(chain.from_iterable(map(pieces_of, words)))


#: What most often stands around a word's letters (fixed values; other characters are found one by one).
_AROUND = " .,;:!?'\"()[]{}<>|*#$%&+-_/\\=~^@`0123456789"


def letters_of(word: str) -> str:
    """The word in lower case without what surrounds its letters."""
    word = word.strip(_AROUND).lower()
    if word and not (word[0].isalpha() and word[-1].isalpha()):
        inside = [i for i, c in enumerate(word) if c.isalpha()]
        word = word[inside[0] : inside[-1] + 1] if inside else ""
    return word


def trigrams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


#: (language, log-probability over that of what is unseen) of a word or trigram, of languages that have it.
Gains = tuple[tuple[int, float], ...]


@dataclass
class LanguageModel:
    """Log-probabilities of words and trigrams by language, only of languages that have them; so its size goes with the words
    kept, not with words times languages."""

    languages: list[str]
    words: dict[str, Gains] = field(default_factory=dict)
    trigrams: dict[str, Gains] = field(default_factory=dict)
    unseen_word: list[float] = field(default_factory=list)
    unseen_gram: list[float] = field(default_factory=list)
    scripts: dict[str, tuple[bool, ...]] = field(default_factory=dict)

    def score(self, core: str) -> tuple[float, ...]:
        """Log-probability of a word's letters under each language, relative to the best and at least
        -WORD_RANGE; languages that never use the word's script get -4 * WORD_RANGE."""
        found = self.words.get(core)
        if found is not None:
            return self.relative(core, self._logs([found], self.unseen_word))
        return self.relative(core, self._logs([self.trigrams.get(t, ()) for t in trigrams(core)], self.unseen_gram))

    @staticmethod
    def _logs(counted: list[Gains], unseen: list[float]) -> list[float]:
        """Sums of add-a-half log-probabilities by language."""
        out = [len(counted) * x for x in unseen]
        for own in counted:
            for lang, gain in own:
                out[lang] += gain
        return out

    def relative(self, core: str, logs: Sequence[float]) -> tuple[float, ...]:
        used = [s for s in map(script_of, core) if s]
        allowed = self.scripts.get(max(set(used), key=used.count)) if used else None
        if allowed is None or all(allowed) or not any(allowed):
            best = max(logs)
            return tuple([max(v - best, -WORD_RANGE) for v in logs])
        best = max(v for v, a in zip(logs, allowed, strict=True) if a)
        return tuple(max(v - best, -WORD_RANGE) if a else -4 * WORD_RANGE for v, a in zip(logs, allowed, strict=True))


def train(docs: DataFrame, usable: Column, *, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", max_docs: int = TRAINING_DOCS) -> LanguageModel:
    """Fit on about ``max_docs`` rows a language at most, of those with ``usable``, a language and a text, picked by a
    hash of the id; so a rare language is learned from all it has, however large the table is.

    Words are counted inside tasks and summed by (language, word); only the words that the model
    keeps reach the driver, WORDS_A_LANGUAGE for each language and WORDS_IN_ALL together. No rows give a model without languages.
    """
    rows = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    found = {r.lang: r.n for r in rows.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if parts := [F.lit(x) for lang, n in found.items() if n > max_docs for x in (lang, math.ceil(max_docs / n * (1 << 20)))]:
        part = F.coalesce(F.element_at(F.create_map(*parts), F.col(lang_col).cast("string")), F.lit(1 << 20))
        rows = rows.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) < part)
    schema = arrow_of("lang string, word string, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter[str]] = defaultdict(Counter)

        def drain() -> pa.RecordBatch:
            out = [(lang, w, n) for lang, words in seen.items() for w, n in words.items()]
            seen.clear()
            return rows_out(schema, [[x[i] for x in out] for i in range(3)])

        for batch in bounded(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen[lang].update(words_of(text.lower()))
            if sum(map(len, seen.values())) > 500_000:
                yield drain()
        yield drain()

    raw = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "lang string, word string, n long")
    word = F.regexp_replace("word", r"^\P{L}+|\P{L}+$", "")
    counts = scratch(raw.select("lang", word.alias("word"), "n").filter("word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    most = min(WORDS_A_LANGUAGE, max(LEAST_WORDS, WORDS_IN_ALL // max(1, len(found))))
    kept = most_frequent(counts, most, "word", by="lang")
    discard(counts)
    return fit(sorted(found), list(kept[["lang", "word", "n"]].itertuples(index=False, name=None)))


def fit(languages: list[str], counts: list[tuple[str, str, int]]) -> LanguageModel:
    """The model of (language, word, count) rows."""
    place = {lang: i for i, lang in enumerate(languages)}
    words, grams, scripts = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, word, count in counts:
        at = place[lang]
        words[word][at] += count
        for t in trigrams(word):
            grams[t][at] += count
        for c in word:
            if s := script_of(c):
                scripts[s][at] += count

    def unseen(table: dict[str, Counter[int]]) -> list[float]:
        sums = [0.5 * (len(table) + 1)] * len(languages)
        for own in table.values():
            for at, n in own.items():
                sums[at] += n
        return [math.log(0.5 / n) for n in sums]

    sparse = lambda table: {k: tuple((at, math.log((n + 0.5) / 0.5)) for at, n in v.items()) for k, v in table.items()}
    by_lang = [max(1, sum(v[i] for v in scripts.values())) for i in range(len(languages))]
    allowed = {s: tuple(v[i] >= 0.01 * t for i, t in enumerate(by_lang)) for s, v in scripts.items()}
    return LanguageModel(languages, sparse(words), sparse(grams), unseen(words), unseen(grams), allowed)


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word, for many texts at once.

    ``scores`` holds the words of all texts in a row (words x languages), ``sizes`` the words of
    each text. All texts take a step together, longest first, so those that have ended drop off
    at the end.
    """
    n_langs = scores.shape[1]
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    lengths = sizes[order]
    steps = int(lengths[0]) if len(lengths) else 0
    live = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")  # texts with a word at each step
    came = np.zeros((len(scores), n_langs), np.int16)
    ends = np.zeros(len(sizes), np.int16)
    at = np.zeros((len(sizes), n_langs))
    own = np.arange(n_langs, dtype=np.int16)
    for t in range(steps):
        k = live[t]
        here = at[:k]
        if t:
            best = here.argmax(1)
            jump = here[np.arange(k), best] - penalty
            stay = here >= jump[:, None]
            came[first[:k] + t] = np.where(stay, own, best[:, None])
            here = np.where(stay, here, jump[:, None])
        at[:k] = here + scores[first[:k] + t]
        gone = live[t + 1] if t + 1 < steps else 0
        ends[gone:k] = at[gone:k].argmax(1)
    labels = np.zeros(len(scores), np.int16)
    now = ends.copy()
    for t in range(steps - 1, -1, -1):
        k = live[t]
        labels[first[:k] + t] = now[:k]
        if t:
            now[:k] = came[first[:k] + t, now[:k]]
    return labels


class Labeller:
    """Labels texts with a model; scores of distinct words are kept, up to a bound."""

    def __init__(self, model: LanguageModel, penalty: float = SWITCH_PENALTY):
        self.model, self.penalty = model, penalty
        self.held = max(1000, SCORES_HELD // max(5, len(model.languages)))  # words
        self._clear()

    def _clear(self) -> None:
        """Number 0 is for words without letters, which speak for no language."""
        self.ids: dict[str, int] = {}
        self.cores: dict[str, int] = {"": 0}
        self.table = np.zeros((0, len(self.model.languages)), np.float32)  # scores
        self.belief = self.table  # the same as shares of probability
        self.weights = np.zeros(0, np.int64)  # letters
        self._add([(0.0,) * len(self.model.languages)], [0])

    def _add(self, rows: list[tuple[float, ...]], weights: list[int]) -> None:
        new = np.array(rows, np.float32)
        share = np.exp(new)
        self.table = np.concatenate([self.table, new])
        self.belief = np.concatenate([self.belief, share / share.sum(1, keepdims=True)])
        self.weights = np.concatenate([self.weights, np.array(weights, np.int64)])

    def _numbers(self, words: list[list[str]]) -> None:
        """Number the words; the scores of new ones are worked out once."""
        new = set().union(*words) - self.ids.keys() if words else set()
        if len(self.ids) + len(new) > self.held:
            self._clear()
            new = set().union(*words)
        ids, cores, rows, weights, first = self.ids, self.cores, [], [], len(self.table)
        for w in new:
            core = letters_of(w)
            number = cores.get(core)
            if number is None:
                number = cores[core] = first + len(rows)
                rows.append(self.model.score(core))
                weights.append(len(core))
            ids[w] = number
        if rows:
            self._add(rows, weights)

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]], float]]:
        """(language, score, spans, fit) of each text; spans are (first word, words, language) over the words of :func:`words_of`.

        The score tells how far the words speak for the text's language, the fit how far each speaks
        for the language of its own span, both as shares of probability averaged over letters.
        """
        n, languages = len(self.model.languages), self.model.languages
        words = [words_of(t or "") for t in texts]
        if not n:
            return [(UNKNOWN, 0.0, [], 0.0)] * len(texts)
        self._numbers(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.concatenate([np.fromiter(map(self.ids.__getitem__, w), np.int64, len(w)) for w in words]) if len(words) else np.zeros(0, np.int64)
        weight = self.weights[ids]
        labels = viterbi(self.table[ids], sizes, self.penalty)
        ends = np.cumsum(sizes)
        doc = np.repeat(np.arange(len(words)), sizes)
        mass = np.bincount(doc * n + labels, weight, len(words) * n).reshape(len(words), n)
        chosen, total = mass.argmax(1), mass.sum(1)
        trust, fit = (np.bincount(doc, self.belief[ids, by] * weight, len(words)) for by in (chosen[doc], labels))
        out = []
        for i, end in enumerate(ends.tolist()):
            if not total[i]:
                out.append((UNKNOWN, 0.0, [], 0.0))
                continue
            own = labels[end - sizes[i] : end]
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            spans = [(a, b - a, languages[own[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]
            out.append((languages[chosen[i]], float(min(1.0, trust[i] / total[i])), spans, float(min(1.0, fit[i] / total[i]))))
        return out


def label_documents(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every document, plus the columns named in ``keep``.

    Null, empty and letterless texts are ``und`` with score 0 and no spans; repeated rows are
    labelled alike; ties go to the language first in order; an empty table gives no rows.
    """
    source = whole_texts(docs, id_col, text_col)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    ddl = f"doc_id {type_of(source, 'doc_id')}, lang_pred string, score double, spans array<struct<first_word:int,words:int,lang:string>>"
    schema = arrow_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shipped.value)
        for batch in bounded(batches, limit=CHARS_AT_ONCE // 4):
            found = labeller.label(batch.column("text").to_pylist())
            spans = [[{"first_word": a, "words": n, "lang": lang} for a, n, lang in x[2]] for x in found]
            yield rows_out(schema, [batch.column("doc_id"), [x[0] for x in found], [x[1] for x in found], spans])

    return source.mapInArrow(run, ddl)


def keep_identified(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", least: float = LEAST_FIT) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text has a language and whose words fit those of their spans.

    Null, empty and letterless texts go, evenly mixed languages stay, repeated rows share their fate,
    long texts are labelled whole, and an empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shipped.value)
        for batch in bounded(batches, at, CHARS_AT_ONCE // 4):
            found = labeller.label(batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and fit >= least for lang, _, _, fit in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_rows(id_col: str = "doc_id") -> Column:
    """Rows that the registered query and the pipeline may learn from; the rest is held out."""
    return id_fold(id_col, 4) != 2
