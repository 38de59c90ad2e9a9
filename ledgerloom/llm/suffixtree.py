"""Language-model scores by a probabilistic suffix tree over words.

The root holds add-one word probabilities. Below it stand contexts of the last one to DEPTH words,
kept where their next-word counts diverge from what their shorter suffix predicts. A state's counts
are discounted and the rest of its mass goes to its suffix, so every state is a proper distribution.
A word is scored in the state of the longest suffix that the tree holds.

The tree grows with the corpus and is never in one place. All states that end in one word (the
newest of their context) lie together, so tokens are dealt by their newest word, each with the words
before it; the task that gets them counts, tests and keeps the states below that word, level by
level, and scores the tokens in them. Words, and longer contexts, that take more than a shard's share
of all tokens, learned from or held out, are wide: all tasks know them, and tokens after them are
dealt by the next longer suffix. So no group grows beyond a bound, and wide contexts can't be many.

Tasks hold the most frequent words and the most frequent next words of wide contexts. What else a
task needs of either, it asks for: the keys of all its tokens go, packed, to where their counts lie,
and the counts come back to it before it tests or scores anything. So results don't depend on how
much is held.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_of, bounded, discard, id_fold, most_frequent, rows_out, scratch, type_of, whole_texts
from .neardup import mixed

#: Words, and next words of wide contexts, that tasks hold (speed only: the others are asked for).
HEAD, ENTRIES_HELD = 200_000, 500_000
#: Words of the longest context.
DEPTH = 3
#: A context needs so many occurrences, a next word so many after it, to be considered.
LEAST_CONTEXT, LEAST_NEXT = 2, 2
#: What a next word's count is discounted by.
DISCOUNT = 0.75
#: A context is wide if it takes more than one in WIDE_PART of all tokens, or more than WIDE_TOKENS, but always more
#: than one in WIDE_SHARE (balance only, never results).
WIDE_PART, WIDE_TOKENS, WIDE_SHARE = 250, 2_000_000, 20_000
#: Tokens of a shard on average, shards that a task takes one after the other; bytes of text that a task lays out at a time;
#: keys that a task gathers before it drops repeated ones; counts of what isn't held that lie together.
SHARD_TOKENS, SHARDS_A_TASK, BYTES_AT_ONCE, KEYS_HELD, TOLD_A_PART = 500_000, 4, 4_000_000, 1_000_000, 250_000
#: Rows of a batch that a task gives away (memory only).
ROWS_AT_ONCE = 50_000

END = b""
_RARE, _START, _SHORT, _NONE = 1 << 62, 1 << 61, 1 << 33, -1
_STEP, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def tokens(text: str) -> list[bytes]:
    """White-space words with A-Z in lower case, then the end."""
    return [*text.encode("utf-8", "replace").lower().split(), END]


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(tokens of each text, each token's place in a list of words, that list): what :func:`tokens` gives, worked out on columns."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = split.flatten().dictionary_encode()
    listed, at = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    if END in listed:  # before and after white space at a text's edge
        inside = at != listed.index(END)
        at, text = at[inside], text[inside]
    else:
        listed.append(END)
    sizes = np.bincount(text, minlength=len(texts)) + 1
    number = np.full(int(sizes.sum()), listed.index(END))
    word = np.ones(len(number), bool)
    word[np.cumsum(sizes) - 1] = False
    number[word] = at
    return sizes, number, listed


class Codes(dict):
    """Ranks of the head words; a hash with a mark for the others."""

    def __missing__(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(word, 42) >> 2 | _RARE

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def rare_code(word: Column) -> Column:
    """The code of a word outside the head, as :class:`Codes` gives it."""
    return F.shiftrightunsigned(F.xxhash64(word), 2).bitwiseOR(F.lit(_RARE))


def folded(state: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Hashes of contexts one word longer; words are taken in from the newest to the oldest."""
    return mixed((state ^ code.astype(np.uint64)) * _FOLD + _STEP)


def entry_of(state: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Hashes of (context, next word)."""
    return mixed(mixed(state + _STEP) ^ code.astype(np.uint64))


def shortened(code: np.ndarray) -> np.ndarray:
    """Codes with 32 bits for words outside the head: enough to tell those apart that precede the same newer words, or that
    newest words of one shard are."""
    return np.where(code >= _RARE, code & 0xFFFFFFFF | _SHORT, code)


@dataclass
class Tokens:
    """Tokens in a row: their text's number, code, and the words before each, newest first."""

    doc: np.ndarray
    code: np.ndarray
    before: list[np.ndarray]

    @classmethod
    def of(cls, sizes: np.ndarray, code: np.ndarray) -> Tokens:
        short = shortened(code)
        place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        before = []
        for k in range(1, DEPTH + 1):
            own = np.full(len(code), _NONE)
            own[k:] = code[:-k] if k == 1 else short[:-k]
            own[place < k] = _NONE
            own[place == k - 1] = _START
            before.append(own)
        return cls(np.repeat(np.arange(len(sizes)), sizes), code, before)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each key, first place of each group), groups in the order in which they come."""
    group = pd.factorize(keys)[0]
    return group, np.flatnonzero(np.diff(np.maximum.accumulate(group), prepend=-1))


def _looked_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of each wanted key in sorted ``keys``."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def judged(k: np.ndarray, held: np.ndarray, seen: np.ndarray, gain: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stays, rest) of each context from sums over its next words: how many, their counts, their probabilities in the suffix,
    and count times logarithm of share over that probability.

    A context stays if twice its log-likelihood gain over its suffix exceeds what chance gives:
    k + 3 * sqrt(2 k) for k next words. The rest is the mass that it leaves to its suffix.
    """
    whole, other = np.maximum(totals, 1), np.maximum(totals - held, 0)
    gain = 2.0 * gain + 2 * np.where(other > 0, other * np.log(np.maximum(other / whole, 1e-300) / np.maximum(1 - seen, 1e-9)), 0)
    stays = (totals >= LEAST_CONTEXT) & (k > 0) & (gain > k + 3 * np.sqrt(2 * np.maximum(k, 1)))
    return stays, np.where(stays, (DISCOUNT * k + other) / whole, 1.0)


def tested(context: np.ndarray, n: np.ndarray, totals: np.ndarray, expected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`judged` from next words' (context, count, probability in the suffix) rows."""
    size = len(totals)
    share = n / np.maximum(totals, 1)[context]
    gain = np.bincount(context, n * np.log(np.maximum(share, 1e-300) / np.maximum(expected, 1e-300)), size)
    return judged(np.bincount(context, minlength=size), np.bincount(context, n, size), np.bincount(context, expected, size), gain, totals)


@dataclass
class Facts:
    """What tasks ask for, by ascending keys: training counts of words outside the head, masses of (wide context, next word)
    that aren't held."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    entries: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    mass: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class WideLevel:
    """The wide contexts of one length: hash, whether it is a state, rest; hashes and masses of held (context, next word)."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    stays: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    rest: np.ndarray = field(default_factory=lambda: np.ones(0))
    entries: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    mass: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _mass_of(keys: np.ndarray, mass: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mass, 0 where there is none; found) of entries."""
    at, hit = _looked_up(keys, wanted)
    return np.where(hit, mass[at] if len(mass) else 0.0, 0.0), hit


@dataclass
class Top:
    """What all tasks hold of the tree: the head words with their training counts, the root, the wide contexts.

    ``whole_words`` and ``whole_entries`` tell that nothing exists beside what is held.
    """

    words: Sequence[bytes]  # by rank
    counts: np.ndarray
    total: int
    distinct: int
    levels: list[WideLevel]
    whole_words: bool = True
    whole_entries: bool = True

    def codes(self) -> Codes:
        return Codes(zip(self.words, range(len(self.words)), strict=True))

    def trained(self, code: np.ndarray, facts: Facts) -> np.ndarray:
        """Training counts of words; of those outside the head as the facts tell."""
        known = code < len(self.words)
        n = np.where(known, self.counts[np.where(known, code, 0)] if len(self.counts) else 0, 0)
        if len(facts.words):
            at, found = _looked_up(facts.words, code)
            n = np.where(~known & found, facts.counts[at], n)
        return n

    def root(self, code: np.ndarray, facts: Facts) -> np.ndarray:
        return (self.trained(code, facts) + 1.0) / (self.total + self.distinct + 1.0)

    def walked(self, t: Tokens, facts: Facts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(words of the longest wide suffix, hash of the suffix one word longer, mass, rest, lacking) of each token: its
        probability there is the mass and the rest times the root's. ``lacking`` has tokens, and the entries they need,
        that neither this nor the facts hold; where an entry is nowhere, its mass is 0."""
        size = len(t.code)
        depth, mass, rest, state = np.zeros(size, np.int64), np.zeros(size), np.ones(size), np.zeros(size, np.uint64)
        longer, lacking = np.zeros(size, np.uint64), []
        for d, level in enumerate(self.levels, 1):
            state = folded(state, t.before[d - 1])
            open_here = (depth == d - 1) & (t.before[d - 1] != _NONE)
            longer = np.where(open_here, state, longer)
            at, found = _looked_up(level.keys, state)
            found &= open_here
            if found.any():
                i = np.flatnonzero(found)
                entry, own_rest = entry_of(state[i], t.code[i]), level.rest[at[i]]
                own, hit = _mass_of(level.entries, level.mass, entry)
                if not self.whole_entries:
                    more, told = _mass_of(facts.entries, facts.mass, entry)
                    own = np.where(hit, own, more)
                    open_entry = level.stays[at[i]] & ~hit & ~told
                    lacking.append((i[open_entry], entry[open_entry]))
                mass[i] = own + own_rest * mass[i]
                rest[i] *= own_rest
                depth[i] = d
        return depth, longer, mass, rest, lacking


def grown(t: Tokens, training: np.ndarray, depth: np.ndarray, mass: np.ndarray, rest: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(mass, rest, states kept by length) of tokens in the tree grown on those with ``training``, from the ``depth``, mass
    and rest of their longest wide suffix on. The tokens hold every training token of each context below that."""
    mass, rest, live, state, kept = mass.copy(), rest.copy(), np.ones(len(t.code), bool), np.zeros(len(t.code), np.uint64), []
    for d in range(1, DEPTH + 1):
        state = folded(state, t.before[d - 1])
        live &= t.before[d - 1] != _NONE
        at = np.flatnonzero(live & (depth < d))
        context, one = _grouped(state[at])
        totals = np.bincount(context[training[at]], minlength=len(one))
        often = totals[context] >= LEAST_CONTEXT
        live[at[~often]] = False
        at, context = at[often], context[often]
        if not len(at):
            kept.append(0)
            continue
        entry, first = _grouped(entry_of(state[at], t.code[at]))
        n = np.bincount(entry[training[at]], minlength=len(first))
        counted = n >= LEAST_NEXT
        lead = at[first[counted]]
        stays, left = tested(context[first[counted]], n[counted], totals, mass[lead] + rest[lead] * root[lead])
        own = np.where(counted, (n - DISCOUNT) / np.maximum(totals[context[first]], 1), 0.0)
        inside = stays[context]
        i, c = at[inside], context[inside]
        mass[i] = own[entry[inside]] + left[c] * mass[i]
        rest[i] *= left[c]
        kept.append(int(stays.sum()))
    return mass, rest, kept


# -- on Spark --------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, m): training tokens and all tokens of (text, training) rows, the end as empty bytes."""
    schema = arrow_of("word binary, n long, m long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def given() -> Iterator[pa.RecordBatch]:
            summed = pa.Table.from_batches(held, schema).group_by("word", use_threads=False).aggregate([("n", "sum"), ("m", "sum")])
            held.clear()
            yield from summed.select(["word", "n_sum", "m_sum"]).rename_columns(schema.names).cast(schema).to_batches(max_chunksize=ROWS_AT_ONCE)

        for batch in bounded(batches):
            sizes, number, words = numbered(batch.column("text"))
            training = np.repeat(batch.column("training").to_numpy(zero_copy_only=False).astype(bool), sizes)
            held.append(rows_out(schema, [words, np.bincount(number[training], minlength=len(words)), np.bincount(number, minlength=len(words))]))
            n += len(words)
            if n > 1_000_000:
                held[:] = given()
                n = sum(map(len, held))
                if n > 500_000:
                    yield from held
                    held.clear()
                    n = 0
        yield from given()
        pa.default_memory_pool().release_unused()

    return docs.select("text", "training").mapInArrow(run, "word binary, n long, m long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def wide_counts(docs: DataFrame, top: Top, wide: np.ndarray) -> DataFrame:
    """(depth, suffix, state, code, n, m): next words of contexts made of ``wide`` codes alone, in training and in all texts."""
    shipped = docs.sparkSession.sparkContext.broadcast((top, np.sort(wide)))
    ddl = "depth int, suffix long, state long, code long, n long, m long"
    schema = arrow_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, wide = shipped.value
        codes, held, n = top.codes(), [], 0

        def summed() -> Iterator[pa.RecordBatch]:
            frame = pd.concat(held) if held else pd.DataFrame({c: [] for c in schema.names}, dtype="int64")
            held.clear()
            frame = frame.groupby(["depth", "suffix", "state", "code"], as_index=False)[["n", "m"]].sum()
            rows = rows_out(schema, [frame[c].to_numpy(np.int64) for c in schema.names])
            yield from (rows.slice(a, ROWS_AT_ONCE) for a in range(0, len(rows), ROWS_AT_ONCE))

        with np.errstate(over="ignore"):
            for batch in bounded(batches):
                sizes, number, words = numbered(batch.column("text"))
                t = Tokens.of(sizes, codes.of(words)[number])
                training = batch.column("training").to_numpy(zero_copy_only=False).astype(bool)[t.doc]
                at = np.flatnonzero(_looked_up(wide, t.before[0])[1])
                code, state = t.code[at], np.zeros(len(at), np.uint64)
                for d in range(1, DEPTH + 1):
                    inside = _looked_up(wide, t.before[d - 1][at])[1]
                    at, code, suffix = at[inside], code[inside], state[inside]
                    state = folded(suffix, t.before[d - 1][at])
                    same, first = _grouped(entry_of(state, code))
                    own, count = np.bincount(same[training[at]], minlength=len(first)), np.bincount(same, minlength=len(first))
                    held.append(pd.DataFrame({"depth": d, "suffix": suffix[first].view(np.int64), "state": state[first].view(np.int64), "code": code[first], "n": own, "m": count}))
                    n += len(first)
                del sizes, number, words, t, training, at, code, state, suffix, inside, same
                if n > 600_000:
                    yield from summed()
                    n = 0
            yield from summed()

    return docs.select("text", "training").mapInArrow(run, ddl).groupBy("depth", "suffix", "state", "code").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _codes_of(counts: DataFrame) -> DataFrame:
    """(code, trained) of all words as if none were in the head; head words' codes are others and never asked for."""
    return counts.select(rare_code(F.col("word")).alias("code"), F.col("n").alias("trained"))


def planted(docs: DataFrame, counts: DataFrame) -> tuple[Top, DataFrame | None]:
    """What all tasks hold, and (key, mass) of every next word of a wide context.

    Wide contexts are judged level by level: each next word's probability in the suffix comes from
    the root's counts, then from the level before. The driver gets HEAD words, at most WIDE_SHARE
    wide contexts of each length, and ENTRIES_HELD next words of these, whatever the corpus's size.
    """
    sums = counts.agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.count_if(F.col("n") > 0).alias("v"), F.count(F.lit(1)).alias("words"), F.max(F.when(F.col("word") == F.lit(END), F.col("m"))).alias("docs")).first()
    total, every, n_docs = sums["n"] or 0, sums["m"] or 0, sums["docs"] or 0
    found = most_frequent(counts.select("word", F.col("m").alias("n"), F.col("n").alias("trained")), HEAD, "word")
    top = Top([bytes(w) for w in found["word"]], found["trained"].to_numpy(np.int64), total, sums["v"], [WideLevel() for _ in range(DEPTH)], sums["words"] == len(found))
    least = max(min(every // WIDE_PART, WIDE_TOKENS), every // WIDE_SHARE)
    wide = [i for i, (w, n) in enumerate(zip(top.words, found["n"].tolist(), strict=True)) if n > least and w != END] + ([_START] if n_docs > least else [])
    if not wide:
        return top, None
    spark, shipped = docs.sparkSession, docs.sparkSession.sparkContext.broadcast(top)
    counted = scratch(wide_counts(docs, top, np.array(wide, np.int64)), "wide")
    contexts = counted.groupBy("depth", "state").agg(F.sum("n").alias("total"), F.sum("m").alias("m")).filter(F.col("m") > least).toPandas()
    of_wide = F.broadcast(spark.createDataFrame([(int(d), int(s), int(n)) for d, s, n in zip(contexts["depth"], contexts["state"], contexts["total"], strict=True)], "depth int, state long, total long"))
    nexts = counted.filter(F.col("n") >= LEAST_NEXT).drop("m").join(of_wide, ["depth", "state"])
    level_ddl = "suffix long, state long, code long, n long, total long, expected double"
    schema = arrow_of(level_ddl)

    def at_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, told = b.column("code").to_numpy(), b.column("trained").fill_null(0).to_numpy()
            n = np.where(code < len(shipped.value.words), shipped.value.trained(code, Facts()), told)
            yield rows_out(schema, [*(b.column(c) for c in schema.names[:5]), (n + 1.0) / (total + shipped.value.distinct + 1.0)])

    used, entries, before = [counted], [], None
    for d in range(1, DEPTH + 1):
        rows = nexts.filter(F.col("depth") == d).drop("depth")
        if before is None:
            rows = rows.join(_codes_of(counts), "code", "left").select(*schema.names[:5], "trained").mapInArrow(at_root, level_ddl)
        else:
            rows = rows.join(before, ["suffix", "code"])
        level = scratch(rows.select(*schema.names), "level")
        used.append(level)
        gain = F.col("n") * F.log(F.greatest(F.col("n") / F.col("total"), F.lit(1e-300)) / F.greatest("expected", F.lit(1e-300)))
        seen = level.groupBy("state").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("held"), F.sum("expected").alias("seen"), F.sum(gain).alias("gain")).toPandas()
        own = contexts[contexts["depth"] == d].merge(seen, "left", "state").fillna(0).assign(key=lambda x: x["state"].to_numpy(np.int64).view(np.uint64)).sort_values("key")
        stays, rest = judged(*(own[c].to_numpy(np.float64) for c in ("k", "held", "seen", "gain")), own["total"].to_numpy(np.int64))
        top.levels[d - 1] = WideLevel(own["key"].to_numpy(np.uint64), stays, rest)
        verdicts = F.broadcast(spark.createDataFrame([(int(s), bool(y), float(r)) for s, y, r in zip(own["state"], stays, rest, strict=True)], "state long, stays boolean, rest double"))
        mass = F.when(F.col("stays"), (F.col("n") - DISCOUNT) / F.col("total")).otherwise(0.0)
        judged_rows = level.join(verdicts, "state").select("state", "code", "n", "stays", mass.alias("mass"), (mass + F.col("rest") * F.col("expected")).alias("expected"))
        before = judged_rows.select(F.col("state").alias("suffix"), "code", "expected")
        entries.append(judged_rows.filter("stays").select(F.lit(d).alias("depth"), "state", "code", "n", "mass"))
    entry_schema = arrow_of("depth int, key long, n long, mass double")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                key = entry_of(b.column("state").to_numpy().view(np.uint64), b.column("code").to_numpy()).view(np.int64)
                yield rows_out(entry_schema, [b.column("depth"), key, b.column("n"), b.column("mass")])

    listed = entries[0]
    for more in entries[1:]:
        listed = listed.union(more)
    listed = scratch(listed.mapInArrow(keyed, "depth int, key long, n long, mass double"), "entries")
    discard(*used)
    held = most_frequent(listed, ENTRIES_HELD, "key")
    top.whole_entries = listed.count() == len(held)
    for d, level in enumerate(top.levels, 1):
        own = held[held["depth"] == d].assign(key=lambda x: x["key"].to_numpy(np.int64).view(np.uint64)).sort_values("key")
        level.entries, level.mass = own["key"].to_numpy(np.uint64), own["mass"].to_numpy(np.float64)
    return top, listed.select("key", "mass")


def _planes(column: np.ndarray) -> bytes:
    return np.ascontiguousarray(column).view(np.uint8).reshape(len(column), column.dtype.itemsize).T.tobytes()


def _column(raw: np.ndarray, at: int, size: int, kind: type) -> tuple[np.ndarray, int]:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw[at : at + width * size].reshape(width, size).T).reshape(-1).view(kind), at + width * size


_LISTED, _FROM = 0, 3  # a column's 0 stands for a listed value, 1 for the start, 2 for no word; ranks begin at 3


def _narrow(code: np.ndarray) -> np.ndarray:
    short = (code + _FROM).astype(np.int32)
    for mark, wide in ((_LISTED, code >= _SHORT), (1, code == _START), (2, code == _NONE)):
        short[wide] = mark
    return short


def _bytes_of(column: np.ndarray) -> list[np.ndarray]:
    """The planes of bytes of numbers from 0 on, as many as the largest needs."""
    return [(column >> shift).astype(np.uint8) for shift in range(0, max(int(column.max(initial=0)).bit_length(), 1), 8)]


def _from_bytes(raw: np.ndarray, at: int, size: int, planes: int, kind: type) -> tuple[np.ndarray, int]:
    own = raw[at : at + size].astype(kind)
    for k in range(1, planes):
        own |= raw[at + k * size : at + (k + 1) * size].astype(kind) << (8 * k)
    return own, at + planes * size


_HEAD = 2 * DEPTH + 5


class Packer:
    """Packs runs of tokens, compressed: ranks of head words as they are, words outside the head listed in their order, all
    numbers as planes of bytes. Columns are made for all tokens at once, so a short run costs little.

    A run begins with how many tokens it has, how many listed values and planes each column has, its
    first text and how many planes the steps from text to text have.
    """

    def __init__(self, t: Tokens, training: np.ndarray, order: np.ndarray):
        self.planes, self.widths, self.listed, self.upto = [], [], [], []
        for k, column in enumerate((t.code, *t.before)):
            own = column[order]
            short = _narrow(shortened(own))
            out = np.flatnonzero(short == _LISTED)
            planes = _bytes_of(short)
            self.widths.append(len(planes))
            self.planes += planes
            self.listed.append(own[out] if k == 0 else own[out].astype(np.uint32))
            self.upto.append(out)
        self.doc, self.zstd = t.doc[order], zstandard.ZstdCompressor(level=1)
        steps = _bytes_of(np.maximum(np.diff(self.doc, prepend=0), 0))  # below 0 where a run begins, which tells its first text
        self.widths.append(len(steps))
        self.planes += [*steps, training[order].astype(np.uint8)]

    def run(self, a: int, b: int) -> bytes:
        spans = [np.searchsorted(at, (a, b)).tolist() for at in self.upto]
        head = np.array([b - a, *(j - i for i, j in spans), *self.widths, self.doc[a]], "<i4").tobytes()
        return self.zstd.compress(b"".join([head, *(_planes(x[i:j]) for x, (i, j) in zip(self.listed, spans, strict=True)), *(x[a:b] for x in self.planes)]))


def _raw(data: bytes) -> tuple[np.ndarray, int, list[int], list[int], int]:
    """The bytes; how many tokens there are, how many listed values of each column, planes, the first text."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size, *more, doc = np.frombuffer(raw[: 4 * _HEAD], "<i4").tolist()
    return raw, size, more[: DEPTH + 1], more[DEPTH + 1 :], doc


def unpacked(data: bytes) -> tuple[Tokens, np.ndarray]:
    raw, size, listed, widths, first = _raw(data)
    at, values, columns = 4 * _HEAD, [], []
    for k, n in enumerate(listed):
        own, at = _column(raw, at, n, np.uint32 if k else np.int64)
        values.append(own.astype(np.int64) | _SHORT if k else own)
    for own, planes in zip(values, widths, strict=False):
        code, at = _from_bytes(raw, at, size, planes, np.int64)
        odd = np.flatnonzero(code < _FROM)
        mark = code[odd]
        code -= _FROM
        code[odd[mark == _LISTED]], code[odd[mark == 1]], code[odd[mark == 2]] = own, _START, _NONE
        columns.append(code)
    doc, at = _from_bytes(raw, at, size, widths[-1], np.int64)
    doc[:1] = first
    return Tokens(np.cumsum(doc), columns[0], columns[1:]), raw[at : at + size].astype(bool)


def rare_of(data: bytes) -> np.ndarray:
    """Codes of words outside the head among packed tokens."""
    raw, _, (rare, *_), _, _ = _raw(data)
    return _column(raw, 4 * _HEAD, rare, np.int64)[0]


def dealt(source: DataFrame, top, shards: int, bins: int) -> DataFrame:
    """One row a text (its base sums and what wide contexts settle) and one a shard and batch (its tokens), with their bin.

    A token is settled if its longest suffix is wide and nothing about it must be asked for. Others
    go to the shard of the suffix one word longer; those without such a suffix to that of their word.
    """
    ddl = f"bin int, shard int, row long, doc_id {type_of(source, 'doc_id')}, n_tokens long, n_known long, base double, part double, tokens binary"
    schema = arrow_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, row, none = top.value, TaskContext.get().partitionId() << 40, Facts()
        codes = held.codes()
        def laid_out(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:  # what it holds goes before the next begins
            sizes, number, words = numbered(batch.column("text"))
            t = Tokens.of(sizes, codes.of(words)[number])
            size, rare = batch.num_rows, t.code >= _RARE
            training = batch.column("training").to_numpy(zero_copy_only=False).astype(bool)[t.doc]
            depth, longer, mass, rest, lacking = held.walked(t, none)
            ends = depth == DEPTH
            for d, before in enumerate(t.before):
                ends |= (depth == d) & (before == _NONE)
            asks = rare.copy()
            for at, _ in lacking:
                asks[at] = True
            settled, root = ends & ~asks, held.root(t.code, none)
            part = np.bincount(t.doc[settled], np.log10(np.maximum(mass + rest * root, 1e-300))[settled], size)
            base = np.bincount(t.doc, np.where(rare, 0.0, np.log10(root)), size)
            known = np.bincount(t.doc, ~rare & (held.trained(t.code, none) > 0), size).astype(np.int64)
            rows = np.arange(row, row + size)
            yield rows_out(schema, [rows % bins, [None] * size, rows, batch.column("doc_id"), sizes, known, base, part, [None] * size])
            shard = (np.where(ends, mixed(t.code.astype(np.uint64)), longer) % np.uint64(shards)).astype(np.min_scalar_type(shards))
            order = np.flatnonzero(~settled)
            order = order[np.argsort(shard[order], kind="stable")]
            used, cuts = np.unique(shard[order], return_index=True)
            used, cuts = used.astype(np.int64), [*cuts.tolist(), len(order)]
            packer = Packer(t, training, order)
            blobs = [packer.run(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield rows_out(schema, [used % bins, used, [row] * len(used), *([None] * len(used),) * 5, blobs])

        with np.errstate(over="ignore"):
            for batch in bounded(batches, limit=BYTES_AT_ONCE):
                yield from laid_out(batch)
                row += batch.num_rows
        pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, ddl)


_WORD, _ENTRY = 0, 1
_KIND = {_WORD: np.int64, _ENTRY: np.float64}


def _numbers(column: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(_planes(column))


def _read(data: bytes, kind: type | str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return _column(raw, 0, len(raw) // np.dtype(kind).itemsize, kind)[0]


def _by_part(keys: np.ndarray, among: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys by part, then as they were; the part of each): the part of a key is its remainder, as Spark's pmod gives it."""
    part = keys % among
    order = np.argsort(part, kind="stable")
    return order, part[order]


def asked(parts: DataFrame, top, among: int) -> DataFrame:
    """(part, bin, kind, keys): sorted keys of the words outside the head, and of the entries that aren't held, of each bin's
    tokens, for each of the ``among`` parts of what is told."""
    ddl = "part int, bin int, kind int, keys binary"
    schema = arrow_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, n = top.value, {}, 0
        with np.errstate(over="ignore"):
            for batch in batches:
                for own, blob in zip(batch.column("bin").to_pylist(), batch.column("tokens"), strict=True):
                    if not blob.is_valid:
                        continue
                    found = {} if held.whole_words else {_WORD: rare_of(blob.as_buffer())}
                    if not held.whole_entries:
                        lacking = [e for _, e in held.walked(unpacked(blob.as_buffer())[0], Facts())[4]]
                        found[_ENTRY] = np.unique(np.concatenate(lacking)).view(np.int64) if lacking else np.zeros(0, np.int64)
                    for kind, key in found.items():
                        keys.setdefault((own, kind), []).append(key)
                        n += len(key)
                    if n > KEYS_HELD:
                        keys = {k: [np.unique(np.concatenate(v))] for k, v in keys.items()}
                        n = 0
        for (own, kind), found in keys.items():
            key = np.unique(np.concatenate(found))
            order, part = _by_part(key, among)
            key, (used, cuts) = key[order], np.unique(part, return_index=True)
            cuts = [*cuts.tolist(), len(key)]
            yield rows_out(schema, [used, [own] * len(used), [kind] * len(used), [_numbers(np.diff(key[a:b], prepend=0)) for a, b in zip(cuts, cuts[1:], strict=False)]])

    return parts.mapInArrow(run, ddl)  # all columns, so that both readers of what is dealt have one shuffle


def told(asks: DataFrame, counts: DataFrame, entries: DataFrame | None, among: int) -> DataFrame:
    """(bin, kind, part, keys, values) of what is asked; 0 where there is nothing. A bin knows the keys of its words, so
    these don't come back."""
    known = _codes_of(counts).filter(F.col("trained") > 0).select(F.lit(_WORD).alias("kind"), F.col("code").alias("key"), F.col("trained").cast("double").alias("value"))
    if entries is not None:
        known = known.union(entries.select(F.lit(_ENTRY), "key", "mass"))
    ddl = "bin int, kind int, part int, keys binary, values binary"
    schema = arrow_of(ddl)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds, out = right.column("kind").to_numpy(), []
        for kind, number in _KIND.items():
            own = left.filter(pc.equal(left.column("kind"), kind))
            key, value = (right.column(c).to_numpy()[kinds == kind] for c in ("key", "value"))
            order = np.argsort(key)
            key, value, values = key[order], value[order], []
            for blob in own.column("keys"):
                at, found = _looked_up(key, np.cumsum(_read(blob.as_buffer(), np.int64)))
                values.append(_numbers((np.where(found, value[at], 0.0) if len(key) else np.zeros(len(at))).astype(number)))
            out.append(rows_out(schema, [own.column("bin").combine_chunks(), own.column("kind").combine_chunks(), own.column("part").combine_chunks(), own.column("keys").combine_chunks() if kind == _ENTRY else [None] * len(own), values]))
        return pa.Table.from_batches(out, schema)

    return asks.groupBy("part").cogroup(known.withColumn("part", F.expr(f"int(pmod(key, {among}))")).groupBy("part")).applyInArrow(run, ddl)


def _facts(rare: list[np.ndarray], answers: pa.Table, among: int) -> Facts:
    """What a bin was told, whose tokens have these words outside the head."""
    answers = answers.sort_by([("kind", "ascending"), ("part", "ascending")])
    kind = answers.column("kind").to_numpy()
    values, keys = answers.column("values"), answers.column("keys")
    words, entries = (np.flatnonzero(kind == k).tolist() for k in (_WORD, _ENTRY))
    facts = Facts()
    if words:
        facts.words = np.unique(np.concatenate(rare))
        facts.counts = np.zeros(len(facts.words), np.int64)
        facts.counts[_by_part(facts.words, among)[0]] = np.concatenate([_read(values[i].as_buffer(), np.int64) for i in words])
    if entries:
        key = np.concatenate([np.cumsum(_read(keys[i].as_buffer(), np.int64)) for i in entries]).view(np.uint64)
        order = np.argsort(key)
        facts.entries, facts.mass = key[order], np.concatenate([_read(values[i].as_buffer(), np.float64) for i in entries])[order]
    return facts


def answered(parts: DataFrame, facts: DataFrame, top, among: int) -> DataFrame:
    """The rows of :func:`dealt` for texts as they are, and the sums in the tree of each batch's texts.

    A bin's facts come with its tokens. Its shards, each about SHARD_TOKENS tokens, are taken one
    after the other, and their sums by text added up.
    """
    columns = ["row", "doc_id", "n_tokens", "n_known", "base", "part"]
    ddl = ", ".join(f"{c} {type_of(parts, c)}" for c in columns) + ", places binary, sums binary, bases binary, knowns binary"
    schema = arrow_of(ddl)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held = top.value
        empty = pc.is_null(left.column("tokens"))
        texts = left.select(columns).filter(empty)
        blobs, shard, row = left.column("tokens"), left.column("shard").fill_null(-1).to_numpy(), left.column("row").to_numpy()
        facts = _facts([rare_of(b.as_buffer()) for b in blobs if b.is_valid], right, among)
        order = np.argsort(shard, kind="stable")[len(texts) :]  # blobs stay where they are
        added: list[tuple[np.ndarray, ...]] = []
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1)).tolist() if len(order) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = order[a:b]
            starts = row[own]
            read = [unpacked(blobs[i].as_buffer()) for i in own.tolist()]
            sizes = [len(x) for _, x in read]
            training = np.concatenate([x for _, x in read])
            t = Tokens(np.repeat(np.arange(len(starts)) << 32, sizes) | np.concatenate([t.doc for t, _ in read]), np.concatenate([t.code for t, _ in read]), [np.concatenate([t.before[k] for t, _ in read]) for k in range(DEPTH)])
            del read
            with np.errstate(over="ignore"):
                depth, _, mass, rest, _ = held.walked(t, facts)
                root = held.root(t.code, facts)
                mass, rest, _ = grown(t, training, depth, mass, rest, root)
            new = np.diff(t.doc, prepend=-1) != 0  # tokens of a text stand together
            doc, place = t.doc[new], np.cumsum(new) - 1
            rare = t.code >= _RARE
            sums = np.bincount(place, np.log10(np.maximum(mass + rest * root, 1e-300)), len(doc))
            bases = np.bincount(place, np.where(rare, np.log10(root), 0.0), len(doc))
            knowns = np.bincount(place, rare & (held.trained(t.code, facts) > 0), len(doc))
            added.append((starts[doc >> 32], doc & 0xFFFFFFFF, sums, bases, knowns))
            del t, training, depth, mass, rest, root, new, place, rare
        out = [pa.Table.from_arrays([*texts.columns, *(pa.nulls(len(texts), pa.binary()),) * 4], schema=schema)]
        if added:
            first, place, sums, bases, knowns = (np.concatenate(x) for x in zip(*added, strict=True))
            held_texts, at = np.unique(np.stack([first, place]), axis=1, return_inverse=True)
            at = at.reshape(-1)
            sums, bases, knowns = (np.bincount(at, x) for x in (sums, bases, knowns))
            rows, begun = np.unique(held_texts[0], return_index=True)
            spans = list(zip(begun.tolist(), [*begun[1:].tolist(), len(sums)], strict=True))
            shown = lambda x, kind: [zstandard.ZstdCompressor(level=3).compress(_planes(x[a:b].astype(kind))) if x[a:b].any() else None for a, b in spans]
            places = [zstandard.ZstdCompressor(level=3).compress(_planes(np.diff(held_texts[1, a:b], prepend=0).astype("<i4"))) for a, b in spans]
            batch = rows_out(schema, [rows, *([None] * len(rows),) * 5, places, shown(sums, "<f8"), shown(bases, "<f8"), shown(knowns, "<i4")])
            out.append(pa.Table.from_batches([batch]))
        return pa.concat_tables(out)

    return parts.groupBy("bin").cogroup(facts.groupBy("bin")).applyInArrow(run, ddl)


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums of one batch's texts over all bins."""
    each = [np.cumsum(_read(b, "<i4"), dtype=np.int64) for b in frame["places"]]
    places = np.concatenate(each)
    values = [np.concatenate([np.zeros(len(p)) if b is None else _read(b, kind) for p, b in zip(each, frame[c], strict=True)]) for c, kind in (("sums", "<f8"), ("bases", "<f8"), ("knowns", "<i4"))]
    more, base, known = (np.bincount(places, v) for v in values)
    held = np.unique(places)
    return pd.DataFrame({"row": frame["row"].iloc[0] + held, "more": more[held], "more_base": base[held], "more_known": known[held].astype(np.int64)})


def score_documents(docs: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every document.

    The tree is grown on the rows with ``usable`` (an expression over ``doc_id``). Null and empty
    texts are their end alone; repeated rows score alike; with nothing to learn from every token
    has probability 1, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    source = whole_texts(docs, id_col, text_col).withColumn("training", F.coalesce(usable, F.lit(False)))
    counts = scratch(word_counts(source), "words")
    top, entries = planted(source, counts)
    shipped = spark.sparkContext.broadcast(top)
    light = spark.sparkContext.broadcast(replace(top, words=range(len(top.words))))  # what is asked and answered needs no words
    size = source.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-size // (6 * SHARD_TOKENS)))
    bins = max(1, shards // SHARDS_A_TASK)
    parts = dealt(source, shipped, shards, bins).repartition(bins, "bin")  # one shuffle: what is asked and what is answered both read it
    among = 1
    if top.whole_words and top.whole_entries:
        facts = spark.createDataFrame([], "bin int, kind int, part int, keys binary, values binary")
    else:
        among = max(-(-(counts.count() + (entries.count() if entries is not None else 0)) // TOLD_A_PART), -(-bins // SHARDS_A_TASK))
        facts = told(asked(parts, light, among), counts, entries, among)
    found = scratch(answered(parts, facts, light, among), "scored")
    texts = found.filter("n_tokens is not null")
    inside = found.filter("places is not null").select("row", "places", "sums", "bases", "knowns").groupBy("row").applyInPandas(_merged, "row long, more double, more_base double, more_known long")
    some = lambda c: F.coalesce(c, F.lit(0))
    return texts.join(inside, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + some("more_known")).alias("n_known"), F.lit(top.total).cast("long").alias("train_tokens"), (F.col("base") + some("more_base")).alias("base_score"), (F.col("part") + some("more")).alias("score")
    )


def training_rows(id_col: str = "doc_id") -> Column:
    """Rows that the registered query may learn from; the rest is held out."""
    return id_fold(id_col, 7) != 2
