"""BPE encoding and decoding by a minimal acyclic transducer.

Frequent words are compiled, in sorted order, into an automaton whose equal right parts are
shared. Every arc carries the number of lexicon words that come before the ones it leads to;
the sum over a word's path is its rank, and the rank points at the word's ids. Tasks map the
compiled file into memory and look up all their new words at once; words outside the lexicon
are merged exactly, so the lexicon decides speed and never results.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WORDS, Merges, WordCache, segments
from .common import arrow_of, bounded, most_frequent, rows_out, scratch, type_of, whole_texts

LEXICON_WORDS = 40_000
#: A word enters the lexicon if some task meets it this often in one spelling of the text around it.
SEEN_IN_A_TASK = 4
_PARTS = ("keys", "targets", "outputs", "final", "starts", "ids")
_TYPES = ("<i8", "<i4", "<i4", "<i4", "<i4", "<i4")


def frequent_words(docs: DataFrame, size: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent BPE words of the texts, at most ``size``; no more rows reach the driver."""

    schema = arrow_of("word binary, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        words: Counter[bytes] = Counter()

        def drain() -> None:
            for segment, n in seen.items():
                if n < SEEN_IN_A_TASK:
                    continue
                for w in WORDS.findall(" " + segment):
                    words[w.encode()] += n
            seen.clear()

        def frequent() -> pa.RecordBatch:
            kept = [(w, n) for w, n in words.items() if n >= SEEN_IN_A_TASK]
            words.clear()
            return rows_out(schema, [[w for w, _ in kept], [n for _, n in kept]])

        for batch in bounded(batches):
            for text in batch.column("text").to_pylist():
                seen.update(segments(text)[1:])
            if len(seen) > 300_000:
                drain()
                if len(words) > 600_000:
                    yield frequent()
        drain()
        yield frequent()

    counted = whole_texts(docs).select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(w) for w in most_frequent(scratch(counted, "words"), size, "word")["word"]]


def compile_lexicon(words: list[bytes], merges: Merges) -> bytes:
    """The minimal acyclic transducer of ``words`` (any order, repeats ignored) as one relocatable file."""
    words = sorted({w for w in words if w})
    shared: dict[tuple, int] = {}
    below: list[int] = []  # words reachable from a state
    arcs_of: list[tuple] = []
    final_of: list[bool] = []

    def share(arcs: list[tuple[int, int]], final: bool) -> int:
        key = (final, *arcs)
        state = shared.get(key)
        if state is None:
            state = shared[key] = len(below)
            below.append(final + sum(below[t] for _, t in arcs))
            arcs_of.append(tuple(arcs))
            final_of.append(final)
        return state

    # the path of the last word: [arcs already shared, is it a word's end]; what leaves the path is shared
    path: list[list] = [[[], False]]
    last = b""
    for word in words:
        common = len(os.path.commonprefix([last, word]))
        for depth in range(len(last), common, -1):
            arcs, final = path.pop()
            path[-1][0].append((last[depth - 1], share(arcs, final)))
        path += [[[], False] for _ in range(len(word) - common)]
        path[-1][1], last = True, word
    for depth in range(len(last), 0, -1):
        arcs, final = path.pop()
        path[-1][0].append((last[depth - 1], share(arcs, final)))
    root = share(*path[0])

    # states are numbered from the root so that it is 0
    number = [(s - root) % len(below) for s in range(len(below))]
    rows = []
    for state, arcs in enumerate(arcs_of):
        rank = int(final_of[state])
        for byte, target in arcs:
            rows.append((number[state] << 8 | byte, number[target], rank))
            rank += below[target]
    rows.sort()
    final = np.zeros(len(below), "<i4")
    for state, is_final in enumerate(final_of):
        final[number[state]] = is_final
    ids = [merges.merge(w) for w in words]
    starts = np.cumsum([0, *map(len, ids)])
    keys, targets, outputs = (np.array(c) for c in zip(*rows, strict=True)) if rows else (np.zeros(0),) * 3
    columns = (keys, targets, outputs, final, starts, np.array([i for x in ids for i in x]))
    data = [np.ascontiguousarray(c, t).tobytes() for c, t in zip(columns, _TYPES, strict=True)]
    head = np.array([len(d) for d in data], "<i8").tobytes()
    return head + b"".join(data)


class Lexicon:
    """A compiled lexicon mapped into memory. The file is this process's own and has no name once it is mapped."""

    def __init__(self, compiled: bytes):
        with tempfile.NamedTemporaryFile(prefix="lexicon-") as f:
            f.write(compiled)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(self._map, "<i8", len(_PARTS))
        at = sizes.nbytes
        for name, kind, size in zip(_PARTS, _TYPES, sizes.tolist(), strict=True):
            setattr(self, name, np.frombuffer(self._map, kind, size // np.dtype(kind).itemsize, at))
            at += size

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word in the lexicon, -1 for the others: all words step through the automaton together."""
        found = np.full(len(words), -1, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        if not len(words) or not len(self.keys):
            return found
        flat = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(sizes) - sizes
        live = np.flatnonzero(sizes > 0)
        state, rank, depth = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), 0
        while len(live):
            key = state << 8 | flat[first[live] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[arc] == key
            live, arc, rank = live[on], arc[on], rank[on]
            state, rank, depth = self.targets[arc].astype(np.int64), rank + self.outputs[arc], depth + 1
            end = sizes[live] == depth
            whole = end & (self.final[state] > 0)
            found[live[whole]] = rank[whole]
            live, state, rank = live[~end], state[~end], rank[~end]
        return found

    def ids_of(self, rank: int) -> bytes:
        return self.ids[self.starts[rank] : self.starts[rank + 1]].tobytes()


_OPEN: dict[bytes, tuple] = {}


def opened(compiled: bytes, vocabulary: bytes) -> tuple[Lexicon, Merges, WordCache]:
    """The lexicon, merge table and word cache of this worker process, opened once."""
    key = hashlib.sha256(compiled + vocabulary).digest()
    if key not in _OPEN:
        lexicon, merges = Lexicon(compiled), Merges(vocabulary)

        def resolve(words: list[bytes]) -> list[bytes]:
            ranks = lexicon.ranks(words)
            out = [lexicon.ids_of(r) if r >= 0 else b"" for r in ranks.tolist()]
            unseen = np.flatnonzero(ranks < 0).tolist()
            for i, ids in zip(unseen, merges.merge_many([words[i] for i in unseen]), strict=True):
                out[i] = ids
            return out

        _OPEN.clear()
        _OPEN[key] = lexicon, merges, WordCache(resolve)
    return _OPEN[key]


def encode_texts(texts: list[str], cache: WordCache, merges: Merges) -> list[bytes]:
    """Ids (little-endian 32 bits each) of whole texts; strings of special tokens become their ids."""
    if not merges.specials:
        return cache.encode(texts)
    odd = {i for i, t in enumerate(texts) if merges.specials.search(t)}
    if not odd:
        return cache.encode(texts)
    plain = iter(cache.encode([t for i, t in enumerate(texts) if i not in odd]))
    out = []
    for i, text in enumerate(texts):
        if i not in odd:
            out.append(next(plain))
            continue
        parts = merges.specials.split(text)
        coded = iter(cache.encode(parts[::2]))
        out.append(b"".join(next(coded) if k % 2 == 0 else np.array([merges.special[p]], "<u4").tobytes() for k, p in enumerate(parts)))
    return out


def decode_ids(ids: bytes, merges: Merges) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(merges.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text", lexicon_size: int = LEXICON_WORDS, digest: bool = False) -> DataFrame:
    """(doc_id, ids binary) of every document, or with ``digest`` its counts and digests after a decode.

    Null text counts as empty and has no ids; repeated rows give repeated rows; a very long text
    is encoded whole in a slice of its own; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, "rb") as f:
        vocabulary = f.read()
    source = whole_texts(docs, id_col, text_col)
    compiled = compile_lexicon(frequent_words(source, lexicon_size), Merges(vocabulary))
    shipped = spark.sparkContext.broadcast((compiled, vocabulary))
    ddl = "doc_id {}, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id {}, ids binary"
    ddl = ddl.format(type_of(source, "doc_id"))
    schema = arrow_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, merges, cache = opened(*shipped.value)
        for batch in bounded(batches):
            coded = encode_texts(batch.column("text").to_pylist(), cache, merges)
            if not digest:
                yield rows_out(schema, [batch.column("doc_id"), coded])
                continue
            decoded = [decode_ids(x, merges).encode() for x in coded]
            yield rows_out(schema, [batch.column("doc_id"), [len(x) // 4 for x in coded], [hashlib.sha256(x).hexdigest() for x in coded], [hashlib.sha256(x).hexdigest() for x in decoded]])

    return source.mapInArrow(run, ddl)


def decode(coded: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, text) from the (doc_id, ids) rows of :func:`encode`; null ids give null text."""
    with open(vocabulary_path, "rb") as f:
        vocabulary = f.read()
    shipped = coded.sparkSession.sparkContext.broadcast(vocabulary)
    ddl = f"doc_id {type_of(coded, 'doc_id')}, text string"
    schema = arrow_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(shipped.value)
        for batch in bounded(batches, "ids"):
            yield rows_out(schema, [batch.column("doc_id"), [None if x is None else decode_ids(x, merges) for x in batch.column("ids").to_pylist()]])

    return coded.select("doc_id", "ids").mapInArrow(run, ddl)
