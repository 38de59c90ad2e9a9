"""Sequence packing: best-fit decreasing over token pieces.

Documents become token ids with a closing id, overlong ones are first cut into full windows,
and what remains is placed, longest first, into the tightest open window that still takes it.
Open windows are found by their remaining capacity in a segment tree.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .bpe import WORDS, Merges
from .common import arrow_of, bounded, rows_out, scratch, type_of, whole_texts

WINDOW = 2048
END_ID = 1
#: Pieces that one best-fit run holds at a time.
PIECES_AT_ONCE = 100_000
#: Texts longer than this are looked through for runs of half as many characters, which are merged apart (speed
#: and safety only, never ids).
LONG_RUN = 20_000

_SPACES = re.compile(r"\s\s+")


class CapacityTree:
    """Which remaining capacities have an open window, as a segment tree over 0..``most``.

    Every node tells whether its range has one; a query goes up from its leaf to the first
    right-hand range that has one, then down to that range's least capacity.
    """

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.filled = bytearray(2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        node = self.leaves + capacity
        while node and not self.filled[node]:
            self.filled[node] = 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest open window with room for ``size``, removed from the tree."""
        node, filled = self.leaves + size, self.filled
        while not filled[node]:
            while node & 1:  # a right child: nothing further right below its parent
                node >>= 1
            if node == 0:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if filled[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        window = self.windows[capacity].pop()
        if not self.windows[capacity]:
            filled[node] = 0
            while (node := node >> 1) and not (filled[2 * node] or filled[2 * node + 1]):
                filled[node] = 0
        return capacity, window


def best_fit(sizes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each piece of 1 to ``window`` tokens, placed longest first (ties: as given)."""
    tree, placed, offsets, opened = CapacityTree(window), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for i in np.argsort(-np.asarray(sizes), kind="stable").tolist():
        size = int(sizes[i])
        found = tree.take(size)
        if found is None:
            found, opened = (window, opened), opened + 1
        room, placed[i] = found
        offsets[i] = window - room
        if room > size:
            tree.add(room - size, int(placed[i]))
    return placed, offsets


def encoder(vocabulary: str | bytes) -> Callable[[str], list[int]]:
    """Ids of a whole text as the tokenizer of this vocabulary file gives them.

    The file's merges are in the order of their ids, so its byte strings by id are the ranks of
    an equal and several times faster encoder; strings of special tokens become their ids.
    """
    merges = Merges(vocabulary)
    special = merges.special
    ranks = {b: i for i, b in enumerate(merges.bytes_of) if b and i not in special.values()}
    joined = [j for _, j in sorted(merges.rank.values())]
    if joined != sorted(joined):
        raise ValueError("the vocabulary's ids don't follow its merges")
    coder = tiktoken.Encoding("pieces", pat_str=WORDS.pattern, mergeable_ranks=ranks, special_tokens=special)

    def by_words(text: str) -> list[int]:
        """Long runs overflow the fast encoder's stack, so words are found here and long ones merged here."""
        out: list[int] = []
        for part in merges.specials.split(text) if merges.specials else [text]:
            if part in special:
                out.append(special[part])
                continue
            for word in WORDS.findall(part):
                out += merges.merge(word.encode("utf-8", "replace")) if len(word) > LONG_RUN // 2 else coder.encode_ordinary(word)
        return out

    def encode(text: str) -> list[int]:
        if len(text) > LONG_RUN and (max(map(len, text.split()), default=0) > LONG_RUN // 2 or max(map(len, _SPACES.findall(text)), default=0) > LONG_RUN // 2):
            return by_words(text)
        return coder.encode(text, allowed_special="all") if any(s in text for s in special) else coder.encode_ordinary(text)

    return encode


def token_pieces(docs: DataFrame, vocabulary_path: str, *, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``window`` tokens: doc_id, start, length, ids_crc32, doc_tokens.

    A document is its ids followed by ``end_id``; null text counts as empty and has that id
    alone. Full windows come first, then what is left.
    """
    source = whole_texts(docs, id_col, text_col)
    with open(vocabulary_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    ddl = f"doc_id {type_of(source, 'doc_id')}, start long, length long, ids_crc32 long, doc_tokens long"
    schema = arrow_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(shipped.value), np.array([end_id], "<u4").tobytes()
        for batch in bounded(batches):
            columns = ([], [], [], [], [])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                coded = np.array(encode(text), "<u4").tobytes() + last
                total = len(coded) // 4
                for start in range(0, total, window):
                    piece = coded[4 * start : 4 * (start + window)]
                    for column, value in zip(columns, (doc_id, start, len(piece) // 4, zlib.crc32(piece), total), strict=True):
                        column.append(value)
            yield rows_out(schema, columns)

    return source.mapInArrow(run, ddl)


def place(pieces: DataFrame, *, window: int = WINDOW, at_once: int = PIECES_AT_ONCE) -> DataFrame:
    """``pieces`` with sequence_id and offset; no pieces give no rows, and pieces of equal length go as they come.

    Pieces are dealt evenly into blocks of at most about ``at_once`` and each block is packed by
    itself, so no task holds more than one block and a block wastes at most its last few windows.
    Blocks are packed where they lie after one shuffle of these narrow rows; texts never move.
    """
    blocks = max(1, math.ceil(pieces.count() / at_once))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    schema = arrow_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, held, n = TaskContext.get().partitionId() << 40, [], 0

        def packed() -> pa.RecordBatch:
            nonlocal first
            block = pa.Table.from_batches(held).combine_chunks()
            placed, offsets = best_fit(block.column("length").to_numpy(), window)
            columns = [c.combine_chunks() for c in block.columns]
            out = rows_out(schema, [*columns, placed + first, offsets])
            first += int(placed.max()) + 1
            held.clear()
            return out

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
                if n >= 2 * at_once:
                    yield packed()
                    n = 0
        if held:
            yield packed()

    return pieces.repartition(blocks).mapInArrow(run, ddl)


def pack(docs: DataFrame, vocabulary_path: str, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents packed into sequences of at most ``window`` tokens, one row a piece.

    Null and empty texts are packed as their closing id; repeated rows are packed as often as
    they occur; a very long text is cut into full windows; an empty table gives no rows.
    """
    return place(scratch(token_pieces(docs, vocabulary_path, window=window, id_col=id_col, text_col=text_col), "pieces"), window=window)
