"""Cross-tokenizer alignment: token groups of two tokenizers over the same bytes, and how widely their pairs are linked.

A whole Arrow batch is one run of bytes: documents follow each other at known byte offsets. The
ends of both tokenizers' tokens are counted by offset once; where both end, the run is cut.
Prefix sums over the cuts give each token its group and, between the documents' offsets, each
document its numbers, so no step goes document by document.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Merges
from .common import arrow_of, bounded, most_frequent, rows_out, scratch, type_of
from .packing import encoder

#: Bytes of text that are aligned as one run; a longer text is a run of its own.
BYTES_A_RUN = 1_000_000
#: Links of a group up to which they are written out one by one; larger groups are taken by distinct ids.
LINKS_A_GROUP = 4096
#: Most frequent pairs whose counts every task holds (speed only, never results): the others are joined.
HEAD_PAIRS = 250_000
#: Distinct pairs that a task gathers before it hands its counts on.
PAIRS_AT_ONCE = 1_000_000
#: A pair of ids as one number: the A id in the higher bits.
SHIFT = 32
_MASK = (1 << SHIFT) - 1


class Tokenizers:
    """Both tokenizers with the bytes of every id; strings of special tokens are plain text to them."""

    def __init__(self, vocabulary: str | bytes, pieces: bytes):
        spec = json.loads(vocabulary)
        for special in spec["added_tokens"]:
            spec["model"]["vocab"].pop(special["content"], None)
        spec["added_tokens"] = []
        plain = json.dumps(spec)
        self.encode_a = encoder(plain)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.bytes_a = Merges(plain).bytes_of
        marks = ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in marks]
        self.sizes_a, self.sizes_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.said = {end: np.array([b"%d%s" % (i, end) for i in range(max(len(self.bytes_a), len(self.bytes_b)))], object) for end in (b",", b"|", b";")}

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text by both, of none where the joined bytes of either differ from space and text."""
        a = [np.array(self.encode_a(" " + t), np.int64) for t in texts]
        b = [np.array(ids, np.int64) for ids in self.b.encode(texts, num_threads=1)]
        none = np.zeros(0, np.int64)
        for i, t in enumerate(texts):
            want = b" " + t.encode()
            if not t or any(b"".join(map(own.__getitem__, ids.tolist())) != want for own, ids in ((self.bytes_a, a[i]), (self.bytes_b, b[i]))):
                a[i] = b[i] = none
        return a, b


@dataclass
class Run:
    """A batch aligned: per document numbers, and the distinct linked pairs of all documents, ordered by document and pair."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    pair_ends: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


def _before(values: np.ndarray) -> np.ndarray:
    """Sums of all values before each place, and of all."""
    return np.concatenate(([0], np.cumsum(values)))


def align_run(tokens: Tokenizers, texts: list[str], links_a_group: int = LINKS_A_GROUP) -> Run:
    """All texts of a batch at once."""
    ids = tokens.encode(texts)
    n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in ids)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in ids)
    ends_a, ends_b = np.cumsum(tokens.sizes_a[a]), np.cumsum(tokens.sizes_b[b])
    # documents without tokens have no bytes in the run
    doc_ends = _before(tokens.sizes_a[a])[np.cumsum(n_a)]
    total = int(ends_a[-1]) if len(a) else 0
    both = (np.bincount(ends_a, minlength=total + 1) > 0) & (np.bincount(ends_b, minlength=total + 1) > 0)
    cuts = np.cumsum(both)
    group_a, group_b = cuts[ends_a - 1], cuts[ends_b - 1]
    groups = int(cuts[-1])
    in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    first_a, first_b = _before(in_a), _before(in_b)
    links = in_a * in_b
    group_ends = cuts[doc_ends]
    of_docs = lambda sums: np.diff(sums[group_ends], prepend=0)

    said = np.empty(len(a) + len(b), object)
    for own, at, place, end in ((a, group_a, np.arange(len(a)) + first_b[group_a], b"|"), (b, group_b, np.arange(len(b)) + first_a[group_b + 1], b";")):
        last = np.diff(at, append=groups) > 0
        said[place[last]] = tokens.said[end][own[last]]
        said[place[~last]] = tokens.said[b","][own[~last]]
    text_ends = np.cumsum(n_a + n_b).tolist()
    written = [b"".join(said[start:end].tolist())[:-1] for start, end in zip([0, *text_ends], text_ends, strict=False)]

    small = links <= links_a_group
    often = np.where(small[group_a], in_b[group_a], 0)
    one = np.repeat(np.arange(len(a)), often)
    other = first_b[group_a[one]] + np.arange(len(one)) - np.repeat(np.cumsum(often) - often, often)
    doc_of_group = np.repeat(np.arange(len(texts)), np.diff(group_ends, prepend=0))
    keys, pair = [doc_of_group[group_a[one]]], [a[one] << SHIFT | b[other]]
    counted = [np.ones(len(one), np.int64)]
    for g in np.flatnonzero(~small).tolist():
        own_a, times_a = np.unique(a[first_a[g] : first_a[g + 1]], return_counts=True)
        own_b, times_b = np.unique(b[first_b[g] : first_b[g + 1]], return_counts=True)
        pair.append((own_a[:, None] << SHIFT | own_b).ravel())
        counted.append((times_a[:, None] * times_b).ravel())
        keys.append(np.full(len(pair[-1]), doc_of_group[g]))
    doc, pair, n = np.concatenate(keys), np.concatenate(pair), np.concatenate(counted)
    order = np.lexsort((pair, doc))
    doc, pair, n = doc[order], pair[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(pair) != 0)))) if len(doc) else np.zeros(0, np.int64)
    times = np.add.reduceat(n, new) if len(new) else n
    pair_ends = np.cumsum(np.bincount(doc[new], minlength=len(texts)))
    return Run(n_a, n_b, of_docs(np.arange(groups + 1)), of_docs(_before(links)), written, pair_ends, pair[new], times)


def align(docs: DataFrame, vocabulary_path: str, pieces_path: str, *, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row a row: uid, doc_id, n_a, n_b, n_groups, n_links, groups, and its distinct linked pairs as lists a, b, times.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``, with ``digest`` its sha256, and empty where there are no
    tokens: null and empty texts, and texts that a tokenizer doesn't give back as they are.
    ``uid`` numbers rows; ids may be null or repeat. A task holds one run of texts, or one longer
    text, with its tokens and distinct pairs.
    """
    source = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    with open(vocabulary_path, "rb") as v, open(pieces_path, "rb") as p:
        shipped = docs.sparkSession.sparkContext.broadcast((v.read(), p.read()))
    ddl = f"uid long, doc_id {type_of(source, 'doc_id')}, n_a long, n_b long, n_groups long, n_links long, groups string, a array<int>, b array<int>, times array<int>"
    schema = arrow_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokenizers(*shipped.value)
        for batch in bounded(batches, limit=BYTES_A_RUN):
            found = align_run(tokens, batch.column("text").to_pylist())
            groups = [(hashlib.sha256(g).hexdigest() if digest else g.decode()) if g else "" for g in found.groups]
            ends = pa.array(np.concatenate(([0], found.pair_ends)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (found.pairs >> SHIFT, found.pairs & _MASK, found.times)]
            yield rows_out(schema, [batch.column("uid"), batch.column("doc_id"), found.n_a, found.n_b, found.n_groups, found.n_links, groups, *lists])

    return source.mapInArrow(run, ddl)


def _pairs(batch: pa.RecordBatch) -> np.ndarray:
    a, b = (pc.list_flatten(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b"))
    return a << SHIFT | b


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): in how many rows each pair is linked; tasks sum up before they hand pairs on."""
    schema = arrow_of("pair long, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            pair, n = (np.concatenate(x) for x in zip(*held, strict=True))
            own, at = np.unique(pair, return_inverse=True)
            out = np.zeros(len(own), np.int64)
            np.add.at(out, at, n)
            return own, out

        for batch in batches:
            held.append(np.unique(_pairs(batch), return_counts=True))
            size += len(held[-1][0])
            if size > 2 * PAIRS_AT_ONCE:
                held = [summed()]
                size = len(held[0][0])
                if size > PAIRS_AT_ONCE:
                    yield rows_out(schema, held[0])
                    held, size = [], 0
        if held:
            yield rows_out(schema, summed())

    return aligned.select("a", "b").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def linked(docs: DataFrame, vocabulary_path: str, pieces_path: str, *, id_col: str = "doc_id", text_col: str = "text", head_pairs: int = HEAD_PAIRS, digest: bool = False) -> DataFrame:
    """One row a row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``n_best`` counts links whose pair is linked in as many rows as any pair of its A id, ties
    included; ``count_sum`` adds up those numbers of rows over the row's links. All rows count,
    repeated ones too. Counts of the most frequent pairs are held by every task, so a pair that
    nearly every document has is never shuffled by itself; the others are joined by pair.
    """
    aligned = scratch(align(docs, vocabulary_path, pieces_path, id_col=id_col, text_col=text_col, digest=digest), "aligned")
    counts = scratch(pair_counts(aligned), "pairs")
    best = counts.groupBy(F.shiftright("pair", SHIFT).alias("a")).agg(F.max("n").alias("most"))  # a row for each A id at most
    most = np.zeros(1 << 17, np.int64)
    for r in best.toPandas().itertuples():
        if r.a >= len(most):
            most = np.concatenate((most, np.zeros(r.a + 1, np.int64)))
        most[r.a] = r.most
    head = most_frequent(counts, head_pairs, "pair").sort_values("pair")
    held = docs.sparkSession.sparkContext.broadcast((head["pair"].to_numpy(np.int64), head["n"].to_numpy(np.int64), most))
    kept = [c for c in aligned.columns if c not in ("a", "b", "times")]
    ddl = ", ".join(f"{c} {type_of(aligned, c)}" for c in kept) + ", n_best long, count_sum long"
    schema, tail_schema = arrow_of(ddl), arrow_of("uid long, pair long, times long")

    def known(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs with their times, number of rows (0 if not held) and row ends."""
        pairs, (own, n, _) = _pairs(batch), held.value
        at = np.minimum(np.searchsorted(own, pairs), max(0, len(own) - 1))
        found = np.where(own[at] == pairs, n[at], 0) if len(own) else np.zeros(len(pairs), np.int64)
        return pairs, pc.list_flatten(batch.column("times")).to_numpy(zero_copy_only=False).astype(np.int64), found, np.cumsum(pc.list_value_length(batch.column("a")).to_numpy(zero_copy_only=False).astype(np.int64))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times, n, ends = known(batch)
            n_best, count_sum = (np.diff(_before(x)[ends], prepend=0) for x in (np.where((n > 0) & (n == held.value[2][pairs >> SHIFT]), times, 0), times * n))
            yield rows_out(schema, [*(batch.column(c) for c in kept), n_best, count_sum])

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times, n, ends = known(batch)
            uid = np.repeat(batch.column("uid").to_numpy(), np.diff(ends, prepend=0))
            lacking = n == 0
            yield rows_out(tail_schema, [uid[lacking], pairs[lacking], times[lacking]])

    rest = aligned.select("uid", "a", "b", "times").mapInArrow(tails, "uid long, pair long, times long").join(counts, "pair")
    rest = rest.join(F.broadcast(best), F.shiftright("pair", SHIFT) == best["a"])  # as many rows as the vocabulary has ids at most
    summed = rest.groupBy("uid").agg(F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("tail_best"), F.sum(F.col("times") * F.col("n")).alias("tail_sum"))
    found = aligned.mapInArrow(heads, ddl).join(summed, "uid", "left")
    add = lambda own, tail: (F.col(own) + F.coalesce(F.col(tail), F.lit(0))).alias(own)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", add("n_best", "tail_best"), add("count_sum", "tail_sum"), "groups")
