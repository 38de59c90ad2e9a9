"""Near-duplicate classes by ProbMinHash.

Each text becomes its distinct five-word shingles, weighted by how often they occur. A shingle's
points arrive as a Poisson process with its weight as rate, each point falls into a random register,
a register keeps the earliest shingle, and a shingle stops as soon as its next point comes after
every register's. Two texts agree in a register with their probability Jaccard similarity. The same
draws at equal rates give registers that agree with the Jaccard similarity of the sets; for a text
whose shingles all occur equally often, both are the same registers. Texts are linked if either
measure is high enough, so a copy that repeats a line a hundred times, and one that differs only
in what is rare in it, both meet their originals. Registers are banded into buckets, with one key
for each measure where they differ; pairs of a bucket whose registers agree often enough in either
measure are compared exactly on their texts, and linked texts form classes.

Only distinct texts are compared. A bucket's members are compared with its hub, the member that
shares most buckets with others; texts of one class are not compared again. What is then left of
a bucket with several classes is compared across classes: pair by pair in small buckets, in cells
of bounded size in large ones, which compare the same pairs. So buckets have no cap, their size
changes no result, and no link between classes is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_of, bounded, discard, rows_out, scratch, type_of, whole_texts

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
#: Buckets up to this size compare what is left of them pair by pair; larger ones, taken together where they overlap,
#: in cells of so many texts a side and about so many shingles, first with so many of their most shared texts.
SMALL_BUCKET, CELL, CELL_SHINGLES, HUBS = 48, 128, 400_000, 64
#: A bucket of over HOT_BUCKET rows and over one in HOT_SHARE of all is dealt over SALTS tasks.
HOT_BUCKET, HOT_SHARE, SALTS = 512, 10_000, 32
WORDS_HELD = 500_000

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0x100000001B3)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, computed once each and dropped at a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_hashes(texts: list[bytes], held: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every shingle, in order. A text of one to four words is one shingle; a text without words has none."""
    words = [t.split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.concatenate([np.fromiter(map(held.__getitem__, w), np.uint64, len(w)) for w in words]) if len(words) else np.zeros(0, np.uint64)
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(words)), sizes)
    lead = np.flatnonzero(np.arange(len(flat)) - first[doc] <= np.maximum(sizes[doc] - SHINGLE, 0)) if len(flat) else np.zeros(0, np.int64)
    out = np.zeros(len(lead), np.uint64)
    for k in range(SHINGLE):
        inside = lead + k < (first + sizes)[doc[lead]]
        word = flat[np.minimum(lead + k, max(0, len(flat) - 1))]
        out = np.where(inside, mixed((out ^ word) * _FOLD + _STEP), out)
    return doc[lead], out


def weighted(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their counts."""
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashes[at], np.diff(np.append(at, len(doc)))


def probminhash(doc: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """The registers of each text (n_docs x registers): all shingles of all texts take their next arrival together."""
    earliest = np.full(n_docs * registers, np.inf)
    kept = np.zeros(n_docs * registers, np.uint64)
    time, rate, turn = np.zeros(len(doc)), weights.astype(float), np.uint64(0)
    with np.errstate(over="ignore"):
        while len(doc):
            turn += np.uint64(1)
            draw = mixed(hashes + turn * _STEP)
            time = time - np.log((((draw >> np.uint64(11)).astype(float)) + 0.5) / 2.0**53) / rate
            slot = doc * registers + (mixed(draw ^ _MIX1) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(earliest, slot, time)
            won = time == earliest[slot]
            kept[slot[won]] = hashes[won]
            latest = earliest.reshape(n_docs, registers).max(1)
            live = time <= latest[doc]
            doc, hashes, time, rate = doc[live], hashes[live], time[live], rate[live]
    return kept.reshape(n_docs, registers)


def band_keys(registers: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key a band: the low 16 bits of its four registers side by side, so that keys also tell which
    registers of two texts agree."""
    lanes = (registers & np.uint64(0xFFFF)).astype(np.uint16)
    return lanes.reshape(len(registers), bands * ROWS).view(np.int64)


def uneven(doc: np.ndarray, weights: np.ndarray, n_docs: int) -> np.ndarray:
    """Texts whose shingles don't all occur equally often."""
    low, high = np.full(n_docs, np.iinfo(np.int64).max), np.zeros(n_docs, np.int64)
    np.minimum.at(low, doc, weights)
    np.maximum.at(high, doc, weights)
    return low < high


def probability_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two weight vectors: the sum over what both have of 1 / sum of max(x_j / x_i, y_j / y_i), which register agreement
    estimates. With places ordered by x / y, the inner sums are sums over what lies on either side."""
    order = np.argsort(np.where(y > 0, x / np.maximum(y, 1e-300), np.inf), kind="stable")
    x, y = x[order].astype(float), y[order].astype(float)
    above = np.cumsum(x[::-1])[::-1]  # of x_j, from each place on
    below = np.cumsum(y) - y
    both = (x > 0) & (y > 0)
    return float((1 / (above[both] / x[both] + below[both] / y[both])).sum())


Shingled = tuple[np.ndarray, np.ndarray]


def shingled(text: str, held: WordHashes) -> Shingled:
    """(sorted hashes, counts) of a text's distinct shingles."""
    doc, hashes, counts = weighted(*shingle_hashes([text.encode("utf-8", "replace")], held))
    return hashes, counts


def similar(one: Shingled, other: Shingled, similarity: float) -> bool:
    """Whether two texts' shingles are that similar as sets, or by their probability Jaccard similarity."""
    (h, n), (g, m) = one, other
    common = len(np.intersect1d(h, g, assume_unique=True))
    if not common:
        return False
    if common >= similarity * (len(h) + len(g) - common):
        return True
    if n.min() == n.max() and m.min() == m.max():  # the measures are the same
        return False
    every = np.union1d(h, g)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, h)], y[np.searchsorted(every, g)] = n, m
    return probability_jaccard(x, y) >= similarity - 1e-12


def least_agreeing(similarity: float, registers: int) -> int:
    """Registers that agree for texts at ``similarity`` but in about one pair of ten thousand million."""
    return max(1, math.floor(registers * similarity - 6.5 * math.sqrt(registers * similarity * (1 - similarity))))


def agreeing(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many registers agree, from two arrays (... x bands) of band keys."""
    return (np.ascontiguousarray(one).view(np.uint16) == np.ascontiguousarray(other).view(np.uint16)).sum(-1)


def node_of(kind: str = "bigint", id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A row's id as a number. An id that is no whole number, and the text of a row without an id, are
    made into a number below all ids."""
    made = lambda c: -F.abs(F.xxhash64(c) % (1 << 61)) - (1 << 62)
    own = F.col(id_col)
    number = own.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else made(own.cast("string"))
    return F.when(own.isNull(), made(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).otherwise(number)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(nid, h, text): a row's id as a number, a hash of its text, the text."""
    source = whole_texts(docs, id_col, text_col)
    return source.select(node_of(type_of(source, "doc_id")).alias("nid"), F.xxhash64("text").alias("h"), "text")


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS) -> DataFrame:
    """(row, nid, h, text_key, n, bands, weighted) of every row: a number for the row, its id, a hash and 128 bits of its
    text, distinct shingles (negative if some occur more often than others), band keys at equal weights, and by counts
    where those differ."""
    ddl = "row long, nid long, h long, text_key binary, n int, bands array<long>, weighted array<long>"
    schema = arrow_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, row = WordHashes(), TaskContext.get().partitionId() << 40
        for batch in bounded(batches, limit=2_000_000):
            texts = [t.encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            with np.errstate(over="ignore"):
                doc, hashes, counts = weighted(*shingle_hashes(texts, held))
                keys = band_keys(probminhash(doc, hashes, np.ones(len(doc)), len(texts), bands * ROWS), bands)
                differ = uneven(doc, counts, len(texts))
                own, place = differ[doc], np.cumsum(differ) - 1
                more = band_keys(probminhash(place[doc[own]], hashes[own], counts[own], int(differ.sum()), bands * ROWS), bands)
            n = np.bincount(doc, minlength=len(texts))
            texts_keys = [xxhash.xxh3_128_digest(t) for t in texts]
            by_count = [more[k] if d else [] for k, d in zip(place.tolist(), differ.tolist(), strict=True)]
            yield rows_out(schema, [np.arange(row, row + len(texts)), batch.column("nid"), batch.column("h"), texts_keys, np.where(differ, -n, n), [k if m else [] for k, m in zip(keys, n.tolist(), strict=True)], by_count])
            row += len(texts)

    return numbered(docs, id_col, text_col).mapInArrow(run, ddl)


def _pairs(left, right) -> list:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _may_reach(n, m, similarity: float):
    """Sets of such sizes can be as similar as that; where shingles occur unequally often, sizes tell nothing."""
    return (n < 0) | (m < 0) | (F.least(n, m) >= similarity * F.greatest(n, m))


def _registers(batch: pa.RecordBatch, side: str) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (rows x bands) at equal weights and by counts, from list columns."""
    bands, by_count = batch.column(f"bands{side}"), batch.column(f"weighted{side}")
    even = bands.flatten().to_numpy().reshape(batch.num_rows, -1)
    own = pc.list_value_length(by_count).to_numpy(zero_copy_only=False) > 0
    out = even.copy()
    if own.any():
        out[own] = by_count.flatten().to_numpy().reshape(int(own.sum()), -1)
    return even, out


def likely(pairs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The (a, b) rows of ``pairs`` whose registers, from (nid, bands, weighted), agree often enough for that similarity in
    one of both measures."""
    left, right = (nodes.select(F.col("nid").alias(c), F.col("bands").alias(f"bands_{c}"), F.col("weighted").alias(f"weighted_{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, other = _registers(batch, "_a"), _registers(batch, "_b")
                found = np.maximum(agreeing(one[0], other[0]), agreeing(one[1], other[1]))
                yield batch.select(["a", "b"]).filter(pa.array(found >= least_agreeing(similarity, one[0].shape[1] * ROWS)))

    return pairs.join(right, "b").join(left, "a").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The (a, b) rows of ``pairs`` whose texts, from (nid, text), are :func:`similar`."""
    left, right = (texts.select(F.col("nid").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    ddl = "a long, b long"
    schema = arrow_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, own = WordHashes(), None, None
        with np.errstate(over="ignore"):
            for batch in bounded(batches, "text_a"):
                found = []
                for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                    if own is None or last != a:
                        last, own = a, shingled(x, held)
                    if similar(own, shingled(y, held), similarity):
                        found.append((a, b))
                yield rows_out(schema, [[a for a, _ in found], [b for _, b in found]])

    return pairs.join(right, "b").select("a", "b", "text_b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, ddl)


def _chased(labels: DataFrame) -> DataFrame:
    """``labels`` (nid, label), whose labels are nodes themselves, with every chain of labels followed to its end."""
    while True:
        ends = labels.select(F.col("nid").alias("label"), F.col("label").alias("next"))
        stepped = scratch(labels.join(ends, "label").select("nid", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")), "labels")
        discard(labels)
        labels = stepped
        if stepped.filter("moved").isEmpty():
            return labels


def components(links: DataFrame) -> DataFrame:
    """(nid, label) of every linked node: the least id of its component.

    Each node points at its least neighbour, or itself if that is less; chains of pointers are
    followed to their ends, which stand for their nodes from then on, and links inside one are
    dropped. At most half the nodes are such ends, so there are few rounds and each is smaller.
    """
    edges = scratch(links.filter("a <> b").select(*_pairs(F.col("a"), F.col("b"))).distinct(), "links")
    labels = None
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        hooked = _chased(scratch(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("nid"), F.least("a", "m").alias("label")), "labels"))
        before, last = labels, edges
        labels = scratch(hooked.select("nid", "label") if labels is None else _renamed(labels, hooked), "labels")
        edges = scratch(_lifted(edges, hooked), "links")
        discard(hooked, last, *([before] if before is not None else []))
        if edges.isEmpty():
            return labels


def _renamed(labels: DataFrame, over: DataFrame) -> DataFrame:
    """``labels`` with the labels that ``over`` (nid, label) names replaced."""
    return labels.join(over.select(F.col("nid").alias("label"), F.col("label").alias("next")), "label", "left").select("nid", F.coalesce("next", "label").alias("label"))


def _lifted(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The distinct links between labels that (a, b) links make; nodes without a label stand for themselves."""
    ends = [labels.select(F.col("nid").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab"]
    over = links.join(ends[0], "a", "left").join(ends[1], "b", "left")
    x, y = (F.coalesce(f"label_{c}", c) for c in "ab")
    return over.filter(x != y).select(*_pairs(x, y)).distinct()


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels of :func:`components` after more links; only links between labels are gone through."""
    more = components(_lifted(links, labels))
    new = more.join(labels.select("nid"), "nid", "left_anti")
    found = scratch(_renamed(labels, more).unionByName(new), "labels")
    discard(labels, more)
    return found


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(nid, class_id) of every row: the least id of the texts linked to its text, itself if there are none.

    Texts are linked if they are equal or share ``similarity`` of their distinct five-word
    shingles (white-space words as they are), or if the probability Jaccard similarity of their
    shingles' counts is that high. Texts of one to four words are one shingle; texts
    without words, null ones among them, are only copies of equal texts. Rows without an id, or
    with one that is no whole number, get a number below all ids. Where one id stands over several
    texts, each of these counts by itself and speaks for its class under a number made from it.
    Repeated rows give repeated results, ties go to the least id, and an empty table gives no rows.
    """
    return _members(docs, id_col, text_col, similarity).select("nid", "class_id")


def _members(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(nid, h, class_id, first) of every row; ``first`` marks the rows of the text and id that stand for a class."""
    signed = scratch(signatures(docs, id_col=id_col, text_col=text_col), "signatures")
    texts_of = _nodes(signed)
    single = signed.join(texts_of.select("row", "node"), "row").select(F.col("node").alias("nid"), F.col("nid").alias("own"), "h", "n", "bands", "weighted")
    nodes = scratch(single, "nodes")
    labels = _linked(nodes, numbered(docs, id_col, text_col), similarity)
    discard(nodes)
    member = signed.select("nid", "h", "text_key").join(texts_of.select("text_key", "node", "rep"), "text_key").select("nid", "h", "node", "rep")
    label = F.coalesce("label", "node")
    return member.join(labels.select(F.col("nid").alias("node"), "label"), "node", "left").select("nid", "h", label.alias("class_id"), ((F.col("node") == label) & (F.col("nid") == F.col("rep"))).alias("first"))


def _nodes(signed: DataFrame) -> DataFrame:
    """(text_key, rep, row, node) of every distinct text: its least id, one of its rows, and the number it is compared
    under: that id, or one made from the text where several texts have the same."""
    texts = scratch(signed.groupBy("text_key").agg(F.min("nid").alias("rep"), F.min("row").alias("row")), "distinct")
    clashing = texts.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("rep", F.lit(True).alias("clashes"))
    if clashing.isEmpty():
        return texts.withColumn("node", F.col("rep"))
    made = -F.abs(F.xxhash64("text_key") % (1 << 61)) - (1 << 62)
    return scratch(texts.join(clashing, "rep", "left").select("text_key", "rep", "row", F.when(F.col("clashes"), made).otherwise(F.col("rep")).alias("node")), "distinct")


def _salted(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """``rows`` joined with ``heads`` (bucket, salts, …) by bucket; a bucket with several salts is dealt over as many tasks."""
    return rows.join(heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))), ["bucket", "salt"])


def _held(nodes: DataFrame) -> DataFrame:
    """(bucket, salt, nid, n, size, salts) of every bucket that several texts share.

    Buckets that hold more than one in HOT_SHARE of all rows, of which there can't be more than that
    many, are known to all tasks, so that their rows are dealt over SALTS tasks.
    """
    keys = lambda c: F.transform(c, lambda key, band: F.xxhash64(band, key))
    rows = nodes.select("nid", "n", F.explode(F.array_distinct(F.concat(keys("bands"), keys("weighted")))).alias("bucket")).select("bucket", "nid", "n")
    sizes = scratch(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
    total = nodes.agg(F.sum(F.size("bands") + F.size("weighted"))).first()[0] or 0
    salts = F.when(F.col("size") > max(HOT_BUCKET, total // HOT_SHARE), SALTS).otherwise(1)
    heads = sizes.withColumn("salts", salts)
    hot = F.broadcast(heads.filter("salts > 1").select("bucket", F.lit(True).alias("hot")))
    dealt = rows.join(hot, "bucket", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("nid"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    return scratch(_salted(dealt, heads), "buckets")


def _linked(nodes: DataFrame, source: DataFrame, similarity: float) -> DataFrame:
    """(nid, label) of the ``nodes`` (nid, own, h, n, bands) that have a link; texts come from ``source`` (nid, h, text)."""
    held = _held(nodes)
    popular = scratch(held.groupBy("nid").agg(F.sum("size").alias("pop")), "popular")
    hubs = held.join(popular, "nid").groupBy("bucket", "salts").agg(F.max(F.struct("pop", (-F.col("nid")).alias("minus"), "n")).alias("hub"))
    own, hub = F.col("nid"), -F.col("hub.minus")
    first = _salted(held.drop("salts"), hubs).filter((own != hub) & _may_reach(F.col("n"), F.col("hub.n"), similarity))
    tested = scratch(first.select(*_pairs(own, hub)).distinct(), "pairs")
    wanted = nodes.join(popular.select("nid"), "nid", "left_semi").select(F.col("nid").alias("node"), F.col("own").alias("nid"), "h")
    texts = scratch(source.join(wanted.hint("shuffle_hash"), ["nid", "h"]).dropDuplicates(["nid", "h", "node"]).select(F.col("node").alias("nid"), "text"), "texts")
    links = lambda pairs: scratch(verified(scratch(likely(pairs, nodes, similarity), "likely"), texts, similarity), "verified")
    labels = components(links(tested))
    few = _open_rows(held.filter(F.col("size") <= SMALL_BUCKET), labels)
    other = few.select("bucket", F.col("nid").alias("nid2"), F.col("n").alias("n2"), F.col("label").alias("label2"))
    crossing = (F.col("nid") < F.col("nid2")) & (F.col("label") != F.col("label2")) & _may_reach(F.col("n"), F.col("n2"), similarity)
    left = few.join(other, "bucket").filter(crossing).select(*_pairs(F.col("nid"), F.col("nid2"))).distinct().join(tested, ["a", "b"], "left_anti")
    labels = extended(labels, links(left))
    big = held.filter(F.col("size") > SMALL_BUCKET)
    if not big.isEmpty():
        labels = _joined_groups(_open_rows(big, labels), labels, popular, nodes.select("nid", "bands", "weighted").join(texts, "nid"), similarity)
    discard(held, texts, tested, popular)
    return labels


def _open_rows(held: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, salt, salts, nid, n, label) of the buckets of three or more whose members lie in several classes."""
    labelled = held.filter("size > 2").join(labels, "nid", "left").select("bucket", "salt", "salts", "nid", "n", F.coalesce("label", "nid").alias("label"))
    several = labelled.groupBy("bucket", "salts").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket", "salts")
    return _salted(labelled.drop("salts"), several)


def _joined_groups(rows: DataFrame, labels: DataFrame, popular: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``labels`` after the links that remain in large open buckets, which are taken together where they overlap.

    First the most shared texts of a group meet all others, which joins most of it; then every text
    outside the group's largest class meets all texts of other classes. Of these, pairs that share
    a bucket and are likely are compared, as in small buckets. So no pair across classes is left
    out, and the largest class is never compared with itself.
    """
    rows = scratch(rows, "open")
    least = rows.groupBy("bucket", "salts").agg(F.min("nid").alias("b"))
    groups = components(_salted(rows.drop("salts"), least).select(F.col("nid").alias("a"), "b"))
    nodes = groups.withColumnRenamed("label", "g").join(rows.select("nid", "n").distinct(), "nid").join(popular, "nid")
    nodes = scratch(nodes.select("g", "nid", "n", "pop"), "groups")
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("pop"), "nid"))
    for turn in range(2):
        own = scratch(nodes.join(labels, "nid", "left").select("g", "nid", "n", "pop", F.coalesce("label", "nid").alias("label")), "classes")
        if turn:
            sizes = own.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n"))
            main = sizes.groupBy("g").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
            left = own.join(main, "g").filter("label <> main")
        else:
            left = own.withColumn("place", place).filter(F.col("place") <= HUBS)
        found = scratch(compared_in_cells(left, own, texts, similarity), "verified")
        labels = extended(labels, found)
        discard(own, found)
    discard(rows, nodes)
    return labels


def _shares_bucket(one: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which texts have a bucket in common with one text, whichever measure's keys meet."""
    return np.logical_or.reduce([(x == y).any(1) for x in one for y in others])


def compared_in_cells(left: DataFrame, right: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b) links between the ``left`` and ``right`` texts (g, nid, n, label) of each group that have different labels, share
    a bucket and are likely, from (nid, bands, weighted, text).

    Both sides are cut into blocks of about CELL texts, fewer if they are long; a task compares two
    blocks, never holds more, and stops comparing two labels once they are linked.
    """
    size = F.abs("n")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / CELL, F.sum(size) / CELL_SHINGLES)).cast("int")
    sizes = left.groupBy("g").agg(blocks.alias("rows")).join(right.groupBy("g").agg(blocks.alias("columns")), "g")
    block = lambda count: F.pmod(F.xxhash64("nid"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    a = left.join(sizes, "g").select("g", "nid", "label", block("rows").alias("i"), "columns").select("g", "i", every("columns").alias("j"), "nid", "label", F.lit(True).alias("is_left"))
    b = right.join(sizes, "g").select("g", "nid", "label", block("columns").alias("j"), "rows").select("g", every("rows").alias("i"), "j", "nid", "label", F.lit(False).alias("is_left"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        even = np.stack([np.asarray(x, np.int64) for x in frame["bands"]])
        by_count = np.stack([np.asarray(w if len(w) else x, np.int64) for w, x in zip(frame["weighted"], frame["bands"], strict=True)])
        differ = np.fromiter((len(w) > 0 for w in frame["weighted"]), bool, len(frame))
        nid, label, is_left = (frame[c].to_numpy() for c in ("nid", "label", "is_left"))
        rows, columns = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        least, up, found = least_agreeing(similarity, even.shape[1] * ROWS), {}, []

        def top(x: int) -> int:
            while (over := up.setdefault(x, x)) != x:
                up[x] = x = up.setdefault(over, over)
            return x

        def link(i: int, j: int) -> None:
            if (x := top(label[i])) != (y := top(label[j])):
                up[x] = y
                found.append((min(nid[i], nid[j]), max(nid[i], nid[j])))

        with np.errstate(over="ignore"):
            doc, hashes, counts = weighted(*shingle_hashes([t.encode("utf-8", "replace") for t in frame["text"]], WordHashes()))
        size, ends = np.bincount(doc, minlength=len(nid)), np.searchsorted(doc, np.arange(len(nid) + 1))
        own = lambda i: (hashes[ends[i] : ends[i + 1]], counts[ends[i] : ends[i + 1]])
        common = shared_counts(doc, hashes, rows, columns, len(nid))
        alike = (common > 0) & (common >= similarity * (size[rows][:, None] + size[columns] - common))
        open_pairs = (common > 0) & (label[rows][:, None] != label[columns]) & (alike | differ[rows][:, None] | differ[columns])
        for k in np.flatnonzero(open_pairs.any(1)).tolist():
            i, j = rows[k], columns[open_pairs[k]]
            j = j[_shares_bucket((even[i], by_count[i]), (even[j], by_count[j]))]
            of_sets, of_counts = agreeing(even[i], even[j]) >= least, agreeing(by_count[i], by_count[j]) >= least
            as_sets = alike[k, np.searchsorted(columns, j)]
            for other in j[as_sets & (of_sets | of_counts)].tolist():
                link(i, other)
            for other in j[~as_sets & (of_sets | of_counts)].tolist():
                if top(label[i]) != top(label[other]) and similar(own(i), own(other), similarity):
                    link(i, other)
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return a.union(b).join(texts, "nid").groupBy("g", "i", "j").applyInPandas(run, "a long, b long").distinct()


def shared_counts(doc: np.ndarray, hashes: np.ndarray, rows: np.ndarray, columns: np.ndarray, n_docs: int) -> np.ndarray:
    """How many shingles each text of ``rows`` shares with each of ``columns``, some thousand shingles at a time."""
    _, shingle = np.unique(hashes, return_inverse=True)
    order = np.argsort(shingle, kind="stable")
    doc, shingle = doc[order], shingle[order]
    out, step = np.zeros((len(rows), len(columns)), np.int64), 8192
    last = int(shingle[-1]) + 1 if len(shingle) else 0
    for start in range(0, last, step):
        a, b = np.searchsorted(shingle, (start, start + step))
        present = np.zeros((n_docs, min(step, last - start)), np.float32)
        present[doc[a:b], shingle[a:b] - start] = 1
        out += np.rint(present[rows] @ present[columns].T).astype(np.int64)
    return out


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs``, all columns as they are, with one row of each class: the one with the least id.

    Rows go by id and text, so two texts under one id are both kept unless they are near-duplicates;
    of rows that repeat in both, one stays. Documents are dealt by id and text at every size of the table.
    """
    found = scratch(_members(docs, id_col, text_col, similarity), "members")
    gone = found.filter(~F.col("first")).select("nid", "h").distinct()
    tail = "_".join(docs.columns)  # names that no column has
    nid, h = f"nid_{tail}", f"h_{tail}"
    own = docs.withColumns({nid: node_of(type_of(docs, id_col), id_col, text_col), h: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    kept = own.join(gone.select(F.col("nid").alias(nid), F.col("h").alias(h)).hint("shuffle_hash"), [nid, h], "left_anti")
    if not found.filter("first").groupBy("nid", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        kept = kept.dropDuplicates([nid, h])
    return kept.select(*docs.columns)
