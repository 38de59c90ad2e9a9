"""Merkle manifest of a dataset: a sparse-forest monoid folded by a tree reduction.

Rows become leaves, leaves of one group form a tree of fixed arity, the groups' roots form one
more tree. Rows are range-partitioned by group and order, so a task holds a contiguous stretch of
every tree it touches. It hashes all sibling runs that lie within its stretch; what is left at
the edges, a few nodes a level, is its *fragment*. Fragments merge associatively and in any
order: whenever all siblings of a run have met, their parent takes their place.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_of, rows_out, scratch, type_of

#: Siblings of a full run.
ARITY = 3
#: Rows that a task holds at most, about. Fragments hold some fifty nodes a task, so the driver gets 50 nodes
#: for every so many rows: about 250 MB at 2e10 rows.
ROWS_A_PART = 1_000_000
#: Rows handed to Spark at a time.
ROWS_AT_ONCE = 20_000
#: The tree over the groups' roots; the other trees go by their group's place.
TOP = -1
#: Characters of a digest.
HEX = 64


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def leaf_hash(columns: Iterable[Column]) -> Column:
    """sha256 over all columns' values, each ``-`` if null, else its length in UTF-8 bytes, ``:`` and itself."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in (x.cast("string") for x in columns)]
    return F.sha2(F.concat(*parts), 256)


def widths(n: int, arity: int = ARITY) -> list[int]:
    """Nodes of each level over ``n`` leaves, down to one."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


class Stretch:
    """A contiguous stretch of one tree's leaves with every ancestor whose leaves all lie within it."""

    def __init__(self, n: int, start: int, leaves: bytes, arity: int = ARITY):
        self.widths, self.arity, self.levels = widths(n, arity), arity, [(start, leaves)]
        for width in self.widths[:-1]:
            end = start + len(leaves) // HEX
            first, last = -(-start // arity), -(-width // arity) if end == width else end // arity
            runs = range(first, max(first, last))
            leaves = b"".join([digest(leaves[HEX * max(0, arity * r - start) : HEX * (min(arity * r + arity, end) - start)]) for r in runs])
            start = first
            self.levels.append((start, leaves))

    def node(self, level: int, i: int) -> bytes:
        """The node's digest, empty if it isn't within the stretch."""
        start, held = self.levels[level]
        return held[HEX * (i - start) : HEX * (i - start + 1)] if i >= start else b""

    @property
    def root(self) -> bytes:
        return self.levels[-1][1]

    def edges(self) -> Iterator[tuple[int, int, bytes]]:
        """(level, place, digest) of nodes whose parent isn't known here."""
        for level, (start, held) in enumerate(self.levels):
            end = start + len(held) // HEX
            if level + 1 < len(self.levels):
                up, above = self.levels[level + 1]
                known = range(self.arity * up, self.arity * (up + len(above) // HEX))
                for i in (*range(start, min(end, known.start)), *range(max(start, known.stop), end)) if known else range(start, end):
                    yield level, i, self.node(level, i)
            elif held:
                yield level, 0, held


@dataclass
class Fragment:
    """Nodes by (tree, level, place): ``open`` ones wait for siblings, ``done`` ones have their parent.

    ``sizes`` has the leaves of every tree in it. ``merge`` is associative and commutative, an
    empty fragment is its identity.
    """

    sizes: dict[int, int] = field(default_factory=dict)
    open: dict[tuple[int, int, int], bytes] = field(default_factory=dict)
    done: dict[tuple[int, int, int], bytes] = field(default_factory=dict)
    arity: int = ARITY

    def merge(self, other: Fragment) -> Fragment:
        one, two = (self, other) if len(self.open) + len(self.done) >= len(other.open) + len(other.done) else (other, self)
        todo = list(two.open)
        one.sizes |= two.sizes
        one.open |= two.open
        one.done |= two.done
        shape = {tree: widths(one.sizes[tree], one.arity) for tree in {k[0] for k in todo} | ({TOP} if TOP in one.sizes else set())}
        while todo:
            tree, level, i = todo.pop()
            if (tree, level, i) not in one.open:
                continue
            if shape[tree][level] == 1:
                if tree != TOP:  # a whole tree is a leaf of the top tree
                    one.open[TOP, 0, tree] = one.done[tree, level, i] = one.open.pop((tree, level, i))
                    todo.append((TOP, 0, tree))
                continue
            run = [(tree, level, j) for j in range(i - i % one.arity, min(i - i % one.arity + one.arity, shape[tree][level]))]
            if all(k in one.open for k in run):
                held = [one.open.pop(k) for k in run]
                one.done.update(zip(run, held, strict=True))
                parent = (tree, level + 1, i // one.arity)
                one.open[parent] = digest(b"".join(held))
                todo.append(parent)
        return one


@dataclass(frozen=True)
class Part:
    """Where a task's rows stand: place of its first group, leaves of that group before it, leaves of its first and last group in all."""

    group: int
    before: int
    first_total: int
    last_total: int


def _stretches(table: pa.Table, at: Part, arity: int) -> Iterator[tuple[int, int, Stretch]]:
    """(group's place, rows, stretch) of every group of a task's ordered rows."""
    ends = pc.run_end_encode(table.column("grp").combine_chunks()).run_ends.to_pylist()
    begun = 0
    for k, end in enumerate(ends):
        leaves = "".join(table.column("leaf").slice(begun, end - begun).to_pylist()).encode()
        rows, start = end - begun, at.before if k == 0 else 0
        n = at.first_total if k == 0 else at.last_total if k == len(ends) - 1 else rows
        yield at.group + k, rows, Stretch(n, start, leaves, arity)
        begun = end


def _parts(ordered: DataFrame) -> tuple[dict[int, Part], int]:
    """The place of each task's rows, and the number of groups; one row a task reaches the driver."""
    name = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.sha2(c.cast("binary"), 256))
    each = ordered.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("n"))
    ends = each.groupBy("part").agg(F.count(F.lit(1)).alias("groups"), F.min(F.struct("grp", "n")).alias("a"), F.max(F.struct("grp", "n")).alias("z"))
    found = ends.select("part", "groups", name(F.col("a.grp")).alias("first"), F.col("a.n").alias("n_first"), name(F.col("z.grp")).alias("last"), F.col("z.n").alias("n_last")).collect()
    places, totals, group, running, name_before = {}, {}, -1, 0, None
    for r in sorted(found, key=lambda r: r.part):
        if r["first"] != name_before:
            group, running = group + 1, 0
        places[r.part] = (group, running, group + r.groups - 1)
        totals[group] = totals.get(group, 0) + r.n_first
        running += r.n_first
        if r.groups > 1:
            group += r.groups - 1
            totals[group] = running = r.n_last
        name_before = r["last"]
    return {p: Part(g, before, totals[g], totals[last]) for p, (g, before, last) in places.items()}, group + 1


def manifest(rows: DataFrame, *, group_col: str, id_col: str, leaf: Column, claimed: Column | None = None, arity: int = ARITY, rows_a_part: int = ROWS_A_PART, proof_digest: bool = False) -> DataFrame:
    """One row a row: doc_id, leaf, subroot, root, proof, folded_root.

    ``leaf`` is a row's digest as found now; ``claimed``, where not null, the digest that is folded
    with the row's siblings instead. ``proof`` is the text of all siblings' digests, level by level
    via the group's root to the root, left to right; with ``proof_digest`` its sha256.

    Groups stand in order of their names in UTF-8, a null group first; leaves of a group by id (null
    first), rows of the same id by leaf, equal rows together. A group of any size is cut over as
    many tasks as its rows need. An empty table gives no rows.
    """
    spark = rows.sparkSession
    keyed = rows.select(F.col(id_col).alias("doc_id"), F.col(group_col).cast("string").alias("grp"), leaf.alias("leaf"), (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"))
    order = [F.col(c).asc_nulls_first() for c in ("grp", "doc_id", "leaf", "claimed")]
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / rows_a_part))
    spread = keyed.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n_parts, *order, F.col("tie"))  # equal rows may go apart
    ordered = scratch(spread.drop("tie").withColumn("part", F.spark_partition_id()), "leaves")
    parts, groups = _parts(ordered)
    by_part = ordered.repartitionById(n_parts, F.col("part")).sortWithinPartitions("part", *order)

    def whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Part, pa.Table]]:
        held, now = [], None
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                part = batch.column("part")[start].as_py()
                end = start + pc.sum(pc.equal(batch.column("part"), part)).as_py()
                if part != now and held:
                    yield parts[now], pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(start, end - start))
                now, start = part, end
        if held:
            yield parts[now], pa.Table.from_batches(held)

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Fragment({TOP: groups}, arity=arity)
        for at, rows_of_part in whole_parts(batches):
            here, roots, start = Fragment({TOP: groups}, arity=arity), [], None
            for place, _, stretch in _stretches(rows_of_part, at, arity):
                if stretch.root:
                    start = place if start is None else start
                    roots.append(stretch.root)
                else:
                    here.sizes[place] = stretch.widths[0]
                    here.open.update(((place, level, i), h) for level, i, h in stretch.edges())
            if roots:
                here.open.update(((TOP, level, i), h) for level, i, h in Stretch(groups, start, b"".join(roots), arity).edges())
            out = out.merge(here)
        yield pa.RecordBatch.from_pydict({"fragment": pa.array([pickle.dumps(out)], pa.binary())})

    kind = type_of(keyed, "doc_id")
    ddl = f"doc_id {kind}, leaf string, subroot string, root string, proof string, folded_root string"
    if not groups:
        return spark.createDataFrame([], ddl)
    forest = by_part.select("part", "grp", "leaf").mapInArrow(fragments, "fragment binary").rdd.map(lambda r: pickle.loads(r.fragment)).treeReduce(Fragment.merge, depth=max(2, math.ceil(math.log(n_parts, 32))))
    root = forest.open[TOP, len(widths(groups, arity)) - 1, 0]
    known, schema = spark.sparkContext.broadcast(forest.done | forest.open), arrow_of(ddl)

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, rows_of_part in whole_parts(batches):
            begun, roots, start, found = 0, [], 0, list(_stretches(rows_of_part, at, arity))
            for place, _, stretch in found:
                if stretch.root:
                    start = start if roots else place
                    roots.append(stretch.root)
            top = Climb(TOP, Stretch(groups, start, b"".join(roots), arity), known.value)
            for place, n, stretch in found:
                climb, first = Climb(place, stretch, known.value, top.siblings(0, place)), stretch.levels[0][0]
                subroot = (stretch.root or known.value[TOP, 0, place]).decode()
                for done in range(0, n, ROWS_AT_ONCE):
                    own = rows_of_part.slice(begun + done, min(ROWS_AT_ONCE, n - done))
                    leaves, proofs, folded = own.column("leaf").to_pylist(), [], []
                    for k, (one, other) in enumerate(zip(leaves, own.column("claimed").to_pylist(), strict=True)):
                        proof, path = climb.siblings(0, first + done + k)
                        proofs.append(hashlib.sha256(proof).hexdigest() if proof_digest else proof.decode())
                        folded.append(fold((one if other is None else other).encode(), path).decode())
                    yield rows_out(schema, [own.column("doc_id").combine_chunks(), leaves, [subroot] * len(leaves), [root.decode()] * len(leaves), proofs, folded])
                begun += n

    return by_part.mapInArrow(prove, ddl)


Path = tuple[tuple[bytes, bytes], ...]


class Climb:
    """Siblings on the way up from nodes visited in order; what neighbours share is kept from one to the next."""

    def __init__(self, tree: int, stretch: Stretch, known: dict[tuple[int, int, int], bytes], beyond: tuple[bytes, Path] = (b"", ())):
        self.tree, self.stretch, self.known, self.beyond = tree, stretch, known, beyond
        self.last: list[tuple[int, tuple[bytes, Path]]] = [(-1, beyond)] * len(stretch.widths)

    def _node(self, level: int, i: int) -> bytes:
        return self.stretch.node(level, i) or self.known[self.tree, level, i]

    def siblings(self, level: int, i: int) -> tuple[bytes, Path]:
        """All siblings' digests up to the root as one text, and as (left, right) of each level."""
        width = self.stretch.widths[level]
        if width == 1:
            return self.beyond
        if self.last[level][0] != i:
            first, arity = i - i % self.stretch.arity, self.stretch.arity
            left = b"".join([self._node(level, j) for j in range(first, i)])
            right = b"".join([self._node(level, j) for j in range(i + 1, min(first + arity, width))])
            proof, path = self.siblings(level + 1, i // arity)
            self.last[level] = (i, (left + right + proof, ((left, right), *path)))
        return self.last[level][1]


def fold(leaf: bytes, path: Path) -> bytes:
    """The root that a leaf gives with its siblings."""
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def verify(leaf: str, proof: Sequence[tuple[str, str]], root: str) -> bool:
    """Whether a leaf's digest with its siblings, as (left, right) of each level, gives ``root``."""
    return fold(leaf.encode(), tuple((a.encode(), b.encode()) for a, b in proof)).decode() == root

