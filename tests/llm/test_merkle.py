import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import merkle
from ledgerloom.llm.merkle import TOP, Fragment, Stretch

from .conftest import ordered


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(leaves, arity=3):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
    return out


def way(levels, i, arity=3):
    found = []
    for level in levels[:-1]:
        first = i - i % arity
        found.append(("".join(level[first:i]), "".join(level[i + 1 : first + arity])))
        i //= arity
    return found


def brute(rows, arity=3):
    """(doc_id, leaf, subroot, root, proof, folded) of (doc_id, group, leaf, claimed) rows."""
    null_first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v if v is not None else 0)
    groups = {}
    for r in sorted(rows, key=lambda r: (null_first(r[1]), null_first(r[0]), r[2], null_first(r[3]))):
        groups.setdefault(r[1], []).append(r)
    trees = {g: levels_of([r[2] for r in own], arity) for g, own in groups.items()}
    top = levels_of([t[-1][0] for t in trees.values()], arity)
    out = []
    for k, (g, own) in enumerate(groups.items()):
        for i, (doc_id, _, leaf, claimed) in enumerate(own):
            path = way(trees[g], i, arity) + way(top, k, arity)
            folded = leaf if claimed is None else claimed
            for a, b in path:
                folded = sha(a + folded + b)
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], "".join(a + b for a, b in path), folded))
    return out


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_fragments_merge_in_any_order(arity):
    rng = random.Random(arity)
    for n in [*range(1, 30), 80, 243, 244]:
        leaves = [sha(f"{n} {i}") for i in range(n)]
        want = levels_of(leaves, arity)[-1][0].encode()
        cuts = [0, *sorted(rng.sample(range(1, n), min(n - 1, rng.randint(0, 6)))), n]
        parts = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            stretch = Stretch(n, a, "".join(leaves[a:b]).encode(), arity)
            edges = list(stretch.edges())
            assert all(sum(e[0] == level for e in edges) <= 2 * arity for level in range(12))
            parts.append(Fragment({TOP: n}, {(TOP, level, i): h for level, i, h in edges}, {}, arity))
        rng.shuffle(parts)
        while len(parts) > 1:  # any tree of merges
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [parts[i].merge(parts[i + 1])]
        assert list(parts[0].open.values()) == [want]
        assert Fragment({TOP: n}, arity=arity).merge(parts[0]).open == parts[0].open


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, leaf string, claimed string").withColumn("part", F.lit("mine")).withColumn("grp", F.lit(1)).repartition(3)


def found(df, arity=3, rows_a_part=1_000_000):
    out = merkle.manifest(df, group_col="source", id_col="doc_id", leaf=F.col("leaf"), claimed=F.col("claimed"), arity=arity, rows_a_part=rows_a_part)
    return ordered([tuple(r) for r in out.collect()])


@pytest.mark.parametrize("arity,rows_a_part", [(3, 1_000_000), (3, 17), (2, 40)])
def test_trees_equal_brute_force(spark, arity, rows_a_part):
    """A hot group, a null group, an empty name, names whose order differs by bytes, many small groups, equal rows, null ids."""
    rng = random.Random(1)
    names = [None, "", "hot", "é", "z", "aé", "\U0001f600", "￮", *(f"g{i}" for i in range(40))]
    rows = [(i, rng.choice(["hot", "hot", rng.choice(names)]), sha(str(i)), sha(f"x{i}") if i % 3 == 0 else None) for i in range(400)]
    rows += [(7, "hot", sha("same"), None)] * 60 + [(None, "hot", sha("n"), None), (None, None, sha("n"), sha("m")), (5, "hot", sha("other"), None)]
    assert found(table(spark, rows), arity, rows_a_part) == ordered(brute(rows, arity))


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_one_group(spark, n):
    rows = [(i, "s", sha(str(i)), None) for i in range(n)]
    got = found(table(spark, rows))
    assert got == ordered(brute(rows))
    assert all(r[2] == r[3] == r[5] for r in got)


def test_groups_of_one_row(spark):
    rows = [(1, f"{i:03}", sha(str(i)), None) for i in range(100)]
    assert found(table(spark, rows), rows_a_part=9) == ordered(brute(rows))


def test_empty_table(spark):
    df = table(spark, [(1, "s", "x", None)]).limit(0)
    assert found(df) == []


def test_leaf_hash_of_awkward_values(spark, docs, rows):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    got = docs.select(*columns, merkle.leaf_hash([F.col(c) for c in columns]).alias("h")).collect()
    assert len(got) == len(rows)
    assert all(r.h == sha("".join(value(r[c]) for c in columns)) for r in got)


def test_query_against_brute_force(spark, docs, tmp_path):
    from ledgerloom.llm.queries import QUERIES

    docs = docs.union(docs.filter("doc_id = 400").withColumn("doc_id", F.explode(F.array([F.lit(i).cast("long") for i in range(401, 409)]))))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(value, (r.doc_id, r.source, r.lang, r.n_chars, text))))
    even = lambda r: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
    rows = [(r.doc_id, r.source, leaf(r, r.text), leaf(r, r.text and r.text.replace("\n", "")) if even(r) else None) for r in docs.collect()]
    want = [(i, a, s, root, sha(proof), f, f == root) for i, a, s, root, proof, f in brute(rows)]
    got = QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert ordered([tuple(r) for r in got]) == ordered(want)
    assert {r.verified for r in got} == {True, False}


def test_verify():
    levels = levels_of([sha(str(i)) for i in range(11)])
    assert all(merkle.verify(levels[0][i], way(levels, i), levels[-1][0]) for i in range(11))
    assert not merkle.verify(sha("changed"), way(levels, 3), levels[-1][0])
